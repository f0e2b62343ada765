"""Exact top-k search by inner product: KD-trees per shard (operator 11).

Vectors are dealt into shards of bounded size, and each shard becomes one tree: median splits along the
widest side, a tight box around each node's points, and the node's smallest id. No point of a box has a
larger product with a query than the box's best corner, so a best-first walk may stop at the first
node that is worse than the kth best found. Queries are dealt into tiles of bounded size. Each tile meets one
shard first; the kth best of its queries then goes along to all other shards, where it ends most
walks early. A cell of (tile, shard) is one row: neither side is broadcast, and only candidates that
beat the kth best so far leave a cell.
"""

from __future__ import annotations

import heapq
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship, stage

#: Points of a leaf, queries whose bounds are told at once, and the largest whole number below which a
#: double is exact.
LEAF, CHUNK, EXACT = 64, 128, 2.0**53
LAST = np.iinfo(np.int64).max
LONG = (-(2**63), 2**63 - 1)


class Tree:
    """points, ids and uids in the order of the leaves; of each node its first and last place, its left
    child (the right one follows it; -1: a leaf), its box and its smallest id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, uids: np.ndarray, leaf: int = LEAF) -> None:
        order, nodes, todo, boxes = np.arange(len(points)), [], [(0, len(points))], []
        at = 0
        while at < len(todo):
            start, stop = todo[at]
            own = points[order[start:stop]]
            low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(points.shape[1]),) * 2
            boxes.append((low, high, ids[order[start:stop]].min(initial=LAST)))
            if stop - start > leaf and (high > low).any():
                half = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(own[:, np.argmax(high - low)], half)]
                nodes.append((start, stop, len(todo)))
                todo += [(start, start + half), (start + half, stop)]
            else:
                # Points that are all alike stay one leaf; of these the smallest ids come first.
                order[start:stop] = order[start:stop][np.argsort(ids[order[start:stop]], kind="stable")]
                nodes.append((start, stop, -1))
            at += 1
        self.points, self.ids, self.uids = points[order], ids[order], uids[order]
        self.nodes = np.array(nodes, np.int32)
        self.low, self.high = (np.array([b[i] for b in boxes]) for i in (0, 1))
        self.least = np.array([b[2] for b in boxes], np.int64)

    NAMES = {"points": np.float64, "ids": np.int64, "uids": np.int64, "nodes": np.int32, "low": np.float64, "high": np.float64, "least": np.int64}

    def packed(self) -> dict[str, bytes]:
        """Coordinates as 32-bit floats where these hold them exactly."""
        small = np.abs(self.points).max(initial=0) <= 1 << 24
        kind = lambda n: np.float32 if small and self.NAMES[n] is np.float64 else self.NAMES[n]
        return {n: np.ascontiguousarray(getattr(self, n), kind(n)).tobytes() for n in self.NAMES}

    @classmethod
    def of(cls, packed: dict[str, bytes], dim: int) -> "Tree":
        tree = cls.__new__(cls)
        n = len(packed["ids"]) // 8
        kind = np.float32 if len(packed["points"]) == 4 * n * dim else np.float64
        for name, stored in cls.NAMES.items():
            found = np.frombuffer(packed[name], kind if stored is np.float64 else stored).astype(stored)
            rows = n if name == "points" else len(packed["least"]) // 8
            setattr(tree, name, found.reshape(rows, dim) if stored is np.float64 else found.reshape(-1, 3) if name == "nodes" else found)
        return tree

    def whole_numbers(self) -> "Tree":
        """The same tree in Python's integers, for products that no double holds exactly."""
        out = Tree.__new__(Tree)
        out.__dict__ |= self.__dict__ | {n: _integers(getattr(self, n)) for n in ("points", "low", "high")}
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, worst: list[tuple]) -> list[list[tuple]]:
        """Of each query the candidates (-score, id, uid) among this tree's points, at most k and in order,
        that are no worse than its worst: (-score, id) of the kth best found elsewhere, or empty. own:
        uids that are left out."""
        out = []
        for i in range(0, len(queries), CHUNK):
            part = queries[i : i + CHUNK]
            bounds = np.maximum(part, 0) @ self.high.T + np.minimum(part, 0) @ self.low.T
            out += [self._walk(q, b.tolist(), o, k, w) for q, b, o, w in zip(part, bounds, own[i : i + CHUNK], worst[i : i + CHUNK])]
        return out

    def _walk(self, query: np.ndarray, bounds: list, own: int, k: int, worst: tuple) -> list[tuple]:
        nodes, least, top = self.nodes, self.least, []
        heap = [(-bounds[0], int(least[0]), 0)]
        while heap:
            bound, low, node = heapq.heappop(heap)
            if worst and (bound, low) > worst:
                break
            start, stop, left = nodes[node].tolist()
            if left >= 0:
                for child in (left, left + 1):
                    reach = (-bounds[child], int(least[child]))
                    if not worst or reach <= worst:
                        heapq.heappush(heap, (*reach, child))
                continue
            scores = self.points[start:stop] @ query
            near = np.flatnonzero(scores >= -worst[0]) if worst else np.arange(stop - start)
            each = ((-s, x, u) for s, x, u in zip(scores[near], self.ids[start + near].tolist(), self.uids[start + near].tolist()) if u != own)
            for found in heapq.nsmallest(k, each):
                if not worst or found[:2] <= worst:
                    insort(top, found)
                    if len(top) >= k:
                        del top[k:]
                        worst = top[-1][:2]
        return top


def _integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel()]
    return out


def _matrix(vectors: pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(-1, dim) if dim else np.zeros((len(vectors), 0))


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(LAST).to_numpy().astype(np.int64)


TREE = ", ".join(f"{n} binary" for n in Tree.NAMES)
TILE = "q_points binary, q_ids binary, q_uids binary, kth binary, kth_id binary"


def _build(scale: float):
    def run(key, table):
        dim, shard = (k.as_py() for k in key)
        packed = Tree(_matrix(table.column("vector"), dim, scale), _ids(table), table.column("uid").to_numpy()).packed()
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64())} | {n: pa.array([b], pa.binary()) for n, b in packed.items()})

    return run


def _tiled(scale: float):
    def run(key, table):
        dim, tile = (k.as_py() for k in key)
        n = table.num_rows
        columns = [_matrix(table.column("vector"), dim, scale), table.column("id").to_numpy().astype(np.int64), table.column("uid").to_numpy(), np.full(n, -np.inf), np.full(n, LAST)]
        names = [x.split()[0] for x in TILE.split(", ")]
        return pa.table({"dim": pa.array([dim], pa.int32()), "tile": pa.array([tile], pa.int64())} | {m: pa.array([c.tobytes()], pa.binary()) for m, c in zip(names, columns)})

    return run


FOUND = "query_uid long, query_id long, id long, uid long, score long"
FOUND_TYPE = pa.struct([(x.split()[0], pa.int64()) for x in FOUND.split(", ")])


def _cell(k: int):
    """Of each row the tile with the kth best of its queries so far, and the candidates found."""
    carried = ["dim", "tile", "shard", *(x.split()[0] for x in TILE.split(", "))]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                found = []
                if row["points"] is not None:
                    dim, q = row["dim"], np.frombuffer(row["q_points"], np.float64)
                    q = q.reshape(len(row["q_ids"]) // 8, dim)
                    q_ids, q_uids = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_uids"))
                    kth, kth_id = np.frombuffer(row["kth"], np.float64).copy(), np.frombuffer(row["kth_id"], np.int64).copy()
                    tree = Tree.of({n: row[n] for n in Tree.NAMES}, dim)
                    if np.abs(tree.points).max(initial=0) * np.abs(q).max(initial=0) * max(1, dim) >= EXACT:
                        tree, q = tree.whole_numbers(), _integers(q)
                    worst = [() if s == -np.inf else (-s, int(j)) for s, j in zip(kth.tolist(), kth_id)]
                    for j, top in enumerate(tree.search(q, q_uids, k, worst)):
                        found += [{"query_uid": int(q_uids[j]), "query_id": int(q_ids[j]), "id": None if x == LAST else x, "uid": u, "score": min(max(int(-s), LONG[0]), LONG[1])} for s, x, u in top]
                        if len(top) == k:
                            last = float(-top[-1][0])
                            # A bound that a double can't hold is rounded down, which only makes it looser.
                            kth[j], kth_id[j] = (last, top[-1][1]) if abs(last) < EXACT else (max(np.nextafter(last, -np.inf), -1.7e308), LAST)
                    row |= {"kth": kth.tobytes(), "kth_id": kth_id.tobytes()}
                columns = [pa.array([row[n]], batch.schema.field(n).type) for n in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([found], pa.list_(FOUND_TYPE))], names=[*carried, "found"])

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vec_col: str = "embedding", shard_bytes: int = 16 << 20, tile_bytes: int = 4 << 20, least_points: int = 512
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query row the k other rows with the largest inner
    product of floor(scale * x), ties to the smaller id. is_query: a condition on the vectors' columns.

    A query's own row is no candidate; another row of the same id is one. Vectors that are null, hold
    a null or a component that is not finite (times scale) take no part. A vector meets those of its
    own length only, one without components too. Null ids come last in ties and are no queries. Fewer
    than k candidates are all returned; an empty table gives an empty table. Scores are exact; one beyond a long is given
    as the nearest long. Other columns are ignored. Shards and tiles are bounded in bytes by the
    parameters; small tables are dealt over all cores down to least_points a shard.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    usable = F.forall(v, lambda x: F.coalesce(F.abs(x * float(scale)) < F.lit(float("inf")), F.lit(False)))
    chosen = F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), chosen.alias("asks"), usable.alias("ok")).where("vector IS NOT NULL AND ok")
    rows = stage(rows.select("id", "vector", "asks", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("uid")), "vectors")
    size = F.sum(F.col("dim").cast("long") * 8 + 32)
    n, n_bytes, q_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), F.col("dim").cast("long") * 8 + 32)), F.lit(0))).first()
    cores = 2 * spark.sparkContext.defaultParallelism
    shards = max(1, -(-n_bytes // shard_bytes), min(cores, n // least_points))
    tiles = max(1, -(-q_bytes // tile_bytes))
    ship(spark)
    dealt = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m))
    # A shard is work for one task, however few its bytes.
    apart = lambda df: df.repartition(shards, "dim", "shard")
    sharded = apart(rows.withColumn("shard", dealt(shards))).groupBy("dim", "shard")
    trees = stage(sharded.applyInArrow(_build(scale), f"dim int, shard long, {TREE}"), "kd-trees")
    asked = rows.where("asks").groupBy("dim", dealt(tiles).alias("tile")).applyInArrow(_tiled(scale), f"dim int, tile long, {TILE}")
    out = f"dim int, tile long, shard long, {TILE}, found array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>"
    home = asked.withColumn("shard", F.pmod("tile", F.lit(shards)))
    first = stage(map_arrow(home.join(trees, ["dim", "shard"], "left"), _cell(k), out), "first-cells")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"), lambda s: s != F.col("shard"))
    cells = first.select("dim", "tile", *(x.split()[0] for x in TILE.split(", ")), F.explode(others).alias("shard"))
    rest = map_arrow(apart(cells).join(apart(trees), ["dim", "shard"]), _cell(k), out)
    found = first.select(F.inline("found")).unionByName(rest.select(F.inline("found")))
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
