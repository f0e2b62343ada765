"""Near-duplicate detection with circulant MinHash (operator 10).

C-MinHash needs two permutations: sigma scatters a document's shingles over the ring of 32-bit
integers, and coordinate k of the signature is the minimum of pi over the shingles after a circular
shift by k. Both are fixed bijections of the ring, so nothing of the size of the universe is stored.

Equal shingle sets are one class, compared once. Classes that agree in all rows of a band share a
bucket. In a bucket a pivot is compared with the others, on the full sets; later rounds compare
another pivot, drawn by a hash, with those that are not yet connected to it. What is still apart from
the largest component of its bucket is then held against the bucket's members, in blocks of bounded
size; no pairs are listed but the links found. So a bucket of thousands of near copies costs little
more than its size, and none is cut off. With 32 bands of 5 rows, a pair at similarity 0.8
shares no bucket with probability 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, perhaps_in, spread, stage, text_of
from .components import components

CHUNK = 1 << 18
#: Words whose hashes a Python worker remembers at most.
KNOWN_WORDS = 200_000
U = np.uint64


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Known()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _sigma(x: np.ndarray) -> np.ndarray:
    y = (x ^ (x >> U(32))).astype(np.uint32)
    y = (y ^ (y >> np.uint32(16))) * np.uint32(0x7FEB352D)
    y = (y ^ (y >> np.uint32(15))) * np.uint32(0x846CA68B)
    return y ^ (y >> np.uint32(16))


def _pi(y: np.ndarray) -> np.ndarray:
    y = (y ^ (y >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    y = (y ^ (y >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return y ^ (y >> np.uint32(16))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, ascending. Only A-Z are lower-cased; words are what ASCII
    white space parts; fewer words than size are one shingle; without words the set is empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(_known.__getitem__, words), U, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), U)
    for j in range(min(size, len(w))):
        h = h * U(0x9E3779B97F4A7C15) + _mix64(w[j : j + n] + U(j))
    return np.unique(_mix64(h))


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= CHUNK:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands) of the sets, none empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    scattered = _sigma(np.concatenate(sets))
    out = np.empty((len(sets), bands), U)
    for b in range(bands):
        h = np.full(len(sets), b, U)
        for k in range(b * rows, (b + 1) * rows):
            h = _mix64(h * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(_pi(scattered + np.uint32(k)), starts))
        out[:, b] = h
    return out


def _sign(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _chunks(texts):
                sets = [shingle_set(t, size) for t in texts[part]]
                full = [s for s in sets if len(s)]
                signed = iter(_band_hashes(full, bands, rows).view(np.int64)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, len(sets)),
                        batch.column("mark").slice(part.start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(signed) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "mark", "n", "node", "bands"],
                )

    return run


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _chunks(texts):
                sets = [shingle_set(t, size).view(np.int64) for t in texts[part]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(part.start, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
                )

    return run


def _close(n: str, m: str, threshold: int):
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * threshold


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * threshold).select("a", "b")


def _block_links(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        apart = table.column("apart").to_numpy()
        nodes, components_of = table.column("node").to_pylist(), table.column("component").to_pylist()
        lists = table.column("shingles").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        _, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(sizes)
        marked = np.zeros(len(flat), bool)
        members = np.flatnonzero(~apart)
        places = np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in members]) if len(members) else flat[:0]
        starts = np.cumsum(sizes[members]) - sizes[members]
        a, b = [], []
        for i in np.flatnonzero(apart) if len(members) else ():
            own = flat[ends[i] - sizes[i] : ends[i]]
            marked[own] = True
            common = np.add.reduceat(marked[places].astype(np.int64), starts)
            marked[own] = False
            for j in members[common * 100 >= (sizes[i] + sizes[members] - common) * threshold]:
                if components_of[i] != components_of[j]:
                    a.append(nodes[i])
                    b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _links_in_blocks(here: DataFrame, sets: DataFrame, threshold: int, block: int = 256) -> DataFrame:
    """(a, b): the links in these buckets between different components. Nodes outside the largest
    component of their bucket are held against all nodes of the bucket, ``block`` by ``block``."""
    by_component = here.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held"))
    main = stage(by_component.groupBy("bucket").agg(F.max(F.struct("held", "component")).alias("main"), F.sum("held").alias("all")), "main-components")
    rows = here.join(main, "bucket").withColumn("outside", F.col("component") != F.col("main.component"))
    blocks = {False: F.ceil(F.col("all") / block), True: F.ceil((F.col("all") - F.col("main.held")) / block)}
    dealt = []
    for apart, source in ((False, rows), (True, rows.where("outside"))):  # a node outside is in both roles
        own = F.pmod(F.xxhash64("node"), blocks[apart])
        other = F.explode(F.sequence(F.lit(0).cast("long"), blocks[not apart] - 1))
        placed = source.select("bucket", "node", "component", F.lit(apart).alias("apart"), own.alias("own"), other.alias("other"))
        dealt.append(placed.select("bucket", "node", "component", "apart", *(F.col(c).alias(n) for c, n in zip(("own", "other") if apart else ("other", "own"), ("x", "y")))))
    with_sets = dealt[0].unionByName(dealt[1]).join(sets, "node").select("bucket", "x", "y", "node", "component", "apart", "shingles")
    found = with_sets.groupBy("bucket", "x", "y").applyInArrow(_block_links(threshold), "a binary, b binary")
    return _ordered(found, "a", "b")


def _ordered(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80, bands: int = 32, rows: int = 5, pivot_rounds: int = 2
) -> DataFrame:
    """One row per input row: doc_id, mark, n_shingles, component, component_id, kept.

    Rows are linked if 100 * intersection >= threshold * union of their sets of ``size``-word
    shingles; component_id is the smallest id that links reach. Texts with equal sets are linked,
    except empty sets (null, empty or blank texts), which are linked with nothing: their
    component_id is their own id. kept: doc_id = component_id; rows that repeat an id are kept or
    dropped together; a null id is never the smallest, and a component of null ids only has
    component_id null and kept false. mark is xxhash64 of the text; component names the component by a digest, null for an empty set. Very long
    texts have all their shingles. An empty table gives an empty table; other columns are ignored.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), F.encode(text, "UTF-8").alias("text"))
    signed = stage(
        map_arrow(spread(base), _sign(size, bands, rows), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, mark long, n long, node binary, bands array<long>"),
        "signatures",
    )
    classes = stage(
        signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "mark")).alias("of"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")),
        "classes",
    )
    # Buckets of one class are of no use.
    member = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = stage(member.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("bucket"), "shared-buckets")
    open_rows = stage(member.join(shared, "bucket", "left_semi"), "bucket-rows")
    wanted = stage(open_rows.select("node").distinct().join(classes.select("node", F.col("of.doc_id").alias("w_id"), F.col("of.mark").alias("w_mark")), "node"), "wanted-texts")
    # Only their texts are shuffled to meet them, and few others.
    found = perhaps_in(base, ["doc_id", "mark"], wanted, ["w_id", "w_mark"]).join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("node", "text")
    sets = stage(map_arrow(found, _set_rows(size), "node binary, shingles array<long>").dropDuplicates(["node"]), "sets")

    links = compared = None
    labels = None
    for turn in range(pivot_rounds + 1):
        here = open_rows
        if labels is not None:
            here = here.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            here = here.withColumn("component", F.col("node"))
        # The first pivot is the same node in all buckets of a group, so its pairs repeat and are few.
        drawn = F.xxhash64("node", "bucket", F.lit(turn)) if turn else F.lit(0).cast("long")
        pivot = here.groupBy("bucket").agg(F.min(F.struct(drawn.alias("drawn"), "node", "n", "component")).alias("pivot"), F.min("component").alias("x"), F.max("component").alias("y"))
        # A written table, so that the join shuffles both sides and can split a bucket of many rows.
        pivot = stage(pivot.where("x != y").select("bucket", "pivot"), "pivots")
        rest = stage(here.join(pivot, "bucket").where("node != pivot.node"), "open-rows")
        if rest.isEmpty():
            break
        if turn == pivot_rounds:
            new = stage(_links_in_blocks(here.join(rest.select("bucket").distinct(), "bucket", "left_semi"), sets, threshold), "links")
            links = new if links is None else links.unionByName(new)
            labels = stage(components(links, "a", "b"), "labels")
            break
        pairs = _ordered(
            rest.select("node", "n", "component", F.col("pivot.node").alias("p"), F.col("pivot.n").alias("m"), F.col("pivot.component").alias("c"))
            .where((F.col("component") != F.col("c")) & _close("n", "m", threshold)),
            "node", "p",
        )
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        new = stage(_verified(pairs, sets, threshold), "links")
        compared = pairs if compared is None else compared.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        labels = stage(components(links, "a", "b"), "labels")
        open_rows = rest.select("node", "n", "bucket")

    if labels is None:
        named = classes.withColumn("component", F.col("node"))
    else:
        named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.select("node", "low", "component")
    lowest = stage(named.groupBy("component").agg(F.min("low").alias("component_id")), "lowest-ids")
    by_node = named.join(lowest, "component").select("node", "component", "component_id")
    joined = signed.join(by_node, "node", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return joined.select("doc_id", "mark", F.col("n").alias("n_shingles"), "component", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
