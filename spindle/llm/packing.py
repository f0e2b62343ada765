"""Best-fit packing by the linear grouping scheme (operator 4).

Every token sequence holds ``capacity`` tokens. Piece lengths are integers up to the capacity, so
the histogram of lengths (``capacity`` rows at most, whatever the input) is all that the plan needs:

1. large lengths (above ``small``) are sorted and dealt into ``groups`` groups of equal cardinality,
   and each is rounded up to the largest of its group;
2. for these few sizes, all configurations of one sequence are listed (at most three large pieces
   fit) and a linear program chooses how often each is used, so that the fewest sequences hold all
   large pieces and, in what room is left, the volume of the small ones;
3. actual lengths take the places of the rounded ones; the last place of a sequence goes to the
   longest piece that fits the actual room, which leaves a shorter one for the place that was its own;
4. a part of each configuration is used, then the lengths that are left are grouped anew, a few times;
5. what is left and the small pieces go where they fit best, the longest first, then into new sequences.

How large a part, and how often, is tried in a few ways, of which the one with the fewest sequences is
taken. Lengths that are few enough for a size each are not rounded; their program is used whole and once.

The plan is a list of runs: pieces of one length, from one rank to another, go to as many sequences
in a row, at one offset. A piece finds its place from its length and its rank among its length, which
is its rank in its own task plus the number in the tasks before. No row meets all others anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, spread, stage, text_of
from .encoding import END_ID, encoder


#: How large a part of a configuration is used at a time (one in so many), and in how many rounds.
WAYS = ((2, 6), (4, 6), (4, 2))


def rounded(large: list[tuple[int, int]], groups: int) -> tuple[list[int], list[int]]:
    """The sizes, descending, and how many pieces each stands for. large: (length, count), longest first;
    they are dealt into groups of equal cardinality, each of the size of its first length. So few lengths
    that each can be a size of its own are not rounded."""
    if len(large) <= groups:
        return [x for x, _ in large], [n for _, n in large]
    each, sizes, counts, room = max(1, -(-sum(n for _, n in large) // groups)), [], [], 0
    for length, n in large:
        while n:
            if not room:
                room = each
                if not sizes or sizes[-1] != length:
                    sizes.append(length)
                    counts.append(0)
            m = min(n, room)
            counts[-1] += m
            n, room = n - m, room - m
    return sizes, counts


def _listed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """All configurations: places in sizes, ascending, padded with len(sizes); and the room that is left."""
    n, rows, used = len(sizes), [np.arange(len(sizes))[:, None]], [sizes]
    while len(rows[-1]):
        last = rows[-1][:, -1]
        base = np.repeat(np.arange(len(last)), n - last)
        more = np.concatenate([np.arange(i, n) for i in last])
        total = used[-1][base] + sizes[more]
        fits = total <= capacity
        rows.append(np.column_stack((rows[-1][base[fits]], more[fits])))
        used.append(total[fits])
    most = rows[-2].shape[1]
    return np.concatenate([np.pad(r, ((0, 0), (0, most - r.shape[1])), constant_values=n) for r in rows[:-1]]), capacity - np.concatenate(used[:-1])


def configurations(sizes: list[int], counts: list[int], volume: int, capacity: int) -> list[tuple[list[int], float]]:
    """[(sizes in one sequence, how many such sequences)]: a basic solution of the linear program that
    uses the fewest sequences for counts of sizes and a volume of small pieces. Revised simplex, with
    the configuration of the largest value at the current prices entering."""
    n, rows = len(sizes), len(sizes) + 1
    places, left = _listed(np.array(sizes), capacity)
    demand, room = np.array([*counts, volume / capacity]), left / capacity
    # At first each size is by itself, as often as it fits, and the volume has sequences of its own.
    basis, cost = np.diag([*(float(capacity // s) for s in sizes), 1.0]), np.ones(rows)
    chosen: list[list[int]] = [[s] * (capacity // s) for s in sizes] + [[]]
    x = np.linalg.solve(basis, demand)
    for _ in range(100 * rows):  # a bound against cycling; every step's solution can be used
        price = np.linalg.solve(basis.T, cost)
        value = np.append(price[:n], 0.0)[places].sum(axis=1) + price[n] * room
        enter, spare = int(value.argmax()), int(price.argmin())
        if max(value[enter] - 1, -price[spare]) < 1e-9:
            break
        column = np.zeros(rows)
        if value[enter] - 1 >= -price[spare]:
            used = [int(i) for i in places[enter] if i < n]
            np.add.at(column, used, 1)
            column[n], own, paid = room[enter], [sizes[i] for i in used], 1.0
        else:  # more of a size than there is
            column[spare], own, paid = -1.0, [], 0.0
        step = np.linalg.solve(basis, column)
        ratio = np.full(rows, np.inf)
        np.divide(np.maximum(x, 0), step, out=ratio, where=step > 1e-9)
        leave = int(ratio.argmin())
        if ratio[leave] == np.inf:
            break
        x -= ratio[leave] * step
        x[leave], basis[:, leave], chosen[leave], cost[leave] = ratio[leave], column, own, paid
    return [(own, float(v)) for own, v in zip(chosen, x) if own and v > 0]


#: length, rank from, rank to, first sequence, offset
Runs = list[tuple[int, int, int, int, int]]


class _Plan:
    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.placed: dict[int, int] = {}  # by length, the ranks given away
        self.runs: Runs = []

    def open(self, n: int) -> tuple[int, int, int]:
        """A class of n new sequences: (first, number, tokens used)."""
        self.sequences += n
        return (self.sequences - n, n, 0)

    def put(self, length: int, n: int, kind: tuple[int, int, int]) -> tuple[tuple[int, int, int], tuple[int, int, int] | None]:
        """Put a piece into each of the first n sequences of a class; what becomes of both parts."""
        first, size, used = kind
        rank = self.placed.get(length, 0)
        self.placed[length] = rank + n
        self.runs.append((length, rank, rank + n, first, used))
        return (first, n, used + length), (first + n, size - n, used) if size > n else None


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = 64, small: int = 256) -> tuple[Runs, int]:
    """The runs for a histogram of piece lengths, and the number of sequences."""
    if 4 * (small + 1) <= capacity:
        raise ValueError("more than three large pieces would fit into a sequence: small is too small")
    exact = sum(x > small for x, n in histogram.items() if n) <= groups
    return min((_one_plan(histogram, capacity, groups, small, *way) for way in WAYS[: 1 if exact else None]), key=lambda p: p[1])


def _one_plan(histogram: dict[int, int], capacity: int, groups: int, small: int, part: int, rounds: int) -> tuple[Runs, int]:
    p, left = _Plan(capacity), {x: n for x, n in histogram.items() if n}
    room: dict[int, list[tuple[int, int, int]]] = {}
    rooms: list[int] = []  # the keys of room, ascending

    def offer(kind: tuple[int, int, int]) -> None:
        free = capacity - kind[2]
        if free not in room:
            room[free] = []
            insort(rooms, free)
        room[free].append(kind)

    for _ in range(rounds):
        lengths = sorted(x for x in left if x > small)
        if not lengths:
            break
        exact = len(lengths) <= groups
        sizes, counts = rounded([(x, left[x]) for x in reversed(lengths)], groups)
        volume = sum(x * n for x, n in left.items() if x <= small) - sum(free * n for free, kinds in room.items() for _, n, _ in kinds)
        chosen = configurations(sizes, counts, max(volume, 0), capacity)
        # Full sequences first, while there is a choice of lengths.
        for own, times in sorted(chosen, key=lambda c: (capacity - sum(c[0]) > small, -len(c[0]))):
            times = int(times + 1e-6) if exact else int(times / part)
            kinds = [p.open(times)] if times else []
            for nth, size in enumerate(own):
                fill = len(own) > 1 and nth == len(own) - 1 and capacity - sum(own) <= small
                after = []
                for kind in kinds:
                    rest: tuple[int, int, int] | None = kind
                    while rest:
                        # There is always one left that is no longer than the size.
                        at = bisect_right(lengths, capacity - rest[2] if fill else size) - 1
                        length = lengths[at]
                        m = min(left[length], rest[1])
                        left[length] -= m
                        if not left[length]:
                            del left[length], lengths[at]
                        done, rest = p.put(length, m, rest)
                        after.append(done)
                kinds = after
            for kind in kinds:
                offer(kind)
        if exact:
            break
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                offer(p.open(-(-n // (capacity // length))))
                continue
            free = rooms[at]
            kind = room[free].pop()
            if not room[free]:
                del room[free], rooms[at]
            m = min(n, kind[1])
            n -= m
            for x in p.put(length, m, kind):
                if x:
                    offer(x)
    return p.runs, p.sequences


def _pieces(path: str, capacity: int, id_type: pa.DataType):
    def run(batches):
        end, task = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for d, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).batch(batch.column("text").to_pylist())):
                data = memoryview(ids + end)
                n, at, k = len(data) // 4, 0, 0
                while at < n:
                    m = (n - at) % capacity or capacity
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(m)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + m)]))
                    nth.append(seen[m])
                    seen[m] += 1
                    at, k = at + m, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(doc), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return run


def _place(runs: Runs):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shift = 1 << 48

    def run(batches):
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, groups: int = 64, small: int = 256) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end id 2. One of more than ``capacity`` ids is cut so that all pieces
    but the first are full. A null text counts as empty: one piece of one id. Rows that repeat, or
    share an id (null too), are packed each on their own. An empty table gives an empty table.
    Other columns are ignored. Full pieces have a sequence each, numbered below zero. A very long text
    is many full pieces and one that is shorter; its ids are held in one task only.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    columns = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    pieces = stage(map_arrow(spread(rows), _pieces(tokenizer_path, capacity, to_arrow_type(kind)), f"{columns}, task int, nth long"), "pieces")
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.shiftleft(F.col("task").cast("long"), 40) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = pieces.where(F.col("length") < capacity)
    by_task = part.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity - 1 rows at most
    runs, _ = plan(histogram, capacity, groups, small)
    ranked = part.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = map_arrow(ranked, _place(runs), f"{columns}, sequence_id long, offset long")
    return placed.unionByName(full)
