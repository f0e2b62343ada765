"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment (operator 8).

An item's n-grams are runs of three words (two or one for a short item). With a similarity of at least
the threshold, so many words at most are changed, dropped or put in, and each of them spoils n runs
at most; so of any ``spoiled + 1`` runs a copy keeps one. The seeds of an item are its rarest runs in
the documents, that many and one more: a copy keeps two of them, at shifts (place in the text less
place in the item) that differ by no more than the edits. Which runs are rare decides the cost
only: no copy is lost, however many documents hold the passage.

The alignment is scored by matches less threshold times columns, so its best score is at least zero if and only
if some alignment reaches the threshold. Whether a pair is contaminated depends on its two texts alone, and
words copied besides a copy never clear it. Items of the same words are sought once.

The documents' n-grams are tested in place against a bitmap of fixed size (2 MB, made from all runs
with two bits each), so only n-grams that are most likely an item's leave their task; the join with the
seeds is exact. A larger benchmark makes the bitmap less selective, never wrong.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BITS, bit_parts, map_arrow, perhaps_in, spread, stage, text_of
from .minhash import _Known, _mix64

WORD = re.compile(r"\w+")
U = np.uint64
_known = _Known()


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter((_known[w.encode()] for w in words), U, len(words))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; n is part of the hash."""
    h = np.full(max(0, len(w) - n + 1), n, U)
    for j in range(n if len(h) else 0):
        h = h * U(0x9E3779B97F4A7C15) + _mix64(w[j : j + len(h)] + U(j))
    return _mix64(h)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U(40)).astype(np.int64), ((h >> U(13)) & U((1 << BITS) - 1)).astype(np.int64)


def seed_plan(n: int, threshold: float, longest: int = 3) -> tuple[int, int, int]:
    """Of an item of n words: the size of its runs, how many of the rarest are seeds, and how many seeds
    a copy keeps at least (two, or one where two can't be promised)."""
    changes = range(int((1 - threshold) * n + 1e-9) + 1)
    for size in range(min(longest, n), 0, -1):
        # A word changed or dropped spoils size runs, one put in spoils those across it.
        spoiled = max(size * d + (size - 1) * max(0, int((n - d) / threshold - n + 1e-9)) for d in changes)
        kept = n - size + 1 - spoiled
        if kept > 0:
            return size, spoiled + min(2, kept), min(2, kept)
    raise ValueError("a threshold above 0 is needed")


def _item_rows(threshold: float, longest: int):
    """Items: their words, the plan of their seeds, and all their runs of the size planned."""

    def run(batches):
        for batch in batches:
            words = [word_hashes(t) for t in batch.column("text").to_pylist()]
            plans = [seed_plan(len(w), threshold, longest) if len(w) else (1, 0, 0) for w in words]
            runs = [grams(w, size).view(np.int64) for w, (size, *_) in zip(words, plans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), *(pa.array(x, pa.list_(pa.int64())) for x in ([w.view(np.int64) for w in words], runs)), *(pa.array(x, pa.int32()) for x in zip(*plans))],
                names=["item_id", "words", "runs", "size", "take", "need"],
            )

    return run


def _hit_rows(sizes: tuple[int, ...], packed: bytes):
    def run(batches):
        bitmap = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            own, pos, gram = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                w = word_hashes(t)
                for n in sizes:
                    h = grams(w, n)
                    a, b = _bits(h)
                    at = np.flatnonzero(bitmap[a])
                    at = at[bitmap[b[at]]]
                    if len(at):
                        own.append(np.full(len(at), i))
                        pos.append(at)
                        gram.append(h[at].view(np.int64))
            if own:
                own = np.concatenate(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(own)), batch.column("mark").take(pa.array(own)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(gram))],
                    names=["doc_id", "mark", "pos", "gram"],
                )

    return run


def align(item: np.ndarray, part: np.ndarray, threshold: float = 0.8) -> tuple[int, int, int, int, int]:
    """Smith-Waterman: (score, matches, columns, start, stop in part) of the local alignment with the best
    score. columns counts the item's words outside the alignment too, as dropped ones. A column is worth
    1 - threshold if it matches and -threshold if not, in whole numbers, so the score is at least 0 exactly if
    the similarity, matches by columns, of some alignment is at least the threshold; of equal scores the
    one that ends first. Each cell carries its alignment's matches, columns and start along, so two
    rows are all that is held, however long the item."""
    share = Fraction(threshold).limit_denominator(10_000)
    lost, won = -share.numerator, share.denominator - share.numerator
    n, m = len(item), len(part)
    ramp = np.arange(m + 1)
    # score, matches, columns, start in part: an alignment may begin anywhere in the text
    row = np.stack([ramp * 0, ramp * 0, ramp * 0, ramp])
    for i in range(1, n + 1):
        hit = np.concatenate(([False], part == item[i - 1]))
        diagonal = np.concatenate((row[:, :1], row[:, :-1]), axis=1) + np.stack([np.where(hit, won, lost), hit, ramp * 0 + 1, ramp * 0])
        up = row + np.array([[lost], [0], [1], [0]])
        new = np.where(diagonal[0] >= up[0], diagonal, up)
        new[:, 0] = up[:, 0]
        # Gaps along the row: the best cell to the left, less what each step costs.
        reach = new[0] - lost * ramp
        source = np.maximum.accumulate(np.where(reach == np.maximum.accumulate(reach), ramp, 0))
        row = new[:, source]
        row[0] += lost * (ramp - source)
        row[2] += ramp - source
    at = int(np.argmax(row[0]))
    return (*(int(x) for x in row[:, at]), at)


def _slack(n):
    """How far the shifts of an item of n words may differ within one copy; n may be a column."""
    return (F.floor(n / 4) if isinstance(n, Column) else n // 4) + 2


def _regions(shifts: list[int], n: int, total: int) -> list[tuple[int, int]]:
    """Where in a text of total words the item of n words may lie, for seeds at these shifts."""
    slack, out = _slack(n), []
    for s in sorted(shifts):
        a, b = max(0, s - slack), min(total, s + n + slack)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _align_rows(threshold: float, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, mark, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text", "items"))):
                w = word_hashes(text)
                for x in items:
                    item, best = np.array(x["words"], np.int64).view(U), None
                    for a, b in _regions(x["shifts"], len(item), len(w)):
                        part = w[a:b]
                        if np.isin(item, part).sum() < threshold * len(item):
                            continue
                        score, matches, columns, start, stop = align(item, part, threshold)
                        if score >= 0 and (best is None or score > best[0]):
                            best = (score, matches / columns, a + start, a + stop)
                    if best:
                        rows.append((doc, mark, x["item"], *best))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "mark", "item", "score", "similarity", "start_word", "stop_word"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    longest_seed: int = 3, threshold: float = 0.8, items_a_row: int = 256,
) -> DataFrame:
    """The contaminated pairs: doc_id, mark, item_id, score, similarity, start_word, stop_word.

    A pair is contaminated if some local alignment of the item's words in the text has a similarity
    (matches by alignment columns, the item's unaligned words counted) of ``threshold`` or more. The row
    tells of the alignment with the best score: see align. Words are runs of letters, digits and _, in lower case. mark is xxhash64 of the text, null
    as empty; rows that repeat id and text count once. Texts or items without words match nothing;
    items that repeat an id are aligned each, the most similar stays; items of the same words are all told. A very long text is read whole, and
    aligned only where seeds lie; one that holds very many items is aligned with about ``items_a_row``
    of them at a time. An empty table on either side gives an empty table. Null ids are kept as
    ids. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    entries = benchmark.select(F.col(item_col).alias("item_id"), text_of(item_text_col).alias("text"))
    id_kind, item_kind = base.schema["doc_id"].dataType, entries.schema["item_id"].dataType
    entered = stage(map_arrow(entries, _item_rows(threshold, longest_seed), f"item_id {item_kind.simpleString()}, words array<long>, runs array<long>, size int, take int, need int").where(F.size("words") > 0), "entries")
    plan = [F.first(c).alias(c) for c in ("runs", "size", "take", "need")]  # follow from the words
    items = stage(entered.groupBy("words").agg(*plan).withColumn("item", F.monotonically_increasing_id()), "items")
    ids = stage(entered.select("item_id", "words").distinct().join(items.select("item", "words"), "words").select("item", "item_id"), "item-ids")
    runs = items.select("item", F.size("words").alias("n"), "take", "need", F.posexplode("runs").alias("at", "gram"))
    bits = runs.select(F.explode(F.array(F.shiftrightunsigned("gram", 64 - BITS), F.shiftrightunsigned("gram", 13).bitwiseAND(F.lit((1 << BITS) - 1)))).alias("bit"))
    packed = bytearray(1 << (BITS - 3))
    for r in bit_parts(bits).collect():  # 2 MB at most
        packed[r["bucket"] * 4096 : r["bucket"] * 4096 + len(r["part"])] = r["part"]
    sizes = tuple(r["size"] for r in items.select("size").distinct().collect())  # longest_seed rows at most
    id_type = id_kind.simpleString()
    hits = stage(map_arrow(spread(base), _hit_rows(sizes, bytes(packed)), f"doc_id {id_type}, mark long, pos int, gram long").distinct(), "seed-hits")
    held = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("held", F.lit(0)), F.xxhash64("gram"), "at")
    ranked = runs.join(held, "gram", "left").withColumn("rank", F.row_number().over(rarest))
    # A written table, so that the next join shuffles both sides and can split a passage that very many
    # documents hold.
    seeds = stage(ranked.where("rank <= take").select("item", "n", "need", "gram", "at"), "seeds")
    at_shift = hits.join(seeds, "gram").groupBy("doc_id", "mark", "item", "n", "need", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("held"))
    found_at = at_shift.groupBy("doc_id", "mark", "item", "n", "need").agg(F.sort_array(F.collect_list(F.struct("shift", "held"))).alias("all"))
    # In sorted order, a shift's nearest ones are its neighbours; a missing neighbour compares as null.
    near = lambda x, j: F.coalesce(F.abs(F.get("all", j)["shift"] - x["shift"]) <= _slack(F.col("n")), F.lit(False))
    kept = F.filter("all", lambda x, i: (x["held"] >= F.col("need")) | near(x, i - 1) | near(x, i + 1))
    pairs = found_at.select("doc_id", "mark", "item", F.transform(kept, lambda x: x["shift"]).alias("shifts")).where(F.size("shifts") > 0)
    # The items of a document in blocks: one that holds a whole benchmark is several rows.
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("doc_id", "mark")) / items_a_row)
    with_words = pairs.join(items.select("item", "words"), "item").withColumn("block", F.pmod(F.xxhash64("item"), blocks))
    by_doc = stage(with_words.groupBy("doc_id", "mark", "block").agg(F.collect_list(F.struct("item", "words", "shifts")).alias("items")), "candidates").select(
        F.col("doc_id").alias("c_id"), F.col("mark").alias("c_mark"), "items"
    )
    # Only texts with candidates are shuffled to meet them, and few others.
    texts = perhaps_in(base, ["doc_id", "mark"], by_doc, ["c_id", "c_mark"])
    joined = texts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark"))).select("doc_id", "mark", "text", "items")
    found = map_arrow(joined, _align_rows(threshold, to_arrow_type(id_kind)), f"doc_id {id_type}, mark long, item long, score long, similarity double, start_word long, stop_word long")
    best = found.join(ids, "item").groupBy("doc_id", "mark", "item_id").agg(F.max(F.struct("similarity", "score", "start_word", "stop_word")).alias("b"))
    return best.select("doc_id", "mark", "item_id", "b.score", "b.similarity", "b.start_word", "b.stop_word")
