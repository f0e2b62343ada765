"""Spelling variant grouping: words that differ by one edit (operator 12).

Two-dimensional range reporting. The words of a length T are a permutation: in order of their letters
from the front, and of their letters from the back. A word with one letter replaced, or put in, at
place i has all words between a prefix of i letters and a suffix of T - 1 - i letters as neighbours: those in an
interval of the forward order and in one of the reverse order. A wavelet tree over the permutation
reports them, for all queries of a length and place at once.

One edit leaves a half of the word as it is. So words meet in cells of (half, T, its letters): a word
of length T lies in the cells of its two halves, and words of T and T - 1 ask there for edits in the
other half. Many small cells make a shard. A half that very many words share is dealt into a grid of cells
of bounded size: its words by one hash, those that ask by another.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship, spread, stage, text_of

#: Counters that a task holds, characters of a text that are split at once.
HELD, PIECE = 400_000, 1 << 22
#: Latin-1 characters of a run as they are, A-Z in lower case; all others as a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str):
    """The runs of letters of a text in Latin-1 bytes, a list for each piece of it; no run is cut."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def _word_rows(every: int, least: int):
    def run(batches):
        counts: Counter = Counter()

        def told():
            for i in range(0, len(counts), 50_000):
                keys = list(counts)[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k.decode("latin-1") for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                own: Counter = Counter()
                for some in runs(text):
                    own.update(some)
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in own.items():
                    if len(word) >= least:
                        h = zlib.crc32(_utf8(word), start)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        counts[word] += n
            if len(counts) > HELD:
                yield from told()
        yield from told()

    return run


class Wavelet:
    """A permutation of 0 .. n - 1, level by level from the highest bit: at each level the elements lie
    sorted by the bits above, and zeros[i] says how many of the first i have a 0 here."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = []
        for bit in range(max(1, (len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(~ones)))))
            values = np.concatenate((values[~ones], values[ones]))

    def report(self, start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value): the values from low to high among the elements from start to stop, of each
        query; ends are exclusive."""
        query, value = np.arange(len(start)), np.zeros(len(start), np.int64)
        for bit, zeros in self.levels:
            a, b, total = zeros[start], zeros[stop], zeros[-1]
            query, value = np.tile(query, 2), np.concatenate((value, value + (1 << bit)))
            start, stop = np.concatenate((a, total + start - a)), np.concatenate((b, total + stop - b))
            keep = (start < stop) & (value < high[query]) & (value + (1 << bit) > low[query])
            query, value, start, stop = query[keep], value[keep], start[keep], stop[keep]
        return query, value


def _letters(words: list[str], length: int) -> np.ndarray:
    """(words, length) code points."""
    return np.array(words, f"<U{max(1, length)}").view(np.uint32).reshape(len(words), max(1, length))


def _text(letters: np.ndarray) -> np.ndarray:
    """Rows of code points as strings of that length."""
    return np.ascontiguousarray(letters).view(f"<U{letters.shape[1]}").ravel()


def _span(order: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted rows of code points those lie that begin with each row sought."""
    k = sought.shape[1]
    if not k:
        return np.zeros(len(sought), np.int64), np.full(len(sought), len(order))
    beginnings, wanted = _text(order[:, :k]), _text(sought)
    return np.searchsorted(beginnings, wanted, "left"), np.searchsorted(beginnings, wanted, "right")


def variants(words: list[str], askers: list[str], length: int, places: range) -> tuple[np.ndarray, np.ndarray]:
    """(index of asker, index of word): the words, all different and of this length, that come of an asker
    by replacing a letter (askers of the same length) or putting one in (one less) at one of the
    places. An asker is no variant of itself; each pair is told once."""
    letters = _letters(words, length)
    forward = np.argsort(_text(letters), kind="stable")
    backward = np.argsort(_text(letters[:, ::-1]), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[backward] = np.arange(len(words))
    tree = Wavelet(rank[forward])
    front, back = letters[forward], letters[backward][:, ::-1]
    found = [(np.zeros(0, np.int64),) * 2]
    for size in (length, length - 1):
        mine = np.flatnonzero(np.fromiter(map(len, askers), np.int64, len(askers)) == size)
        if not len(mine):
            continue
        asked = _letters([askers[i] for i in mine], size)
        for i in places:
            start, stop = _span(front, asked[:, :i])
            low, high = _span(back, asked[:, ::-1][:, : length - 1 - i])
            some = np.flatnonzero((start < stop) & (low < high))
            query, value = tree.report(start[some], stop[some], low[some], high[some])
            query, word = some[query], backward[value]
            if size == length:
                keep = (letters[word] != asked[query]).any(axis=1)
            else:
                # A letter put in beside its like may stand at several places: the last one counts.
                keep = letters[word, i] != letters[word, i + 1] if i + 1 < length else np.ones(len(word), bool)
            found.append((mine[query[keep]], word[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _shard_rows(key, table):
    """Pairs (word, near, near_n) of a shard. All its words of one length share a tree: prefix and suffix
    hold the half that the edit leaves, so only words of one cell meet. The cells of a grid have trees of their own."""
    rows = table.to_pydict()
    cells: dict[tuple, tuple[list, list]] = {}
    for i, (length, tail, part, cell) in enumerate(zip(*(rows[c] for c in ("length", "tail", "part", "cell")))):
        cells.setdefault((length, tail, part if cell else 0, cell), ([], []))[rows["asks"][i]].append(i)
    out: list[list] = [[], [], []]
    for (length, tail, *_), (held, asking) in cells.items():
        if not held or not asking:
            continue
        half = length // 2
        a, b = variants([rows["word"][i] for i in held], [rows["word"][i] for i in asking], length, range(half) if tail else range(half, length))
        for x, y in zip(np.array(asking)[a].tolist(), np.array(held)[b].tolist()):
            word, near = rows["word"][x], rows["word"][y]
            told = [(word, near, rows["n"][y])]
            if len(word) != len(near):  # only the shorter one asks
                told.append((near, word, rows["n"][x]))
            for column, values in zip(out, zip(*told)):
                column += values
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least: int = 6) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z and U+00C0 to U+00FF) of at least ``least`` code points in
    whole texts, A-Z in lower case. Of the runs whose crc32 of ``<id>:<run>`` ``every`` divides, the code
    point at crc32 mod length is left out. A null id is written as nothing, a null text has no runs."""
    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), text_of(text_col).alias("text"))
    told = map_arrow(spread(named), _word_rows(every, least), "word string, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame, shard_rows: int = 60_000, cell_rows: int = 100_000, least_rows: int = 2_000) -> DataFrame:
    """word, near, near_n of every two words (word, n; all different, not null) that differ by exactly one
    inserted, deleted or replaced code point, each from both sides. shard_rows: about how many rows a task
    gets (least_rows: where there are few); cell_rows: about how many words of one half a cell holds."""
    spark = words.sparkSession
    ship(spark)
    length = F.length("word")
    roles = [(target, tail, asks) for tail in (False, True) for target, asks in ((0, False), (0, True), (1, True))]
    each = words.select("word", "n", F.explode(F.array(*(F.struct((length + t).alias("length"), F.lit(tail).alias("tail"), F.lit(a).alias("asks")) for t, tail, a in roles))).alias("r")).select("word", "n", "r.*")
    half = F.floor(F.col("length") / 2).cast("int")
    # The half that the edit leaves: the first letters, or as many of the last as follow them.
    part = F.when(F.col("tail"), F.substring("word", F.length("word") - (F.col("length") - half) + 1, 1 << 30)).otherwise(F.substring("word", F.lit(1), half))
    keyed = stage(each.withColumn("part", F.xxhash64("length", "tail", part)), "halves")
    grid = stage(keyed.where("NOT asks").groupBy("part").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("m")).where("m > 1"), "hot-halves")
    m = F.coalesce("m", F.lit(1))
    # A word lies in a row of the grid, an asker in a column; they meet in one cell. Without a grid the cell is 0.
    mine, others = F.pmod(F.xxhash64("word"), m).cast("int"), F.sequence(F.lit(0), m - 1)
    at = F.transform(others, lambda x: F.when(F.col("asks"), x * m + mine).otherwise(mine * m + x) + F.when(m > 1, 1).otherwise(0))
    dealt = keyed.join(grid, "part", "left").select("word", "n", "length", "tail", "asks", "part", F.explode(at).alias("cell"))
    rows = keyed.count()
    shards = max(1, -(-rows // shard_rows), min(2 * spark.sparkContext.defaultParallelism, rows // least_rows))
    placed = dealt.withColumn("shard", F.pmod(F.xxhash64("part", "cell"), F.lit(shards))).repartition(shards, "shard")
    return placed.groupBy("shard").applyInArrow(_shard_rows, "word string, near string, near_n long")


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root of every word (word, form) that has a form: each round doubles how far roots reach."""
    known = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return known


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = 5, ratio: int = 5, **how) -> DataFrame:
    """word, n, n_near, form, form_n, root: the words of at least ``least_n`` occurrences (see word_counts).

    n_near counts the words that differ by exactly one inserted, deleted or replaced code point; form is
    the one of them with the largest n (ties: the smallest in code-point order) if that is at least ``ratio``
    times the word's own, or else null; root is where forms lead in the end, the word itself without
    one. Null and empty texts have no words; very long texts are read whole, in pieces; a row that
    repeats counts again; an empty table gives an empty table. Other columns are ignored. No word, cell or
    candidate is capped.
    """
    words = stage(word_counts(docs, id_col, text_col, **how).where(F.col("n") >= least_n), "words")
    best = F.min_by(F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")), F.struct((-F.col("near_n")).alias("k"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("b.form_n") >= ratio * F.col("n"), F.col("b")).alias("b"))
    placed = stage(joined.select("word", "n", "n_near", "b.form", "b.form_n"), "forms")
    roots = _rooted(placed.where("form IS NOT NULL").select("word", "form"))
    return placed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
