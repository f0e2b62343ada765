"""Source divergence audit: how each source of a language uses words (operator 13).

Terms are counted per (lang, source) in one pass over whole texts. The pairs of sources of a language
are compared by sparse sums: a term that neither source has adds the same to a pair, so the sum starts
from that baseline times all terms; a term of one side only is corrected by a histogram of that
side's few different probabilities; only a term of both sides needs a correction of its own, made for blocks
of sources at once. The most typical terms of a group come from a radix select: histograms over 16
bits of the value at a time find the kth value, and ties are told apart by their UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, spread, stage, text_of

#: The scale of a probability, sources of a block, probabilities of a row of a histogram, counters that
#: a task holds, block matrices that a task holds, bytes of text that are split at once.
SCALE, BLOCK, CHUNK, HELD, MATRICES, PIECE = 1_000_000_000, 256, 4096, 400_000, 64, 1 << 22
#: Pairs of sources that are reckoned at once.
PAIRS = 1 << 18
#: Letters in lower case, bytes beyond ASCII as they are, all others as a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes):
    """The terms of a text in UTF-8, a list for each piece of it: no term is cut."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count_rows(batches):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("held", pa.int64())])
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def told():
        for (lang, source), (n, held) in counts.items():
            all_keys = list(n)
            for i in range(0, len(n), 20_000):
                keys = all_keys[i : i + 20_000]
                columns = [[lang] * len(keys), [source] * len(keys), keys, [n[k] for k in keys], [held[k] for k in keys]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, held = counts.setdefault((lang, source), (Counter(), Counter()))
            own = set()
            for some in terms(text):
                n.update(some)
                own.update(some)
            held.update(own)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from told()
    yield from told()


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


PARTIAL = "lang string, a int, b int, value long"


def _partial(lang: str, a, b, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


def _one_sided(batches):
    """Rows: some probabilities of a source with how many terms have each, against a block of sources. A
    row without probabilities stands for the baseline of all terms."""
    for batch in batches:
        for row in batch.to_pylist():
            others, bases = np.array(row["others"], np.int64), np.array(row["bases"], np.int64)
            p, n, own, base = np.array(row["p"], np.int64)[:, None], np.array(row["n"], np.int64)[:, None], row["a"], np.int64(row["base"])
            if not len(p):
                there = ((_f(base, bases) * row["v"]), np.zeros(len(bases), np.int64))
            else:
                there = ((n * (_f(p, bases) - _f(base, bases))).sum(axis=0), (n * (_f(bases, p) - _f(bases, base))).sum(axis=0))
            keep = others != own
            for value, forth in zip(there, (True, False)):
                one, other = np.full(keep.sum(), own), others[keep]
                yield _partial(row["lang"], *((one, other) if forth else (other, one)), value[keep])


def _runs(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of (slot, p, base): how long each is, and the three fields of all of them in a row."""
    items = column.flatten()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [items.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("slot", "p", "base")]


def _crossed(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the runs of one side and of the other, of lengths na and nb, for all pairs of each row."""
    a = np.repeat(np.arange(na.sum()), np.repeat(nb, na))
    widths = np.repeat(nb, na)
    within = np.arange(len(a)) - np.repeat(np.cumsum(widths) - widths, widths)
    return a, np.repeat(np.repeat(np.cumsum(nb) - nb, na), widths) + within


def _two_sided(batches):
    """Rows: a term's sources of one block and of another. Sums are kept for each pair of blocks; the pairs of many
    terms are reckoned at once, PAIRS of them and those of one term more at most."""
    sums: dict[tuple, np.ndarray] = {}

    def told():
        for (lang, i, j), m in sums.items():
            a, b = np.nonzero(m)
            if len(a):
                yield _partial(lang, a + i * BLOCK, b + j * BLOCK, m[a, b])
        sums.clear()

    def add(key: tuple, rows: pa.RecordBatch) -> None:
        (na, (slot, p, p0)), (nb, (slots, q, q0)) = _runs(rows.column("here")), _runs(rows.column("there"))
        a, b = _crossed(na, nb)
        there, p, p0, q, q0 = slot[a] * BLOCK + slots[b], p[a], p0[a], q[b], q0[b]
        more = _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)
        if key[1] == key[2]:
            more[slot[a] == slots[b]] = 0
        m = sums.setdefault(key, np.zeros((BLOCK, BLOCK), np.int64))
        np.add.at(m.reshape(-1), there, more)

    for batch in batches:
        blocks = zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j")))
        rows_of: dict[tuple, list[int]] = {}
        for n, key in enumerate(blocks):
            rows_of.setdefault(key, []).append(n)
        pairs = batch.column("here").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * batch.column("there").value_lengths().to_numpy(zero_copy_only=False)
        for key, rows in rows_of.items():
            rows = np.array(rows)
            part = np.cumsum(pairs[rows]) // PAIRS
            for some in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
                add(key, batch.take(pa.array(some)))
            if len(sums) > MATRICES:
                yield from told()
    yield from told()


def _probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exactly; 1 where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1), wide(total + kept))
    return F.when(kept > 0, share + 1).otherwise(F.lit(1)).cast("long")


def _cut(pending: DataFrame, group: list[str], digit: Column, first: Column) -> tuple[DataFrame, Column, Column]:
    """pending (.., need) with _digit, the deciding digit _cut of its group and _left, how many of that
    digit are still needed; the condition that a row is among the best together with all of its digit,
    or with its whole group; and the one that its digit is split. first: the order of digits, best first."""
    placed = pending.withColumn("_digit", digit)
    histogram = placed.groupBy(*group, "_digit").agg(F.count(F.lit(1)).alias("_n"), F.first("need").alias("_need"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deciding = histogram.withColumn("_before", before).where("_before < _need AND _before + _n >= _need")
    cut = stage(deciding.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_digit").alias("_cut"), (F.col("_need") - F.col("_before")).alias("_left"), (F.col("_before") + F.col("_n") == F.col("_need")).alias("_whole")), "cuts")
    joined = placed.join(cut, [placed[g] == cut[f"_{g}"] for g in group], "left")
    return joined, F.col("_cut").isNull() | ((F.col("_digit") == F.col("_cut")) & F.col("_whole")), (F.col("_digit") == F.col("_cut")) & ~F.col("_whole")


def radix_select(rows: DataFrame, group: list[str], value: str, item: str, limit: int) -> DataFrame:
    """Of each group the ``limit`` rows with the largest value (a long, not negative), ties to the smaller
    item by UTF-8 bytes. Columns of a group are not null; an item is once in a group.

    Each pass reads a written table of what is still undecided, counts its next digit per group with a
    partial aggregate, and joins the deciding digit back; no group is gathered or sorted."""
    columns = rows.columns
    pending, taken = rows.withColumn("need", F.lit(limit).cast("long")), []

    def narrow(digit: Column, falling: bool) -> bool:
        """One pass; tells whether all is decided."""
        nonlocal pending
        order = F.desc("_digit") if falling else F.asc("_digit")
        joined, whole, open_ = _cut(pending, group, digit, order)
        better = (F.col("_digit") > F.col("_cut")) if falling else (F.col("_digit") < F.col("_cut"))
        told = stage(joined.where(whole | better | open_).select(*columns, (~open_ | F.col("_cut").isNull()).alias("taken"), F.coalesce("_left", "need").alias("need")), "selected")
        taken.append(told.where("taken").select(*columns))
        pending = told.where("NOT taken").select(*columns, "need")
        return pending.isEmpty()

    for shift in (48, 32, 16, 0):
        if narrow(F.shiftright(value, shift).bitwiseAND(F.lit(0xFFFF)), True):
            break
    else:
        at, width = 0, 8
        while not narrow(F.substring(F.encode(item, "UTF-8"), at + 1, width), False):
            at, width = at + width, 2 * width
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, limit: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) that occurs, part ``pair`` ranks the
    other sources of the language by how far the group's word use is from theirs, and part ``term`` the
    group's own words (at most ``limit``) that are more frequent than in the whole language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case, in at least
    ``least_docs`` documents of the language. Null lang, source and text are empty strings; a group
    without terms is compared all the same; a language of one source has no pairs. A row is a document,
    repeated or not. Very long texts are read whole, in pieces. An empty table gives an empty table. All arithmetic is exact. Other
    columns are ignored.
    """
    named = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).cast("binary").alias("text"))
    told = map_arrow(spread(named), _count_rows, "lang string, source string, term string, n long, held long")
    # One shuffle by the term serves the counts and the window. The rows of a task hardly repeat, so none are added before it.
    # A term's rows are as many as the language has sources.
    counts = told.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    term = Window.partitionBy("lang", "term")
    everywhere = counts.select("*", F.sum("held").over(term).alias("_held"), F.sum("n").over(term).alias("all_n"), (F.row_number().over(term.orderBy("source")) == 1).alias("_first"))
    kept = stage(everywhere.where(F.col("_held") >= least_docs).drop("held", "_held"), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("_first").alias("v"))
    here = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "v"])
    lang = Window.partitionBy("lang")  # a row for each source
    groups = here.select("lang", "source", "n", F.sum("v").over(lang).alias("v"), F.sum("n").over(lang).alias("lang_n"), (F.row_number().over(lang.orderBy("source")) - 1).alias("at"))
    groups = stage(groups.withColumn("base", _probability(F.lit(0), F.col("n"), F.col("v"))), "groups")
    facts = groups.withColumnRenamed("n", "group_n")
    p, q = _probability(F.col("n"), F.col("group_n"), F.col("v")), _probability(F.col("all_n"), F.col("lang_n"), F.col("v"))
    placed = stage(kept.join(facts, ["lang", "source"]).select("lang", "source", "term", "at", "base", p.alias("p"), q.alias("q")), "probabilities")

    typical = placed.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    best = radix_select(typical, ["lang", "source"], "value", "item", limit).withColumn("part", F.lit("term"))

    # One side: the different probabilities of a source, in rows of CHUNK, against blocks of sources.
    histogram = placed.groupBy("lang", "at", "base", "p").agg(F.count(F.lit(1)).alias("n"))
    row = F.floor((F.row_number().over(Window.partitionBy("lang", "at").orderBy("p")) - 1) / CHUNK)
    some = histogram.withColumn("row", row).groupBy("lang", F.col("at").alias("a"), "base", "row").agg(F.collect_list(F.struct("p", "n")).alias("h"))
    some = some.select("lang", "a", "base", F.col("h.p").alias("p"), F.col("h.n").alias("n"), F.lit(0).cast("long").alias("v"))
    none = F.array().cast("array<long>")
    some = some.unionByName(groups.select("lang", F.col("at").alias("a"), "base", none.alias("p"), none.alias("n"), "v"))
    blocks = groups.groupBy("lang", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.collect_list(F.struct("at", "base")).alias("o")).select("lang", F.col("o.at").alias("others"), F.col("o.base").alias("bases"))
    one_sided = map_arrow(some.join(blocks, "lang"), _one_sided, PARTIAL)

    # Both sides: of each term the sources of a block that have it, against those of each block.
    slot = F.struct((F.col("at") % BLOCK).alias("slot"), "p", "base")
    holders = stage(placed.groupBy("lang", "term", F.floor(F.col("at") / BLOCK).alias("i")).agg(F.collect_list(slot).alias("here")), "holders")
    there = holders.select("lang", "term", F.col("i").alias("j"), F.col("here").alias("there"))
    two_sided = map_arrow(holders.join(there, ["lang", "term"]).select("lang", "i", "j", "here", "there"), _two_sided, PARTIAL)

    summed = one_sided.unionByName(two_sided).groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    name = lambda c: groups.select("lang", F.col("at").alias(c), F.col("source").alias(f"{c}_source"))
    pairs = summed.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"])
    pairs = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "value", F.lit("pair").alias("part"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return best.unionByName(pairs).select("lang", "source", "part", "item", "value", F.row_number().over(ranked).alias("rank"))
