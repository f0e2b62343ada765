"""Toxicity severity by cumulative-link ordinal regression on sparse text features (operator 2).

Features are a document's distinct words and their prefixes of three to five letters, hashed. The
model is P(grade >= k) = sigmoid(w . x - theta_k): one weight vector shared by all ordered
thresholds. It is fitted with numpy on at most ``sample`` labelled rows; scoring runs on all rows in
Arrow batches. Only features that the sample ties to the grades by a clear z-score get a weight, so
the length of a text alone moves nothing. They are counted in Spark; of the sample only rows cut down
to such features come to the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread, stage, text_of

WORD = re.compile(r"\w+")
DIMENSIONS = 1 << 20
#: Documents of the sample that a feature must be in, and how clearly it must speak for toxicity.
LEAST_HELD, Z_LEAST = 5, 4.0
#: Words whose features a worker remembers at most.
KNOWN_WORDS = 200_000


def _of_word(word: str) -> tuple[int, ...]:
    parts = [f"={word}", *(word[:n] for n in (3, 4, 5) if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(p) % DIMENSIONS for p in parts)


def features(text: str) -> np.ndarray:
    """The distinct features, ascending."""
    return np.unique(np.array([f for w in set(WORD.findall(text.lower())) for f in _of_word(w)], np.int64))


class _Known(dict):
    """word -> those of its features that have a weight; empty for most words."""

    def __init__(self, index: dict[int, float]) -> None:
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = tuple(f for f in _of_word(word) if f in self.index)
        return found


class Model:
    """features (ascending) and their weights, and the ascending thresholds of the grades from 1."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.thresholds = thresholds
        self.index = dict(zip(features.tolist(), weights.tolist()))

    def scorer(self):
        """text -> (expected severity, P(grade >= k) for each k from 1)."""
        known = _Known(self.index)

        def score(text: str) -> tuple[float, np.ndarray]:
            own = set().union(*map(known.__getitem__, set(WORD.findall(text.lower()))))
            x = sum(self.index[f] for f in sorted(own))
            p = 1 / (1 + np.exp(np.clip(self.thresholds - x, -50, 50)))
            return float(p.sum()), p

        return score


def grades(docs: list[np.ndarray], toxic: np.ndarray, levels: int) -> np.ndarray:
    """Severity grades from 0/1 labels: 0 for label 0; toxic documents are dealt into ``levels`` grades
    of about equal number by how many of their features occur in toxic documents mostly."""
    held, hit = np.zeros(DIMENSIONS, np.int32), np.zeros(DIMENSIONS, np.int32)
    for f, t in zip(docs, toxic):
        held[f] += 1
        hit[f] += t
    marked = (held >= LEAST_HELD) & (hit >= 0.9 * held)
    terms = np.array([marked[f].sum() for f in docs])
    cuts = np.quantile(terms[toxic == 1], np.arange(1, levels) / levels) if toxic.any() else []
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, terms, side="right"), 0)


def fit(docs: list[np.ndarray], grade: np.ndarray, z_least: float = Z_LEAST, rounds: int = 1000, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the cumulative-link likelihood. Without labelled rows, or with one grade
    only, the model gives every text the same severity, near the lowest grade."""
    levels = max(1, int(grade.max(initial=0)))
    if not len(docs) or grade.max(initial=0) == 0:
        return Model(np.empty(0, np.int64), np.empty(0), np.full(1, 10.0))
    n, y = len(docs), grade > 0
    held, hit = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for f, t in zip(docs, y):
        held[f] += 1
        hit[f] += t
    share = y.mean()
    z = (hit - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    chosen = np.flatnonzero((z >= z_least) & (held >= LEAST_HELD))
    place = np.full(DIMENSIONS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    columns = [p[p >= 0] for p in (place[f] for f in docs)]
    rows, columns = np.repeat(np.arange(n), [len(c) for c in columns]), np.concatenate(columns) if columns else np.empty(0, np.int64)
    above = (grade[:, None] >= np.arange(1, levels + 1)).astype(float)
    base = above.mean(0).clip(1e-6, 1 - 1e-6)
    w, theta = np.zeros(len(chosen)), -np.log(base / (1 - base))
    first, second = [np.zeros(len(w)), np.zeros(levels)], [np.zeros(len(w)), np.zeros(levels)]
    for t in range(1, rounds + 1):
        x = np.bincount(rows, w[columns], n)
        miss = 1 / (1 + np.exp(np.clip(theta - x[:, None], -50, 50))) - above  # of each threshold
        for p, g, m, v in zip((w, theta), (np.bincount(columns, miss.sum(1)[rows], len(w)) / n + decay * w, -miss.mean(0)), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        np.maximum(w, 0, out=w)  # a feature of toxic texts never speaks against toxicity
        theta.sort()
    return Model(chosen, w, theta)


def _feature_rows(batches):
    for batch in batches:
        found = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("l_id"), batch.column("label"), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))], names=["l_id", "label", "features"])


def _cut_down(telling: np.ndarray):
    def run(batches):
        for batch in batches:
            found = [f[np.isin(f, telling)] for f in (np.array(x, np.int32) for x in batch.column("features").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("l_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["l_id", "label", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 12_000, levels: int = 3, graded: bool = False) -> Model:
    """Fit on at most ``sample`` labelled rows: those whose ids hash lowest. An id counts once, with its
    largest label and, of several texts, the smallest; so the model does not depend on the order of
    rows. Rows without a label, a text or an id are not used. graded: label_col already holds ordered
    grades from 0."""
    one = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id IS NOT NULL AND label >= 0").groupBy("l_id").agg(F.max("label").alias("label"))
    chosen = one.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    joined = rows.join(F.broadcast(chosen), "l_id").groupBy("l_id", "label").agg(F.min("text").alias("text"))  # ``sample`` rows at most
    schema = f"l_id {joined.schema['l_id'].dataType.simpleString()}, label int, features array<int>"
    found = stage(map_arrow(joined, _feature_rows, schema), "labelled-features")
    n, toxic = found.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0)).first()
    if not n or not toxic:
        return fit([], np.empty(0, np.int64))
    counted = found.select(F.explode("features").alias("f"), (F.col("label") > 0).cast("int").alias("y")).groupBy("f").agg(F.count(F.lit(1)).alias("held"), F.sum("y").alias("hit"))
    share = toxic / n
    z = (F.col("hit") - F.col("held") * share) / F.sqrt(F.greatest(F.col("held") * (share * (1 - share)), F.lit(1e-9)))
    telling = counted.where((F.col("held") >= LEAST_HELD) & ((z >= Z_LEAST - 1e-6) | (F.col("hit") >= 0.9 * F.col("held")))).select("f").toArrow()  # of DIMENSIONS at most
    got = map_arrow(found, _cut_down(np.sort(telling.column("f").to_numpy())), schema).orderBy("l_id").toArrow()
    label, lists = got.column("label").to_numpy(), got.column("features").combine_chunks()
    parts = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1])  # views, not Python lists
    return fit(parts, label if graded else grades(parts, (label > 0).astype(np.int64), levels))


def _score_rows(model: Model, place: int | None):
    """place: the text's field in the carried row, which then crosses to Python once."""

    def run(batches):
        score = model.scorer()
        for batch in batches:
            texts = batch.column("text") if place is None else pc.struct_field(batch.column("row"), place)
            found = [score(t or "") for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([s for s, _ in found], pa.float64()), pa.array([float(p[0]) for _, p in found], pa.float64())], names=["row", "severity", "p_toxic"]
            )

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, cut: float = 0.3) -> DataFrame:
    """The columns ``carry`` (all by default), then _severity (expected grade), _p_toxic (probability of
    any grade above 0) and _toxic (_p_toxic >= cut), one row per input row.

    A null or empty text has no features and gets the severity of the thresholds alone. Very long
    texts are scored whole. Repeated rows are scored alike. Columns of these three names are replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("_severity", "_p_toxic", "_toxic")]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))
    place = carry.index(text_col) if text_col in carry and dict(docs.dtypes)[text_col] == "string" else None
    rows = docs.select(row.alias("row"), *([text_of(text_col).alias("text")] if place is None else []))
    out = map_arrow(spread(rows), _score_rows(model, place), f"row {rows.schema['row'].dataType.simpleString()}, severity double, p_toxic double")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)), F.col("severity").alias("_severity"), F.col("p_toxic").alias("_p_toxic"), (F.col("p_toxic") >= cut).alias("_toxic"))
