"""Quality classifier: a byte-level convolutional network in numpy (operator 7).

The document's bytes are cut into overlapping chunks that cover all of it. ``filters`` learned filters
of ``width`` bytes run over each chunk (a filter is a table of a weight per place and byte value), go
through a rectifier and are max-pooled per chunk. The pooled chunks are combined by their mean and
their maximum into one logistic output, so the score depends on every chunk.

Fitted by back-propagation on the driver, on at most ``sample`` labelled rows and ``most_bytes`` bytes;
scoring takes whole texts, runs in Arrow batches and touches one stretch of a text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, spread, stage, text_of

CHUNK, OVERLAP = 512, 32
#: Chunks that are convolved at once.
STRETCH = 16


def fold(id_col: Column) -> Column:
    """crc32 of the id's decimal text, mod 5; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


class Network:
    def __init__(self, filters: int, width: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((width, 256, filters)) * 0.3).astype(np.float32)  # weight by place, byte, filter
        self.bias = np.zeros(filters, np.float32)
        self.out = np.concatenate([rng.standard_normal(2 * filters) * 0.1, [0.0]]).astype(np.float32)

    def chunks(self, text: bytes) -> np.ndarray:
        """(chunks, CHUNK) byte values; the last one ends with the text, a short text is padded with 0."""
        data = np.frombuffer(text.ljust(CHUNK, b"\0"), np.uint8)
        step = CHUNK - OVERLAP
        starts = np.append(np.arange(0, len(data) - CHUNK, step), len(data) - CHUNK)
        return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[starts]

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """(chunks, filters): the rectified maxima, and where they are if asked for."""
        width, out, at = len(self.table), [], []
        n = CHUNK - width + 1
        for i in range(0, len(chunks), STRETCH):
            part = chunks[i : i + STRETCH]
            total = self.table[0].take(part[:, :n], axis=0)
            for k in range(1, width):
                total += self.table[k].take(part[:, k : k + n], axis=0)
            out.append(total.max(axis=1))
            if places:
                at.append(total.argmax(axis=1))
        top = np.maximum(np.concatenate(out) + self.bias, 0)
        return (top, np.concatenate(at)) if places else top

    def combine(self, top: np.ndarray) -> np.ndarray:
        return np.concatenate([top.mean(axis=0), top.max(axis=0), [1.0]]).astype(np.float32)

    def score(self, text: bytes) -> float:
        z = float(self.combine(self.pooled(self.chunks(text))) @ self.out)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the summed, weighted loss of some documents' chunks: for table, bias and out."""
        filters, width, chunks = len(self.bias), len(self.table), np.concatenate(docs)
        ends = np.cumsum([len(d) for d in docs])
        top, at = self.pooled(chunks, places=True)
        parts = np.split(top, ends[:-1])
        x = np.array([self.combine(p) for p in parts])
        miss = (1 / (1 + np.exp(-np.clip(x @ self.out, -30, 30))) - labels) * weights
        dtop = np.repeat(np.outer(miss / np.diff(ends, prepend=0), self.out[:filters]), np.diff(ends, prepend=0), axis=0)
        for p, end, m in zip(parts, ends, miss):
            dtop[end - len(p) + p.argmax(axis=0), np.arange(filters)] += m * self.out[filters : 2 * filters]
        dtop *= top > 0
        table = np.zeros(self.table.size)
        for k in range(width):
            byte = np.take_along_axis(chunks, at + k, axis=1).astype(np.int64)  # (chunks, filters)
            table += np.bincount(((k * 256 + byte) * filters + np.arange(filters)).ravel(), dtop.ravel(), table.size)
        return [table.reshape(self.table.shape).astype(np.float32), dtop.sum(axis=0).astype(np.float32), (miss @ x).astype(np.float32)]


def fit(texts: list[bytes], labels: np.ndarray, filters: int = 12, width: int = 5, epochs: int = 12, batch: int = 32, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Network:
    """Adam over mini-batches; both classes weigh the same in the gradient. Without both labels the
    network's output is the constant share of label 1 (0.5 without any rows)."""
    net = Network(filters, width, seed)
    share = float(np.mean(labels)) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.out[:] = 0
        net.out[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rng, params = np.random.default_rng(seed), [net.table, net.bias, net.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    docs = [net.chunks(t) for t in texts]
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        lr = rate * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            grads = net.gradients([docs[d] for d in some], labels[some], weights[some])
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                g = g / batch + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _spread_out(text: Column, longest: int) -> Column:
    """A text of up to ``longest`` bytes as it is; of a longer one stretches of CHUNK bytes from all over it,
    evenly spaced from its start to its end, ``longest`` bytes in all."""
    n = longest // CHUNK
    last = (F.octet_length(text) - CHUNK).cast("double")
    start = lambda i: F.floor(i * last / (n - 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, start(i), F.lit(CHUNK)))
    return F.when(F.octet_length(text) <= longest, text).otherwise(F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part)))


def train(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 3000, most_bytes: int = 6 << 20, longest: int = 32 << 10, **how,
) -> Network:
    """Fit on at most ``sample`` labelled rows and ``most_bytes`` bytes: the rows whose ids hash lowest, among
    those where ``allowed`` (of the labels' columns) holds. Half of either bound is kept for each label. A text
    of more than ``longest`` bytes is in the sample by evenly spaced stretches of it of ``longest`` bytes, so
    no text, however long, keeps the others out, and each label that has rows has one in the sample.
    An id counts once, with its largest label and, of several texts, the smallest. Rows without a
    label, an id or a text are not used; columns other than those named neither."""
    if not 2 * CHUNK <= longest <= most_bytes // 2:
        raise ValueError("longest must be two chunks at least and half of most_bytes at most")
    usable = labels.where(allowed) if allowed is not None else labels
    usable = usable.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id IS NOT NULL AND label IN (0, 1)").groupBy("l_id").agg(F.max("label").alias("label"))
    by_label = [usable.where(F.col("label") == v).orderBy(F.xxhash64("l_id"), "l_id").limit(sample // 2) for v in (0, 1)]
    chosen = by_label[0].unionByName(by_label[1])
    rows = docs.select(F.col(id_col).alias("l_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text")).where("text IS NOT NULL")
    met = rows.join(F.broadcast(chosen), "l_id").select("l_id", "label", _spread_out(F.col("text"), longest).alias("text"))  # ``sample`` ids at most
    joined = stage(met.groupBy("l_id", "label").agg(F.min("text").alias("text")), "labelled-texts")
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("l_id"), "l_id").rowsBetween(Window.unboundedPreceding, 0))
    within = joined.select("l_id", so_far.alias("so_far")).where(F.col("so_far") <= most_bytes // 2).select("l_id")
    got = joined.join(F.broadcast(within), "l_id").orderBy("l_id").select("text", "label").toArrow()  # ``sample`` rows, most_bytes bytes at most
    return fit(got.column("text").to_pylist(), got.column("label").to_numpy(), **how)


def _score_rows(net: Network):
    def run(batches):
        for batch in batches:
            scores = [net.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on), one row per input row.

    Only the text is an input of a score. A null or empty text is one chunk of padding. Very long
    texts are scored whole. Repeated rows are scored alike; ids may be null. An empty table gives an
    empty table. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    out = map_arrow(spread(rows), _score_rows(net), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
