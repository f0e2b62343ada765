"""Token-id files in Simple-8b blocks (operator 6).

A block is consecutive whole documents, or a part of one that is longer than a block, so none grows
with a text. Its ids are packed greedily into 64-bit words. The top four bits of a
word are its selector, which says how many ids of how many bits follow from the low end. A selector
is kept for escapes: ids of more than 60 bits stand in a table of the block, and the word holds the
place there. A block also stores, for every 64th word, how many ids come before it, so any part can
be decoded alone. All words of one selector are decoded in one numpy operation.

The files are a table of blocks, one sorted run of document ids per part: written and read by
Spark, so they can be in any store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stage, text_of
from .encoding import END_ID, encoder

#: Fixed values: (ids, bits of each) by selector; selector 0 is the escape.
SELECTORS = ((1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, MAGIC, EVERY = 0, b"S8B1", 64
#: Ids of a block at most.
BLOCK_IDS = 1 << 16
U = np.uint64
COUNTS = np.array([n for n, _ in SELECTORS])


def _plan(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and its selector. wide: the bits that each value needs."""
    n = len(wide)
    best = np.where(wide > 60, ESCAPE, len(SELECTORS) - 1).astype(np.uint8)
    for s in range(len(SELECTORS) - 2, 0, -1):
        count, bits = SELECTORS[s]
        run, have = wide <= bits, 1  # run[i]: have values from i on fit
        while have < count <= n and run.any():
            step = min(have, count - have)
            run, have = run[:-step] & run[step:], have + step
        if have == count:
            best[: len(run)][run] = s
    after = (np.arange(n) + COUNTS[best]).tolist()
    begins, i = [], 0
    while i < n:
        begins.append(i)
        i = after[i]
    begins = np.array(begins, np.int64)
    return begins, best[begins]


def pack(values: np.ndarray) -> bytes:
    """One block of unsigned 64-bit values."""
    v = values.astype(U)
    if v.max(initial=0) < 1 << 53:
        wide = np.frexp(v.astype(np.float64))[1].astype(np.int8)  # exact bit lengths
    else:
        wide = np.zeros(len(v), np.int8)
        for bits in sorted({b for _, b in SELECTORS}):
            wide[v >> U(bits) > 0] = bits + 1
    begins, chosen = _plan(wide) if len(v) else (np.empty(0, np.int64), np.empty(0, np.uint8))
    words = chosen.astype(U) << U(60)
    escaped = np.empty(0, U)
    for s in np.unique(chosen):
        at, (count, bits) = np.flatnonzero(chosen == s), SELECTORS[s]
        if s == ESCAPE:
            escaped = v[begins[at]]
            words[at] |= np.arange(len(at), dtype=U)
        elif bits:
            part = v[begins[at][:, None] + np.arange(count)] << (U(bits) * np.arange(count, dtype=U))
            words[at] |= np.bitwise_or.reduce(part, axis=1)
    marks = begins[::EVERY].astype("<u4")
    head = struct.pack("<4s4I", MAGIC, len(v), len(words), len(escaped), len(marks))
    return b"".join((head, marks.tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes()))


def unpack(block: bytes, first_mark: int = 0, stop_mark: int | None = None) -> np.ndarray:
    """The values of a block, or of its words from first_mark * 64 to stop_mark * 64."""
    magic, n, n_words, n_escaped, n_marks = struct.unpack_from("<4s4I", block)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    marks = np.frombuffer(block, "<u4", n_marks, 20)
    words = np.frombuffer(block, "<u8", n_words, 20 + 4 * n_marks)
    escaped = np.frombuffer(block, "<u8", n_escaped, 20 + 4 * n_marks + 8 * n_words)
    if first_mark or stop_mark is not None:
        stop_mark = n_marks if stop_mark is None else min(stop_mark, n_marks)
        n = int((marks[stop_mark] if stop_mark < n_marks else n) - (marks[first_mark] if first_mark < n_marks else n))
        words = words[first_mark * EVERY : stop_mark * EVERY]
    out = np.zeros(n, U)
    chosen = (words >> U(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[chosen])
    for s in np.unique(chosen):
        at, (count, bits) = np.flatnonzero(chosen == s), SELECTORS[s]
        if s == ESCAPE:
            out[ends[at] - 1] = escaped[(words[at] & U((1 << 60) - 1)).astype(np.int64)]
        elif bits:
            part = (words[at][:, None] >> (U(bits) * np.arange(count, dtype=U))) & U((1 << bits) - 1)
            out[(ends[at] - count)[:, None] + np.arange(count)] = part
    return out


BLOCK_SCHEMA = "part int, block long, first long, first_doc long, split boolean, doc_ids array<{id}>, lengths array<int>, payload binary"


def _write(path: str, id_type: pa.DataType):
    def block(part, number, first, first_doc, split, ids, lengths, data):
        values = np.frombuffer(b"".join(data), "<u4")
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (number, first, first_doc)), pa.array([split]), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack(values)], pa.binary())],
            names=["part", "block", "first", "first_doc", "split", "doc_ids", "lengths", "payload"],
        )

    def run(batches):
        end, part = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        ids, lengths, data, size = [], [], [], 0
        number = first = done = 0  # blocks, ids and whole documents written so far
        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), encoder(path).batch(batch.column("text").to_pylist())):
                n = len(own) // 4 + 1
                if ids and size + n > BLOCK_IDS:
                    yield block(part, number, first, done, False, ids, lengths, data)
                    number, first, done = number + 1, first + size, done + len(ids)
                    ids, lengths, data, size = [], [], [], 0
                if n <= BLOCK_IDS:
                    ids.append(doc)
                    lengths.append(n)
                    data += [own, end]
                    size += n
                    continue
                whole = memoryview(own + end)
                for at in range(0, n, BLOCK_IDS):
                    m = min(BLOCK_IDS, n - at)
                    yield block(part, number, first, done, True, [doc], [m], [whole[4 * at : 4 * (at + m)]])
                    number, first = number + 1, first + m
                done += 1
        if ids:
            yield block(part, number, first, done, False, ids, lengths, data)

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of blocks. Documents ascend by id over parts and blocks: null ids first, ties
    by the text. ``first`` counts the ids before a block in its part, ``first_doc`` the documents. A
    document of more than BLOCK_IDS ids has blocks of its own (``split``). An empty table gives no blocks."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # Ranges of (id, hash), so that rows that share an id can be dealt over several parts.
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return stage(map_arrow(dealt, _write(tokenizer_path, to_arrow_type(kind)), BLOCK_SCHEMA.format(id=kind.simpleString())), "token-blocks")


def _read(id_type: pa.DataType):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, doc, ids, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "first_doc", "doc_ids", "lengths", "payload"))):
                data = memoryview(unpack(payload).astype("<u4").tobytes())
                stops = np.cumsum(lengths, dtype=np.int64)
                starts = stops - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(np.arange(doc, doc + len(ids))), pa.array(ids, id_type), pa.array(first + starts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())], pa.int64())],
                    names=["part", "nth", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def _joined(batches) -> Iterator[pa.RecordBatch]:
    """The checksum of pieces in a row, from theirs: that of a run after c is that of as many zeros after
    c, but for what the run and the zeros are by themselves."""
    for batch in batches:
        whole = []
        for pieces in batch.column("pieces").to_pylist():
            crc = 0
            for p in pieces:
                zeros = bytes(4 * p["n_tokens"])
                crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ p["ids_crc32"]
            whole.append(crc)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "nth", "doc_id", "start", "n_tokens")), pa.array(whole, pa.int64())], names=["part", "nth", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks; start counts the
    ids of all documents before it. What a document's blocks give is put together at the end."""
    kind = files.schema["doc_ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"part int, nth long, doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long"
    rows, pieces = (map_arrow(files.where(c), _read(to_arrow_type(kind)), schema) for c in ("NOT split", "split"))
    long = pieces.groupBy("part", "nth").agg(
        F.any_value("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("pieces")
    )
    # One row per part: a few thousand at any size of the input.
    sizes = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    both = rows.unionByName(map_arrow(long, _joined, schema))
    return both.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts and read them back: one row per input row.

    A null text counts as empty; every document ends with id 2, so an empty one has one id. Rows
    that repeat are all written. Null ids come first; ties are in the order of a hash of the text. A very
    long text is several blocks. An empty table gives no blocks and no rows. Other columns are ignored.
    """
    return read_token_files(write_token_files(docs, tokenizer_path, id_col, text_col))
