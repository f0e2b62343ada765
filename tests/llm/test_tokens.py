import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spindle.llm import encoding, packing, token_counts, token_files

from . import helpers as H

PIECES = ["a", "b", " ", "  ", "\n", "é", "́", "1", "22", "!", "...", "'s", "'re", "'S", "\x1c", "\x85", "ß", "word ", "The ", "　", "Σ", "İ", "K", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "日本", "²", "don't ", "ſ", "ﬁ", "😀", "ı", "_"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_library_s_ids(name):
    rng, e, plain = random.Random(3), encoding.Encoder(encoding.vocabulary(name)), Tokenizer.from_file(encoding.vocabulary(name))
    for _ in range(1500):
        some = rng.sample(PIECES, rng.randint(1, 12))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(e.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def whole(name, text):
    """As the untouched library says, with the id that ends a document."""
    return Tokenizer.from_file(encoding.vocabulary(name)).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(0, 700))
        x = (rng.integers(0, 2**63, n).astype(np.uint64) * 2 + 1) >> rng.integers(0, 64, n).astype(np.uint64)
        x[rng.random(n) < rng.random()] = rng.integers(0, 3)
        block = token_files.pack(x)
        assert np.array_equal(token_files.unpack(block), x)
        k = int(rng.integers(0, 4))
        assert np.array_equal(np.concatenate([token_files.unpack(block, 0, k), token_files.unpack(block, k)]), x)
    small = token_files.pack(np.full(60_000, 3))
    assert len(small) < 60_000 * 2 / 8 + 2000
    with pytest.raises(ValueError):
        token_files.unpack(b"no block" + small)


def test_token_files(spark):
    rows = H.messy_rows()
    got = token_files.token_files(H.messy(spark), encoding.vocabulary("word_bpe_49k.json")).collect()
    ids = [(d, whole("word_bpe_49k.json", t)) for d, t in rows]
    assert sorted(map(repr, ((d, len(i), crc(i)) for d, i in ids))) == sorted(repr((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert token_files.token_files(H.empty(spark), encoding.vocabulary("word_bpe_49k.json")).count() == 0


def test_long_documents_have_blocks_of_their_own(spark):
    n = token_files.BLOCK_IDS
    texts = ["a b", "c " * (n - 1), "d " * n, "e", "f g " * (n + 5), "", "<|endoftext|> h<|startoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = token_files.write_token_files(docs.coalesce(1), encoding.vocabulary("word_bpe_49k.json"))
    assert max(sum(r["lengths"]) for r in files.collect()) <= n
    assert sorted(r["split"] for r in files.collect()).count(True) == 2 + 3
    at = 0
    for r, t in zip(token_files.read_token_files(files).orderBy("doc_id").collect(), texts):
        ids = whole("word_bpe_49k.json", t)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_many_empty_texts_take_linear_time():
    import time

    import pyarrow as pa
    from pyspark import TaskContext

    def seconds(n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([""] * n)], names=["doc_id", "text"])
        began = time.process_time()
        blocks = list(token_files._write(encoding.vocabulary("word_bpe_49k.json"), pa.int64())(iter([batch])))
        assert sum(len(b.column("doc_ids")[0]) for b in blocks) == n
        return time.process_time() - began

    task = TaskContext._getOrCreate()
    task._partitionId = 0
    try:
        seconds(1000)
        assert seconds(80_000) < 4
    finally:
        TaskContext._setTaskContext(None)


def test_packing(spark):
    rows = H.messy_rows()
    got = packing.pack_documents(H.messy(spark), encoding.vocabulary("byte_bpe_50k.json")).collect()
    sequences, seen = defaultdict(list), defaultdict(int)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    expected = defaultdict(int)
    for d, t in rows:
        ids, at, k = whole("byte_bpe_50k.json", t), 0, 0
        while at < len(ids):
            m = (len(ids) - at) % 1024 or 1024
            expected[d, k, at, m, crc(ids[at : at + m])] += 1
            at, k = at + m, k + 1
    assert seen == expected
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(H.empty(spark), encoding.vocabulary("byte_bpe_50k.json")).count() == 0


def best_fit_decreasing(lengths, capacity):
    import bisect

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i == len(rooms):
            n += 1
            bisect.insort(rooms, capacity - x)
        else:
            bisect.insort(rooms, rooms.pop(i) - x)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(1023, max(1, int(rng.lognormvariate(5, 1.2)))) for _ in range(rng.choice([1, 40, 4000, 40_000]))]
    histogram = defaultdict(int)
    for x in lengths:
        histogram[x] += 1
    runs, n = packing.plan(dict(histogram))
    used, given = defaultdict(int), defaultdict(int)
    for length, a, b, first, offset in runs:
        given[length] += b - a
        for s in range(first, first + b - a):
            used[s] += length
    assert given == histogram and max(used.values()) <= 1024 and len(used) == n
    assert n <= best_fit_decreasing(lengths, 1024) * 1.002 + 1
    assert packing.plan({}) == ([], 0)


@pytest.mark.parametrize("seed", range(3))
def test_few_sizes_are_planned_and_few_sequences_made(seed):
    rng = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(60_000):
        histogram[rng.choice([rng.randint(1, 1023), min(1023, max(1, int(rng.lognormvariate(6, 0.5))))])] += 1
    large = sorted(((x, n) for x, n in histogram.items() if x > 256), reverse=True)
    sizes, counts = packing.rounded(large, 64)
    assert len(sizes) <= 64 < len(large) and sum(counts) == sum(n for _, n in large) and max(counts) <= 2 * -(-sum(counts) // 64)
    volume = sum(x * n for x, n in histogram.items() if x <= 256)
    chosen = packing.configurations(sizes, counts, volume, 1024)
    assert len(chosen) <= len(sizes) + 1 and all(sum(own) <= 1024 for own, _ in chosen)  # a basic solution
    for size, n in zip(sizes, counts):
        assert sum(times * own.count(size) for own, times in chosen) >= n * (1 - 1e-9)
    exact = best_fit_decreasing([x for x, n in histogram.items() for _ in range(n)], 1024)
    assert packing.plan(dict(histogram))[1] <= exact * 1.002


@pytest.mark.parametrize("histogram, fewest", [({700: 1000, 324: 1000}, 1000), ({600: 10**9, 424: 10**9, 300: 10**8}, 1_033_333_334), ({1023: 5, 1: 5}, 5), ({512: 7}, 4), ({341: 3000, 342: 1000}, 1334)])
def test_few_lengths_are_not_rounded(histogram, fewest):
    large = sorted(((x, n) for x, n in histogram.items() if x > 256), reverse=True)
    assert packing.rounded(large, 64) == tuple(map(list, zip(*large)))
    runs, n = packing.plan(histogram)
    assert fewest <= n <= fewest * 1.00001
    assert {x: sum(b - a for length, a, b, *_ in runs if length == x) for x in histogram} == histogram


@pytest.mark.parametrize("shape, gap", [("uniform", 0.1), ("bimodal", 0.1), ("lognormal", 0.1)])
def test_grouped_lengths_come_near_finer_plans(shape, gap):
    """In percent: the uniform and lognormal sets against their total length, the bimodal one, which leaves room
    in any packing, against best fit of the exact lengths."""
    rng, histogram = random.Random(1), defaultdict(int)
    for _ in range(40_000):
        x = {"uniform": lambda: rng.randint(1, 1023), "bimodal": lambda: rng.gauss(*rng.choice([(350, 40), (650, 50)])), "lognormal": lambda: rng.lognormvariate(5, 1.2)}[shape]()
        histogram[min(1023, max(1, int(x)))] += 1
    n = packing.plan(dict(histogram))[1]
    best_fit = best_fit_decreasing([x for x, n in histogram.items() for _ in range(n)], 1024)
    bound = best_fit if shape == "bimodal" else -(-sum(x * n for x, n in histogram.items()) // 1024)
    assert n <= bound * (1 + gap / 100) and n <= best_fit * 1.0005


def test_the_program_finds_the_fewest_sequences():
    """Against all ways to fill, on small cases."""
    from functools import lru_cache

    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.choice([300, 340, 400, 512, 600, 700]) for _ in range(rng.randint(1, 9))]

        @lru_cache(None)
        def fewest(rest):
            if not rest:
                return 0
            first, others = rest[0], rest[1:]
            best = 1 + fewest(others)
            for i in range(len(others)):
                for j in range(i, len(others)):
                    both = {i, j}
                    if first + sum(others[k] for k in both) <= 1024:
                        best = min(best, 1 + fewest(tuple(x for k, x in enumerate(others) if k not in both)))
            return best

        histogram = {x: lengths.count(x) for x in lengths}
        assert packing.plan(histogram)[1] <= fewest(tuple(sorted(lengths, reverse=True))) + 1


def check_tree(tree, text, tokens):
    """Sums hold on every level, no node has too many children, and the tree survives being kept."""
    assert (tree.length, tree.total) == (len(text), tokens)
    levels = tree.levels()
    for below, (kids, lengths, tokens_of) in zip(levels, levels[1:]):
        cuts = np.cumsum([0, *kids])
        assert max(kids) <= token_counts.FAN and cuts[-1] == len(below[1])
        for own, under in ((lengths, below[1]), (tokens_of, below[2])):
            assert own.tolist() == [int(under[a:b].sum()) for a, b in zip(cuts, cuts[1:])]
    assert not levels or len(levels[-1][1]) == 1
    (read,) = token_counts._from_arrow(token_counts._to_arrow([levels]))
    assert all(np.array_equal(x, y) for a, b in zip(read, levels) for x, y in zip(a, b)) and len(read) == len(levels)
    return token_counts.Tree.of_levels(read)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("size", [3, 256])
def test_edits_count_like_a_whole_encoding(name, size, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT", size)
    rng, c, plain = random.Random(1), token_counts.Counter(encoding.vocabulary(name)), Tokenizer.from_file(encoding.vocabulary(name))
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    for k in range(80):
        some = rng.sample(PIECES, rng.randint(3, len(PIECES)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 900)))
        tree = check_tree(c.build(text), text, count(text))
        for _ in range(6):
            a = rng.randint(0, len(text))
            text, _n = c.edit(text, tree, a, a + rng.choice([0, 1, 5, 200]), "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 10, 400]))))
            kept = check_tree(tree, text, count(text))
            tree = kept if k % 2 else tree


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257, 5000])
def test_levels_of_new_leaves_are_those_of_their_tree(n):
    leaves = [(i % 7 + 1, i % 3) for i in range(n)]
    assert [tuple(map(list, x)) for x in token_counts.Tree.of_leaves(leaves).levels()] == token_counts.stacked(leaves)


def test_an_edit_touches_little():
    """Code points encoded anew do not grow with the text, nodes read or made only with its logarithm."""
    c, seen = token_counts.Counter(encoding.vocabulary("byte_bpe_50k.json")), []
    for n in (2_000, 20_000, 200_000):
        text = " ".join(H.words(4, n))
        tree = token_counts.Tree.of_levels(c.build(text).levels())
        text, encoded = c.edit(text, tree, len(text) // 2, len(text) // 2 + 10, "something else")
        check_tree(tree, text, c.build(text).total)
        assert encoded < 2_000
        seen.append(tree.opened)
    assert seen[2] <= seen[0] + 6 * token_counts.FAN < 200


def test_token_counts(spark):
    docs, path = H.messy(spark), encoding.vocabulary("byte_bpe_50k.json")
    got = token_counts.token_counts(docs, path).collect()
    assert sorted(repr((d, len(whole("byte_bpe_50k.json", t)) - 1)) for d, t in H.messy_rows()) == sorted(repr((r["doc_id"], r["n_tokens_before"])) for r in got)
    for r in got:
        assert r["n_tokens"] == len(whole("byte_bpe_50k.json", r["text"])) - 1
        assert (r["n_encoded"] == 0) == (r["doc_id"] is None)
    edits = spark.createDataFrame([(1, 0, -5, 5, "Bye"), (1, 1, 3, 99, None), (1, 2, None, 1, "z"), (99, 0, 0, 0, "x"), (None, 0, 0, 0, "x")], "doc_id long, seq int, start long, stop long, replacement string")
    got = {r["doc_id"]: r["text"] for r in token_counts.token_counts(docs.where("doc_id < 3"), path, edits).collect()}
    assert got == {1: "Bye", 2: "hello world"}
    assert token_counts.token_counts(H.empty(spark), path).count() == 0
