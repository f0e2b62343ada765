import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from spindle.llm import exact_dedup, keep, line_dedup, minhash
from spindle.llm.components import components

from . import helpers as H


def key(rows):
    return sorted(rows, key=repr)


def test_exact(spark):
    rows = H.messy_rows()
    groups = defaultdict(list)
    for d, t in rows:
        groups[H.lower(t)].append(d)
    got = exact_dedup.exact_dedup(H.messy(spark), counters=16).collect()
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    expected = [(d, best[H.lower(t)], len(groups[H.lower(t)]), hashlib.sha256(H.lower(t).encode()).hexdigest()) for d, t in rows]
    assert key((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == key(expected)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(H.empty(spark)).count() == 0


def test_exact_with_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(rows.repartition(7), counters=16)
    assert got.where("kept").count() == 1 + 1000
    assert got.where("group_size = 1000").select("keep_id").distinct().collect()[0][0] == 2997


def test_lines(spark):
    rows = H.messy_rows()
    got = line_dedup.line_dedup(H.messy(spark))
    assert set(got.columns) == {*H.messy(spark).columns, "_n_removed", "_emptied"}
    expected = H.deduplicated_lines(rows)
    assert key((r["doc_id"], r["_n_lines"], r["_n_removed"], r["text"]) for r in got.collect()) == key(expected)
    assert line_dedup.line_dedup(H.empty(spark)).count() == 0


def test_lines_random(spark):
    import random

    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randrange(12)))) for i in range(150)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert key((r["doc_id"], r["_n_lines"], r["_n_removed"], r["text"]) for r in got) == key(H.deduplicated_lines(rows))


def test_pipeline_cuts_long_passages_of_one_or_two_lines(spark):
    one, half, other, short = (" ".join(H.words(60 + i, n, 10**6)) for i, n in enumerate((51, 30, 30, 50)))
    texts = ["\n".join(["a", "b", one, "c", half, other, "d", short, "e"]), f"f\n{one}\ng", f"h\n{half}\n{other}\ni\n{short}\nj\n{half}\nk", one, f"{half}\n{other}", f"l\n{one}\nm\n{one}\n{half}\n{other}\n{one}\nn"]
    left = [texts[0], "f\ng", f"h\ni\n{short}\nj\n{half}\nk", None, None, "l\nm\nn"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(left) if t is not None}
    plain = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert plain == {d: t for d, _, _, t in H.deduplicated_lines(list(enumerate(texts)))}


def check_near(spark, rows, size, **how):
    df = spark.createDataFrame([(*r, *H.EXTRA) for r in rows], H.SCHEMA).repartition(5)
    got = minhash.near_duplicates(df, size=size, **how).collect()
    sets = [H.shingles(t, size) for _, t in rows]
    first = H.components(sets)
    low = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            low[first[i]] = d if low[first[i]] is None else min(low[first[i]], d)
    expected = [(d, len(sets[i]), low[first[i]] if sets[i] else d, d is not None and d == (low[first[i]] if sets[i] else d)) for i, (d, _) in enumerate(rows)]
    assert key((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == key(expected)
    return got


def test_near_duplicates(spark):
    for size in (2, 5):
        check_near(spark, H.messy_rows(), size)
    assert minhash.near_duplicates(H.empty(spark)).count() == 0


def test_near_duplicates_of_one_text(spark):
    """A bucket of many near copies, some farther from each other than the limit."""
    import random

    rng, base = random.Random(3), H.words(9, 120)
    rows = []
    for i in range(130):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 8, 10])):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    check_near(spark, rows, 2, pivot_rounds=1)
    check_near(spark, rows, 2)


def test_circulant_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:700], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    one = minhash._band_hashes([a, b], 2000, 1)
    assert abs((one[0] == one[1]).mean() - true) < 0.04


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(1, 1), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_one_of_each_and_without(spark):
    docs = H.messy(spark)
    left = keep.one_of_each(docs, minhash.near_duplicates(docs, size=2))
    assert left.columns == docs.columns
    rows = H.messy_rows()
    sets = [H.shingles(t, 2) for _, t in rows]
    first = H.components(sets)
    groups = len({f for f, s in zip(first, sets) if s})
    blank = sum(1 for s in sets if not s)
    assert left.count() == groups + blank
    gone = docs.where("doc_id = 5 OR text = 'null id'").select("doc_id", F.xxhash64("text").alias("mark"))
    assert key(r["doc_id"] for r in keep.without(docs, gone).collect()) == key(d for d, t in rows if d != 5 and t != "null id")


def test_long_runs_of_one_and_two_lines(spark):
    """Against plain Python: passages of many words on one or two lines, between other lines or alone."""
    rng = random.Random(21)
    long = [" ".join(H.words(50 + i, 12, 10**6)) for i in range(4)]
    halves = [(" ".join(H.words(70 + i, 7, 10**6)), " ".join(H.words(90 + i, 7, 10**6))) for i in range(3)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            lines += rng.choice([[f"own {d} {rng.random()}"], [rng.choice(long)], list(rng.choice(halves)), ["short again"], [""]])
        docs.append((d, "\n".join(lines)))
    seen, gone = set(), {d: set() for d, _ in docs}
    for d, text in docs:
        lines = text.split("\n")
        runs = [(i, min(3, len(lines))) for i in range(max(1, len(lines) - 2))]
        runs += [(i, n) for n in (1, 2) if len(lines) > n for i in range(len(lines) - n + 1) if len(" ".join(lines[i : i + n]).split()) > 10]
        for i, n in sorted(runs):
            run = "\n".join(lines[i : i + n])
            if not run.strip():
                continue
            if run in seen:
                gone[d] |= set(range(i, i + n))
            seen.add(run)
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}
    assert sum(map(len, gone.values())) > 30
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), long_words=10).collect()
    assert {r["doc_id"]: r["text"] for r in got} == expected
