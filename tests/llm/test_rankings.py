"""Top-k search, spelling variants and source divergence against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindle.llm import divergence, spelling, topk

from . import helpers as H

# -- op11 ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, score long, rank int, uid long, id long, dim int, shard long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6, 7) for i, v in rows], VECTORS).repartition(3)


def plain_top_k(rows, k, scale=1024):
    usable = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q is None or q % 100:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), c is None, c or 0) for other, (c, w) in enumerate(usable) if other != at and len(w) == len(v)]
        out += [(q, n, None if none else c, -s) for n, (s, none, c) in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=repr)


def found_top_k(df, **how):
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    point = lambda d: [rng.gauss(0, 0.2) for _ in range(d)]
    same = point(5)
    rows = [(i, point(5)) for i in range(700)] + [(i, same) for i in range(700, 1100)]  # a third are one vector
    rows += [(i, point(3)) for i in range(1100, 1250)]
    rows += [(1300, None), (1301, [0.1, None, 0.2]), (1400, [float("nan"), 1.0, 1.0]), (1500, [float("inf"), 1.0, 1.0]), (None, point(5)), (None, same), (100, point(5)), (100, same), (1600, []), (1601, []), (2000, [0.5] * 9)]
    for how in ({}, {"shard_bytes": 9_000, "tile_bytes": 300, "least_points": 20}):
        assert found_top_k(vectors(spark, rows), k=10, **how) == plain_top_k(rows, 10)


def test_top_k_of_large_numbers_and_of_nothing(spark):
    rng = random.Random(2)
    rows = [(50 * i, [float(rng.randrange(-(2**29), 2**29)) for _ in range(4)]) for i in range(60)]
    assert found_top_k(vectors(spark, rows), k=3, scale=1) == plain_top_k(rows, 3, 1)
    huge = [(0, [1e300]), (1, [1e300]), (2, [-1e300]), (3, [1.7e308])]
    assert found_top_k(vectors(spark, huge)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    assert found_top_k(vectors(spark, [])) == [] and found_top_k(vectors(spark, rows[:1])) == []
    assert found_top_k(vectors(spark, [(1, [0.5]), (2, [0.5])])) == []


def test_a_walk_stops_at_boxes_that_are_no_better():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (50, 8))
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 1, (5000, 8)))
    tree = topk.Tree(points, np.arange(5000), np.arange(5000))
    for start, stop, left in tree.nodes.tolist():
        assert left < 0 or tree.nodes[left][0] == start and tree.nodes[left + 1][1] == stop
    assert sum(stop - start for start, stop, left in tree.nodes.tolist() if left < 0) == 5000
    seen = []
    watched = topk.Tree.of(tree.packed(), 8)

    class Points(np.ndarray):
        def __getitem__(self, at):
            seen.append(at)
            return np.asarray(super().__getitem__(at))

    watched.points = watched.points.view(Points)
    query = points[:1]
    (top,) = watched.search(query, np.array([0]), 10, [()])
    scores = points @ query[0]
    assert [x[1] for x in top] == [i for i in np.lexsort((np.arange(5000), -scores)) if i][:10]
    assert len(seen) < 12  # of at least 79 leaves
    worst = top[-1][:2]
    seen.clear()
    assert watched.search(query, np.array([0]), 10, [worst]) == [top] and len(seen) < 12
    assert watched.search(query, np.array([0]), 10, [(top[0][0] - 1, 0)]) == [[]]


# -- op12 ------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, least=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = H.lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 5 * n[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n), key=repr)


def spelled(seed, documents=60):
    rng = random.Random(seed)
    stems = ["running", "éclairs", "aaaaaaa", "bananas", "straße", "ÀÉÿ×÷ñ", "x" * 300]
    text = []
    for _ in range(documents):
        words = []
        for _ in range(rng.randrange(120)):
            w = list(rng.choice(stems[:6] * 9 + stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "n", "é", "A"])
            words.append("".join(w))
        text.append(rng.choice([" ", "-", "\n", "日", "0"]).join(words))
    return list(enumerate(text))


def test_variants_against_plain_python(spark):
    rows = spelled(4) + [(None, "Running " * 40), (7, None), (8, ""), (9, "0 1"), (10, "abcdef " * 6), (10, "abcdef " * 6)] + [(1000 + i, "commonword " * 3) for i in range(400)]
    df = spark.createDataFrame([(d, t, *H.EXTRA) for d, t in rows], H.SCHEMA).repartition(4)
    got = spelling.variant_groups(df)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    expected = plain_variants(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert any(w[3] for w in expected) and any(w[3] and w[5] != w[3] for w in expected) and max(w[2] for w in expected) > 5
    assert spelling.variant_groups(H.empty(spark)).count() == 0


def test_hot_halves_are_dealt_into_grids(spark):
    words = sorted({w for w, *_ in plain_variants(spelled(5), 1)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted(map(tuple, spelling.near_words(df, shard_rows=100, cell_rows=7).collect()))
    assert got == sorted((w, v, i) for w in words for i, v in enumerate(words) if one_edit(w, v)) and len(got) > 500


def test_short_words_and_pieces(spark, monkeypatch):
    words = ["a", "b", "ab", "ba", "aa", "aab", "aba", "bb"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert sorted((r[0], r[1]) for r in spelling.near_words(df).collect()) == sorted((w, v) for w in words for v in words if one_edit(w, v))
    monkeypatch.setattr(spelling, "PIECE", 5)
    assert sum(spelling.runs("Abc défghĀij k" * 9), []) == [w.encode("latin-1") for w in ["abc", "défgh", "ij", *["kabc", "défgh", "ij"] * 8, "k"]]


def test_wavelet_tree_reports_a_rectangle():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        a, b, c, d = (rng.integers(0, n + 1, 200) for _ in range(4))
        query, value = spelling.Wavelet(values).report(a, b, c, d)
        assert sorted(zip(query.tolist(), value.tolist())) == sorted((i, v) for i in range(200) for v in values[a[i] : b[i]].tolist() if c[i] <= v < d[i])


# -- op13 ------------------------------------------------------------------------------------------


def plain_divergence(rows, limit=200):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", t or "") for a, b, t in rows):
        found = [H.lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(found)
        held[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, h in held[lang].items() if h >= 3]
        p = {}
        for s in [*sources, None]:
            n = {t: sum(counts[lang, x][t] for x in (sources if s is None else [s])) for t in kept}
            p[s] = {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, ranked in (("pair", sorted(pair)), ("term", sorted(term)[:limit])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_against_plain_python(spark):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("Wort", "été", "日本", "x") for b in "abcdefghij"]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["src0"] * 6 + [f"s{j}" for j in range(9)] + [None])
        rows.append((lang, source, rng.choice([" ", "1", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(60)))))
    rows += [("en", "blank", None), ("fr", "one", "seul seul"), ("fr", "two", ""), ("it", "only", "uno uno")] + [("es", f"t{i}", "igual otro " + "más " * i) for i in range(4)] * 2
    df = spark.createDataFrame([(i, t, la, s, *H.EXTRA[2:]) for i, (la, s, t) in enumerate(rows)], H.SCHEMA).repartition(5)
    got = divergence.divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)
    assert sorted(map(tuple, divergence.divergence(df, limit=5).collect())) == plain_divergence(rows, 5)
    assert divergence.divergence(H.empty(spark)).count() == 0


def test_many_sources_fill_several_blocks(spark):
    rng = random.Random(8)
    rows = [("en", f"host{i % 300}", " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "rare"], [5, 4, 3, 2, 0.1], k=4))) for i in range(900)]
    df = spark.createDataFrame([(i, t, la, s, *H.EXTRA[2:]) for i, (la, s, t) in enumerate(rows)], H.SCHEMA).repartition(5)
    assert sorted(map(tuple, divergence.divergence(df).collect())) == plain_divergence(rows)


@pytest.mark.parametrize("most", [40, 1 << 18])
def test_pairs_of_many_terms_are_reckoned_at_once(monkeypatch, most):
    rng = random.Random(10)
    side = lambda: [{"slot": s, "p": rng.randrange(1, 10**9), "base": rng.randrange(1, 10**6)} for s in sorted(rng.sample(range(256), rng.randrange(1, 9)))]
    rows = [(lang, i, j, here, here if i == j else side()) for lang in "ab" for i, j in ((0, 0), (0, 1), (1, 0)) for _ in range(60) for here in [side()]]
    rng.shuffle(rows)
    item = pa.list_(pa.struct([(n, pa.int64()) for n in ("slot", "p", "base")]))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), item, item))], names=["lang", "i", "j", "here", "there"])
    calls, f = [], divergence._f
    monkeypatch.setattr(divergence, "_f", lambda p, q: calls.append(1) or f(p, q))
    monkeypatch.setattr(divergence, "PAIRS", most)
    expected, plain = Counter(), lambda p, q: (p - q) ** 2 // q
    for lang, i, j, here, there in rows:
        for x in here:
            for y in there:
                if i != j or x["slot"] != y["slot"]:
                    expected[lang, i * 256 + x["slot"], j * 256 + y["slot"]] += plain(x["p"], y["p"]) - plain(x["p"], y["base"]) - plain(x["base"], y["p"]) + plain(x["base"], y["base"])
    got = [tuple(r.values()) for out in divergence._two_sided([batch.slice(0, 100), batch.slice(100)]) for r in out.to_pylist()]
    assert {r[:3]: r[3] for r in got} == {k: v for k, v in expected.items() if v}
    assert most == 40 or len(calls) == 4 * 2 * 6  # before: four for each row


@pytest.mark.parametrize("limit", [1, 3, 10, 1000])
def test_radix_select_with_ties(spark, limit):
    rng = random.Random(9)
    rows = [(g, rng.choice([0, 1, 70_000, 70_001, 2**40, 2**62]), w) for g in "abc" for w in {rng.choice(["é", "z", "long" * 9, ""]) + rng.choice("abcdé") * rng.randrange(20) for _ in range(90)}]
    df = spark.createDataFrame(rows, "g string, v long, w string")
    got = defaultdict(set)
    for r in divergence.radix_select(df, ["g"], "v", "w", limit).collect():
        got[r["g"]].add((r["v"], r["w"]))
    for g in "abc":
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:limit]
        assert got[g] == {(v, w) for _, v, w in best}
