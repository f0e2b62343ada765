import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindle.llm import decontaminate, quality_cnn, secret_scan, toxicity

from . import helpers as H

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans_of(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out += [(m.start(), 3, "pem", m.end()) for m in re.finditer("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", text)]
    return sorted(out)


PARTS = ["password", "Token", "API_KEY", "apikey", "secret", "=", ": ", ' = "', "'", "abc123", "x", "😀", " ", "\n", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "-----BEGIN RSA PRIVATE KEY-----", "token:token:abcdefgh"]


def secret_rows():
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))) for i in range(200)]
    return rows + [(None, None), (None, "password=abcdefg"), (1, ""), (2, rows[2][1]), (300, "password=abcdefg " * 5000)]


def shown(found):
    return sorted(repr((r["doc_id"], [(s["start"], s["rank"], s["kind"], s["stop"]) for s in r["spans"]])) for r in found.collect())


def test_secrets(spark, tmp_path):
    rows = secret_rows()
    df = spark.createDataFrame([(*r, *H.EXTRA) for r in rows], H.SCHEMA).repartition(4)
    found = secret_scan.secret_scan(df, str(tmp_path / "ledger"))
    assert shown(found) == sorted(repr((d, spans_of(t))) for d, t in rows)
    assert secret_scan.read_ledger(spark, str(tmp_path / "ledger")).count() == len({t or "" for _, t in rows}) * len(secret_scan.RULES)
    assert secret_scan.secret_scan(H.empty(spark), str(tmp_path / "other")).count() == 0


@pytest.mark.parametrize("few", [0, secret_scan.FEW])
def test_secrets_are_scanned_once(spark, tmp_path, few, monkeypatch):
    monkeypatch.setattr(secret_scan, "FEW", few)
    rows, path = secret_rows(), str(tmp_path / "ledger")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = secret_scan.update_ledger(df.where("doc_id < 100"), path)
    fresh = secret_scan.scan_unseen(df, first)
    assert fresh.join(first, ["blob", "rule"]).count() == 0
    assert fresh.count() + first.count() == len({t or "" for _, t in rows}) * len(secret_scan.RULES)
    assert shown(secret_scan.secret_scan(df, path)) == sorted(repr((d, spans_of(t))) for d, t in rows)
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", 2, r"[0-9a-f]{32,}", 0, 32))
    again = secret_scan.scan_unseen(df, secret_scan.read_ledger(spark, path), newer)
    assert {r["rule"] for r in again.select("rule").distinct().collect()} == {"hex@2"}


def test_an_append_that_is_repeated_changes_nothing(spark, tmp_path):
    rows, path = secret_rows(), str(tmp_path / "ledger")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = shown(secret_scan.secret_scan(df, path))
    held = secret_scan.read_ledger(spark, path).count()
    assert shown(secret_scan.secret_scan(df, path)) == before and secret_scan.read_ledger(spark, path).count() == held
    spark.createDataFrame(secret_scan.read_ledger(spark, path).collect(), secret_scan.LEDGER_SCHEMA).write.mode("append").parquet(path)  # a retried job
    assert secret_scan.read_ledger(spark, path).count() == 2 * held
    assert shown(secret_scan.findings(df, secret_scan.read_ledger(spark, path))) == before
    assert secret_scan.unseen(df, secret_scan.read_ledger(spark, path)).count() == 0


def test_every_version_of_a_path_gets_its_findings(spark, tmp_path):
    history = [("a.py", 1, "x = 1"), ("a.py", 2, "token = 'abcdef123'"), ("a.py", 3, "x = 1"), ("b.py", 1, "token = 'abcdef123'"), ("b.py", 2, None)]
    df = spark.createDataFrame(history, "path string, version int, text string")
    found = secret_scan.secret_scan(df, str(tmp_path / "ledger"), id_col="path", carry=("version",))
    assert sorted((r["doc_id"], r["version"], len(r["spans"])) for r in found.collect()) == [("a.py", 1, 0), ("a.py", 2, 1), ("a.py", 3, 0), ("b.py", 1, 1), ("b.py", 2, 0)]
    assert secret_scan.read_ledger(spark, str(tmp_path / "ledger")).select("blob").distinct().count() == 3


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(H.words(1000 + i, 40))) for i in range(6)] + [(6, "Short one"), (7, None), (8, "?!")]
    noise = lambda s: " ".join(H.words(s, 150, 3000))

    def edited(text, share):
        w = text.split()
        for i in rng.sample(range(len(w)), int(len(w) * share)):
            w[i] = f"z{rng.randrange(10**9)}"
        return " ".join(w)

    docs = [(1, noise(1) + " " + items[0][1].upper() + ". " + noise(2)), (2, noise(3) + " " + edited(items[1][1], 0.15) + " " + noise(4)), (3, edited(items[2][1], 0.4)), (4, noise(5)), (5, None), (6, ""), (None, items[3][1]), (7, items[4][1]), (7, items[4][1]), (8, "a short, ONE here"), (9, " ".join(items[5][1].split()[:20]))]
    df = spark.createDataFrame([(*r, *H.EXTRA) for r in docs], H.SCHEMA).repartition(3)
    bench = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, mark string, words int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.decontaminate(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (None, 3), (7, 4), (8, 6)}
    assert (got[1, 0]["similarity"], got[1, 0]["start_word"], got[1, 0]["stop_word"]) == (1.0, 150, 190)
    assert 0.8 <= got[2, 1]["similarity"] < 1
    assert decontaminate.decontaminate(H.empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == 0


def test_decontamination_of_hot_items(spark):
    """Items that very many documents hold: verbatim, edited every fifth word, edited in one place, of four words."""
    long, four, six = H.words(2001, 20, 10**6), "only these four words", "six words with one more edit"
    every_fifth = " ".join("edited" if i % 5 == 4 else w for i, w in enumerate(long))
    rows = [(i, f"before{i} {' '.join(long)} after{i}") for i in range(30)] + [(100 + i, f"x{i} {four} y{i}") for i in range(30)] + [(200 + i, f"u{i} {six} v{i}") for i in range(30)]
    rows += [(300, f"p q {every_fifth} r s"), (301, "m six words changed one more edit n"), (302, "k " + " ".join(long[:3]) + " far away " * 30 + " ".join(long[10:13]))]
    bench = spark.createDataFrame([(0, " ".join(long)), (1, four), (2, six)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {(i, 0) for i in range(30)} | {(100 + i, 1) for i in range(30)} | {(200 + i, 2) for i in range(30)} | {(300, 0), (301, 2)}


def similarity(item, text):
    w = decontaminate.word_hashes
    score, matches, columns, *_ = decontaminate.align(w(item), w(text))
    return matches / columns if score >= 0 else 0


def altered(rng, words, share):
    """Words changed, dropped and put in at random places."""
    out = []
    for w in words:
        kind = rng.choice("cdi") if rng.random() < share else ""
        out += {"": [w], "c": [f"z{rng.randrange(10**6)}"], "d": [], "i": [f"y{rng.randrange(10**6)}", w]}[kind]
    return out


def test_edited_copies_against_full_alignment(spark):
    """All pairs of items and documents aligned in full; items of every length, up to a fifth edited."""
    rng = random.Random(12)
    common = H.words(1, 40, 60)
    items = [(i, " ".join(H.words(3000 + i, 1 + i % 30, 5000) if i % 3 else rng.choices(common, k=4 + i % 30))) for i in range(90)]
    docs = []
    for d in range(500):
        own = altered(rng, rng.choice(items)[1].split(), rng.choice([0, 0.05, 0.1, 0.15, 0.2]))
        docs.append((d, " ".join([*H.words(7000 + d, rng.randrange(20), 900), *own, *H.words(8000 + d, rng.randrange(20), 900)])))
    expected = {(d, i): s for d, t in docs for i, item in items if (s := similarity(item, t)) >= 0.8}
    assert len(expected) > 300 and min(expected.values()) < 0.82
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == expected


def test_more_copied_words_never_clear_a_document(spark):
    """The first sixteen of an item's twenty words are a copy at 0.8, whatever follows them."""
    item = H.words(41, 20, 10**6)
    other, noise = H.words(42, 7, 10**6), H.words(43, 200, 10**6)
    texts = [item[:16], item[:16] + other + item[16:], item[:16] + other + item[12:] + other + item[:3], noise + item[:16] + noise + item[:14], item[:15] + other + item[15:], item[5:] + other + item[:5]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    alone = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["similarity"] for r in decontaminate.decontaminate(docs, alone).collect()}
    assert got == {i: 0.8 for i in range(4)}


def test_items_that_repeat_are_aligned_once(spark, monkeypatch):
    item, other = " ".join(H.words(44, 12, 10**6)), " ".join(H.words(45, 12, 10**6))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, item + " " + other), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, item) for i in range(30)] + [(i, item.upper() + "!") for i in range(20, 50)] + [(7, other), (None, item)], "item_id long, text string")
    rows, real = [], decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, label: (rows.append((label, out := real(df, label))), out)[1])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {(d, i) for d in (1, 2) for i in (*range(50), None)}
    held = dict(rows)
    assert held["items"].count() == 2 and held["candidates"].select(F.explode("items")).count() == 3


def test_seed_plans_hold_for_all_edits():
    """Whatever words of an item are changed, dropped or put in, the promised number of runs stays."""
    for n in range(1, 9):
        for t in (0.6, 0.8, 1.0):
            size, take, need = decontaminate.seed_plan(n, t)
            runs = [tuple(range(i, i + size)) for i in range(n - size + 1)]
            assert need >= 1 and need <= take <= len(runs)
            for edits in itertools.product("kcdi", repeat=n):
                text = [x for i, e in enumerate(edits) for x in {"k": [i], "c": [-1], "d": [], "i": [-1, i]}[e]]
                matched = sum(e in "ki" for e in edits)
                if matched < t * (n + edits.count("i")):
                    continue
                there = {tuple(text[i : i + size]) for i in range(len(text))}
                lost = sum(r not in there for r in runs)
                assert take - lost >= need


@pytest.mark.parametrize("copies", [5, 40, 1000])
def test_a_leak_is_found_however_far_it_spread(spark, copies):
    rng, item, five = random.Random(3), H.words(31, 15, 10**6), "one two three four five"
    text = lambda i: " ".join([f"a{i}", *(f"e{i}" if j % 5 == 3 else w for j, w in enumerate(item)), f"b{rng.randrange(99)}"])
    docs = [(i, text(i)) for i in range(copies)] + [(10_000 + i, f"c{i} one two changed{i} four five d") for i in range(copies)]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, five)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench, items_a_row=1).collect()}
    assert got == {(i, 0) for i in range(copies)} | {(10_000 + i, 1) for i in range(copies)}


def test_a_document_that_is_a_benchmark(spark):
    items = [(i, " ".join(H.words(i, 12, 10**6))) for i in range(900)]
    docs = spark.createDataFrame([(1, "\n".join(t for _, t in items)), (2, items[5][1])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, i) for i, _ in items} | {(2, 5)}


def plain_alignment(a, b):
    """The best of 5 x matches - 4 x columns over all alignments of a with a part of b."""
    table = [[0] * (len(b) + 1)]
    for i in range(1, len(a) + 1):
        table.append([-4 * i])
        for j in range(1, len(b) + 1):
            table[i].append(max(table[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -4), table[i - 1][j] - 4, table[i][j - 1] - 4))
    return max(table[-1])


def test_alignment_scores():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(low, 12))] for low in (1, 0))
        score, matches, columns, start, stop = decontaminate.align(np.array(a), np.array(b))
        assert score == plain_alignment(a, b) == 5 * matches - 4 * columns
        assert 0 <= start <= stop <= len(b) and matches <= min(columns, stop - start) and columns >= max(len(a), stop - start)


def labelled(n, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = H.words(5000 + i, rng.randrange(20, 200), 2000)
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(2, 9) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["vilething", "vilestuff", "badword", "grimword"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(d, t, *H.EXTRA) for d, t, _ in rows], H.SCHEMA)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows[:600]] + [(None, 1), (5000, 1), (700, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert np.all(np.diff(model.thresholds) >= 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = rows[600:]
    assert sum(got[d]["_toxic"] for d, _, y in held if y) >= 0.95 * sum(y for *_, y in held)
    assert not any(got[d]["_toxic"] for d, _, y in held if not y)
    score = model.scorer()
    for d, t, _ in rows[:50]:
        severity, p = score(t)
        assert abs(got[d]["_severity"] - severity) < 1e-9 and abs(severity - p.sum()) < 1e-9
    milder, worse = "vilething " * 1 + "calm text", "vilething vilestuff badword grimword calm text"
    assert score(milder)[0] < score(worse)[0]
    odd = toxicity.score(H.messy(spark), model)
    assert odd.count() == len(H.messy_rows()) and not odd.where("_toxic").count() and odd.columns[:-3] == H.messy(spark).columns
    assert toxicity.score(H.empty(spark), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert not toxicity.score(docs, none).where("_toxic").count()


def plain_severity(model, text):
    """Expected grade by definition: distinct words and their prefixes, one weight vector, P(grade >= k)
    of each threshold, summed."""
    own = set()
    for w in re.findall(r"\w+", (text or "").lower()):
        own |= {xxhash.xxh3_64_intdigest(x) % (1 << 20) for x in ("=" + w, *(w[:n] for n in (3, 4, 5) if len(w) > n))}
    x = sum(model.index.get(f, 0.0) for f in own)
    return sum(1 / (1 + math.exp(theta - x)) for theta in model.thresholds), 1 / (1 + math.exp(model.thresholds[0] - x))


def test_severities_by_definition(spark):
    rows = labelled(300, 9) + [(900, None, 0), (901, "", 0), (902, "VileThing! vilestuff\n" * 3000, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    texts = {d: t for d, t, _ in rows}
    for r in toxicity.score(docs, model).collect():
        severity, toxic = plain_severity(model, texts[r["doc_id"]])
        assert abs(r["_severity"] - severity) < 1e-9 and abs(r["_p_toxic"] - toxic) < 1e-9 and r["_toxic"] == (toxic >= 0.3)


def test_the_fit_is_near_the_best_likelihood():
    """Against a plain search over all parameters of a case with two features and three grades."""
    rng = random.Random(5)
    docs, grade = [], []
    for _ in range(400):
        own = [f for f in (10, 20) if rng.random() < 0.5]
        p = 1 / (1 + math.exp(2 - 1.5 * (10 in own) - 2.5 * (20 in own)))
        docs.append(np.array(own, np.int64))
        grade.append(sum(rng.random() < p for _ in range(2)))

    def loss(w1, w2, t1, t2):
        total = 0.0
        for f, g in zip(docs, grade):
            x = w1 * (10 in f) + w2 * (20 in f)
            for k, t in ((1, t1), (2, t2)):
                total += math.log1p(math.exp((t - x) if g >= k else (x - t)))
        return total / len(docs)

    model = toxicity.fit(docs, np.array(grade), z_least=2.0)
    own = [model.index.get(10, 0.0), model.index.get(20, 0.0), *model.thresholds]
    best, step = list(own), 0.5
    while step > 0.01:  # downhill from there, one parameter after the other
        moved = False
        for i in range(4):
            for sign in (-1, 1):
                tried = list(best)
                tried[i] += sign * step
                if loss(*tried) < loss(*best):
                    best, moved = tried, True
        step = step if moved else step / 2
    assert loss(*own) <= loss(*best) + 0.005


def test_graded_labels(spark):
    rows = [(i, " ".join(["calm"] * 3 + [f"bad{k}xx" for k in range(i % 4)]), i % 4) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, graded=True)
    severities = [model.scorer()(" ".join(f"bad{k}xx" for k in range(g)))[0] for g in range(4)]
    assert severities == sorted(severities) and severities[0] < 0.5 and severities[3] > 2


def test_quality(spark):
    rng, rows = random.Random(7), []
    for i in range(500):
        good = rng.random() < 0.7
        w = H.words(9000 + i, rng.randrange(5, 300))
        rows.append((i, " ".join(w if good else [x + rng.choice(["***", "$$$"]) for x in w]), int(good)))
    docs = spark.createDataFrame([(d, t, *H.EXTRA) for d, t, _ in rows], H.SCHEMA)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")
    net = quality_cnn.train(docs, labels, allowed=quality_cnn.fold(F.col("doc_id")) != 0, epochs=6)
    got = {r["doc_id"]: r for r in quality_cnn.score(docs, net).collect()}
    import zlib

    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 50 and sum(got[d]["predicted"] == y for d, _, y in held) >= 0.95 * len(held)
    assert all(abs(got[d]["score"] - net.score(t.encode())) < 1e-6 for d, t, _ in rows[:30])
    odd = quality_cnn.score(H.messy(spark), net)
    assert odd.count() == len(H.messy_rows()) and odd.where("score BETWEEN 0 AND 1").count() == len(H.messy_rows())
    assert quality_cnn.score(H.empty(spark), net).count() == 0
    assert quality_cnn.train(docs, labels.limit(0)).score(b"") == 0.5


def test_a_very_long_labelled_text_keeps_no_other_out(spark):
    """A text of 3 MB, at the lowest hash of its label, whose bytes are those of the other label at that."""
    rng = random.Random(9)
    word = lambda good: f"w{rng.randrange(999)}" + ("" if good else rng.choice(["***", "$$$"]))
    rows = [(i, " ".join(word(i % 2) for _ in range(rng.randrange(80, 300))), i % 2) for i in range(80)]
    order = {r[0]: r[1] for r in spark.range(80).select("id", F.xxhash64("id")).collect()}
    for label in (0, 1):
        first = min((i for i in range(80) if i % 2 == label), key=order.get)
        for long in ([first], [i for i in range(80) if i % 2 == label]):
            made = [(i, " ".join(word(1 - label) for _ in range(600_000 if i == first else 20_000)) if i in long else t, y) for i, t, y in rows]
            docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
            labels = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, quality int")
            net = quality_cnn.train(docs, labels, sample=60)
            assert net.out[:-1].any()
            if len(long) == 1:
                good, bad = (np.median([net.score(t.encode()) for i, t, y in rows if y == label]) for label in (1, 0))
                assert good > 0.7 and bad < 0.3
    only = quality_cnn.train(docs, labels.where("quality = 1"))
    assert only.score(b"") > 0.9
    with pytest.raises(ValueError):
        quality_cnn.train(docs, labels, most_bytes=40_000)


def test_stretches_of_a_long_text_come_from_all_over_it(spark):
    text = "".join(chr(97 + i * 26 // 200_000) for i in range(200_000))
    df = spark.createDataFrame([(text,), (text[:4096],), ("",)], "t string").select(quality_cnn._spread_out(F.encode("t", "UTF-8"), 26 * 512).alias("b"))
    long, short, none = (bytes(r["b"]) for r in df.collect())
    assert len(long) == 26 * 512 and set(long.decode()) == set(text) and long[:512] == text[:512].encode() and long[-512:] == text[-512:].encode()
    assert short == text[:4096].encode() and none == b""


def test_toxicity_learns_beside_a_very_long_text(spark):
    rows = labelled(200)
    long = " ".join(f"w{i % 4000}q" for i in range(300_000))
    docs = spark.createDataFrame([(-i, long) for i in (1, 2)] + [r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(-1, 0), (-2, 1)] + [(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    score = toxicity.train(docs, labels).scorer()
    assert all((score(t)[1][0] >= 0.3) == bool(y) for _, t, y in rows)


def test_chunks_cover_every_byte():
    net = quality_cnn.Network(3, 5)
    for n in (0, 1, 511, 512, 513, 991, 992, 993, 5000):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        seen = np.zeros(max(n, 512), bool)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        chunks = net.chunks(data)
        for i, c in enumerate(chunks):
            at = min(i * step, max(n, 512) - 512)
            assert bytes(c) == data.ljust(512, b"\0")[at : at + 512]
            seen[at : at + 512] = True
        assert seen.all()


def plain_forward(net, text):
    """The network by its definition, a byte after the other."""
    data = text.ljust(quality_cnn.CHUNK, b"\0")
    starts = list(range(0, len(data) - quality_cnn.CHUNK, quality_cnn.CHUNK - quality_cnn.OVERLAP)) + [len(data) - quality_cnn.CHUNK]
    width, _, filters = net.table.shape
    pooled = []
    for s in starts:
        chunk = data[s : s + quality_cnn.CHUNK]
        pooled.append([max(0.0, max(sum(float(net.table[k, chunk[i + k], f]) for k in range(width)) for i in range(len(chunk) - width + 1)) + float(net.bias[f])) for f in range(filters)])
    x = [sum(p[f] for p in pooled) / len(pooled) for f in range(filters)] + [max(p[f] for p in pooled) for f in range(filters)] + [1.0]
    return 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(x, net.out))))


def test_scores_are_the_network_s_by_definition(spark):
    net = quality_cnn.Network(3, 4, 2)
    net.bias[:] = [0.1, -0.4, 0.0]
    rng = random.Random(4)
    texts = ["", "é", "x" * 600, *("".join(rng.choice("abc dé.\n") for _ in range(rng.randrange(1300))) for _ in range(6))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_cnn.score(docs, net).collect():
        assert abs(r["score"] - plain_forward(net, texts[r["doc_id"]].encode())) < 1e-5
        assert r["predicted"] == (r["score"] >= 0.3)


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    """Ids that repeat in both tables, with other texts and labels; a bound in bytes."""
    rows = [(i, " ".join(H.words(600 + i, 20))) for i in range(60)] + [(i, " ".join(H.words(900 + i, 30))) for i in range(30)]
    marks = [(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(0, 60, 7)]
    nets, models = [], []
    for k in (1, 4):
        docs = spark.createDataFrame(rows if k == 1 else rows[::-1], "doc_id long, text string").repartition(k)
        labels = spark.createDataFrame(marks if k == 1 else marks[::-1], "doc_id long, y int").repartition(k)
        nets.append(quality_cnn.train(docs, labels, label_col="y", epochs=2, sample=20, most_bytes=2600, longest=1200))
        models.append(toxicity.train(docs, labels, label_col="y", sample=20))
    assert np.array_equal(nets[0].table, nets[1].table) and np.array_equal(models[0].thresholds, models[1].thresholds) and models[0].index == models[1].index


def test_gradients_are_the_loss_s():
    net, texts = quality_cnn.Network(2, 3, 1), [b"some bytes of a text " * 60, b"short"]
    labels, weights = np.array([1.0, 0.0]), np.array([1.0, 0.5])
    table, bias, out = net.gradients([net.chunks(t) for t in texts], labels, weights)
    loss = lambda: -sum(w * np.log(p if y else 1 - p) for p, y, w in zip(map(net.score, texts), labels, weights))
    place, byte, f = np.unravel_index(np.abs(table).argmax(), table.shape)
    for own, grad in ((net.table[place, byte], table[place, byte]), (net.out, out)):
        before, kept = loss(), own[f]
        own[f] += 1e-3
        assert abs((loss() - before) / 1e-3 - grad[f]) < 0.02 * max(1, abs(grad[f]))
        own[f] = kept
    assert bias.shape == (2,)
