"""The pipeline against brute force, stage by stage, on a small corpus with every kind of case."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from spindle.llm import decontaminate, toxicity
from spindle.llm.common import stage

from . import helpers as H
from .test_scans import labelled


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    noise = lambda s, n=60: "\n".join(" ".join(H.words(s * 31 + i, 12, 3000)) for i in range(max(1, n // 12)))
    items = [(i, " ".join(H.words(7000 + i, 30))) for i in range(4)]
    texts = [t for _, t, _ in labelled(300, 5)]
    texts += [noise(i) for i in range(60)]
    shared = noise(999, 48)
    texts += [noise(100 + i) + "\n" + shared + "\n" + noise(200 + i) for i in range(5)]
    texts += [noise(300 + i, 36) + "\n" + items[i % 4][1] + "\n" + noise(400 + i, 36) for i in range(6)]
    base = " ".join(H.words(77, 90, 3000))
    for i in range(8):
        w = base.split()
        w[rng.randrange(90)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[305], texts[306].upper(), "", " ", "short", "short", " ".join(H.words(5, 4000, 5000))]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (None, noise(900), "en", "src1", 1), (None, "short", "en", "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, _, y in labelled(300, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=repr)


def test_stages(spark, corpus):
    folder, items = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, rows_of(docs)
    score = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()

    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, folder), name)
        assert docs.columns == columns
        after = rows_of(docs)
        if name == "toxicity":
            expected = [r for r in before if score(r[1] or "")[1][0] < 0.3]
            assert 0 < len(before) - len(expected) < 120
        elif name == "line_dedup":
            # Ties between rows without an id go by a hash, so only their number is held here.
            cut = H.deduplicated_lines([r[:2] for r in before])
            expected = [(r[0], t, r[2], r[3], len(t)) for r, (_, n, gone, t) in zip(before, cut) if gone < n]
            assert len(after) == len(expected)
            expected, after = ([r for r in x if r[0] is not None] for x in (expected, after))
        elif name == "minhash":
            sets = [H.shingles(r[1], 2) for r in before]
            groups, expected = defaultdict(list), [r for r, s in zip(before, sets) if not s]
            for r, s, f in zip(before, sets, H.components(sets)):
                if s:
                    groups[f].append(r)
            expected += [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
            assert len(expected) < len(before)
        else:
            hashes = [decontaminate.word_hashes(t) for _, t in items]

            def leaks(text):
                w = decontaminate.word_hashes(text or "")
                return any(c and m >= 0.8 * c for _, m, c, *_ in (decontaminate.align(h, w) for h in hashes))

            expected = [r for r in before if not leaks(r[1])]
            assert len(expected) < len(before)
        assert sorted(after, key=repr) == sorted(expected, key=repr)
        before = rows_of(docs)

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len({(r["doc_id"], r["piece"]) for r in packed if r["doc_id"] is not None}) >= len({r[0] for r in before if r[0] is not None})
    used = defaultdict(int)
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


def test_run_gives_the_last_stage_s_rows(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder), name)
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, got.select(*own).collect())) == sorted(map(repr, docs.select(*own).collect()))


def test_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
