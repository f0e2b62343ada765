"""Line files that grow, and files that are chosen before they are opened."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spindle.sources import grown
from spindle.sources import note_files
from spindle.sources import transcripts as R
from spindle.sources.shared import local_path
from spindle.streaming import sync

from .test_pipelines import UUID, document, event, texts


def files_read(df):
    """How many files the scans of a plan have opened, by Spark's own metric."""
    df = df.select("*")  # a plan that has not run yet
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while "Adaptive" in plan.getClass().getName():
        plan = plan.executedPlan()
    leaves, n = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getName() else leaf
        inner = leaf.collectLeaves()
        for j in range(inner.size()):
            if inner.apply(j).metrics().contains("numFiles"):
                n += inner.apply(j).metrics().apply("numFiles").value()
    return n


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "session_id string")


def test_one_document_of_thousands_is_opened(spark, tmp_path):
    docs, logs = tmp_path / "docs", tmp_path / "logs"
    docs.mkdir(), logs.mkdir()
    for i in range(2000):
        (docs / f"s{i}.json").write_text('{"source":"claude","timestamp":"2026-04-06","messages":[]}')
        (logs / f"s{i}.jsonl").write_text(event(f"s{i}", "user", "hello"))
    document(docs, "odd [x] {y} *+%é", "claude", "2026-04-06", ("user", "hello"))
    wanted = ids(spark, "s7", "odd [x] {y} *+%é", "gone")
    found = R.session_documents(spark, str(docs), wanted)
    assert sorted(r["session_id"] for r in found.collect()) == ["odd [x] {y} *+%é", "s7"] and files_read(found) == 2
    assert R.session_documents(spark, str(docs), ids(spark)).count() == 0
    lines = R._lines(spark, str(logs), "*.jsonl", R._keyed(R.listed(spark, str(logs), "*.jsonl"), ".jsonl", ids(spark, "s5", "s6", "gone"), ids(spark, "s6")))
    assert [r["file"] for r in lines.collect()] == ["s5.jsonl"] and files_read(lines) == 1
    assert {r["session_id"] for r in R.event_log_documents(spark, str(logs), wanted=ids(spark, "s5", "s6"), held=ids(spark, "s6")).collect()} == {"s5"}


def test_many_chosen_files_are_joined(spark, tmp_path, monkeypatch):
    for i in range(9):
        document(tmp_path, f"s{i}", "claude", "2026-04-06", ("user", "hello"))
    monkeypatch.setattr(R, "NAMED", 3)
    found = R.session_documents(spark, str(tmp_path), ids(spark, *(f"s{i}" for i in range(5))))
    assert sorted(r["session_id"] for r in found.collect()) == [f"s{i}" for i in range(5)]


def test_a_hook_run_opens_one_document_and_no_other_log(spark, tmp_path, monkeypatch):
    docs, logs, notes = (tmp_path / n for n in ("docs", "logs", "notes"))
    for folder in (docs, logs, notes):
        folder.mkdir()
    for i in range(300):
        document(docs, f"crane-{i}", "claude", "2026-04-06T10:00:00Z", ("user", f"how tall is crane {i}"))
        (logs / f"crane-{i}.jsonl").write_text(event(f"crane-{i}", "user", "from the log"))
    (docs / "crane-8.json").write_text("{ torn")
    os.remove(docs / "crane-9.json")
    opened, real = [], R._of_files
    monkeypatch.setattr(R, "_of_files", lambda found, chosen: (opened.append(out := real(found, chosen)), out)[1])
    run = lambda *names: {r["action"]: r["sessions"] for r in sync.sync_sessions_now(spark, "unused", str(docs), str(logs), str(notes), ids(spark, *names)).collect()}
    assert run("crane-7") == {"created": 1} and [files_read(x) for x in opened] == [1]
    opened.clear()
    assert run("crane-7", "crane-8", "crane-9", "gone") == {"unchanged": 1, "created": 2, "failed": 1}
    assert [files_read(x) for x in opened] == [2, 2]  # the torn document too; the logs of two sessions
    assert len(texts(notes)) == 3


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_files_are_read_in_ranges(spark, tmp_path, end):
    rng = random.Random(3)
    lines = [rng.choice(["", "{torn", "[1]", json.dumps({"n": i, "t": "é日" * rng.randrange(40)}, ensure_ascii=False)]) for i in range(800)]
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + end.join(lines).encode() + b'\n{"n":-1,"t":"\xff"}')
    (tmp_path / "b.jsonl").write_text('{"n":7}\n' * 50)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        found = R._lines(spark, str(tmp_path), "*.jsonl").select("file", "place", F.col("v").cast("string").alias("v"))
        assert found.rdd.getNumPartitions() > 20
        rows = sorted((r["file"], r["place"], json.loads(r["v"])) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    expected = [json.loads(x) for x in lines if x.startswith('{"n"')] + [{"n": -1, "t": "�"}]
    assert [v for f, _, v in rows if f == "a.jsonl"] == expected and len(rows) == len(expected) + 50
    assert len({(f, p) for f, p, _ in rows}) == len(rows)


def test_small_files_share_tasks_with_large_ones_in_ranges(spark, tmp_path, monkeypatch):
    for i in range(600):
        (tmp_path / f"{i}.jsonl").write_bytes(b'\xef\xbb\xbf{"n":%d}\r\n\n{torn\r{"n":-1,"t":"\xff\xe2\x80\xa8"}' % i)
        (tmp_path / f"{i}.md").write_text(f"---\nsession_id: s{i}\nmsg_count: 1\n---\n")
        (tmp_path / f"{i}.json").write_text("{}")
    monkeypatch.setattr(R, "SMALL_FILE", 1000)
    (tmp_path / "large.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(1000)))
    most = 4 * spark.sparkContext.defaultParallelism
    lines = R._lines(spark, str(tmp_path), "*.jsonl")
    # Spark itself deals 600 such files to 19 tasks; here those of one file more are added.
    assert lines.rdd.getNumPartitions() <= most + 4 and R.notes_snapshot(spark, str(tmp_path)).rdd.getNumPartitions() <= most and R.session_documents(spark, str(tmp_path)).rdd.getNumPartitions() <= most
    rows = sorted((r["file"], r["place"], json.loads(r["v"])) for r in lines.select("file", "place", F.col("v").cast("string").alias("v")).collect())
    assert [v["n"] for f, _, v in rows if f == "large.jsonl"] == list(range(1000)) and len(rows) == 2200
    assert [v for f, _, v in rows if f == "7.jsonl"] == [{"n": 7}, {"n": -1, "t": "\ufffd\u2028"}]
    assert len({(f, p) for f, p, _ in rows}) == len(rows)


def test_ranges_of_a_file_hold_each_line_once(tmp_path):
    rng = random.Random(4)
    path = tmp_path / "f"
    for _ in range(30):
        lines = ["é" * rng.randrange(9) + rng.choice(["", "\r", "\rx"]) for _ in range(rng.randrange(40))]
        torn = rng.choice(["", "torn"])
        data = ("\n".join(lines) + "\n" + torn).encode() if lines else torn.encode()
        path.write_bytes(data)
        end = (grown.whole_lines(str(path)) or (0, 0))[0]
        assert end == len(data) - len(torn)
        cuts = sorted({0, end, *(rng.randrange(end + 1) for _ in range(5))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in grown.lines_between(str(path), a, b)]
        assert [t for _, t in got] == [p for x in lines for p in x.split("\r") if p]
        assert all(data[at:].startswith(t.encode()) for at, t in got)
    assert grown.whole_lines(os.devnull) is None


def test_a_line_end_far_from_the_end_is_found(tmp_path, monkeypatch):
    monkeypatch.setattr(grown, "STEP", 7)
    (tmp_path / "f").write_bytes(b"a\n" + b"x" * 100)
    assert grown.whole_lines(str(tmp_path / "f"))[0] == 2


def test_batches_hold_what_came_since(tmp_path):
    path, before = tmp_path / "a.log", {}
    reader = grown._Reader({"path": str(tmp_path), "pattern": "*.log", "range": "10"})

    def batch(again=None):
        nonlocal before
        now = json.loads(json.dumps(reader.latestOffset()))
        parts = (again or reader).partitions(before, now)
        before = now
        assert all(sum(b - a for _, a, b, _ in p.ranges) <= 10 for p in parts)
        return [(line, anew) for p in parts for _, _, anew, line in reader.read(p)]

    assert batch() == []
    path.write_text("one line\nand another, which is longer\ntorn")
    assert batch() == [("one line", True), ("and another, which is longer", True)]
    assert batch() == []
    with path.open("a") as f:
        f.write(" no more\nlast\n")
    fresh = grown._Reader({"path": str(tmp_path), "pattern": "*.log", "range": "10"})  # after a restart
    assert batch(fresh) == [("torn no more", False), ("last", False)]
    path.write_text("one line\nshort\n")  # truncated
    assert batch() == [("one line", True), ("short", True)]
    path.write_text("other line\nand much more than before\n")  # replaced
    assert batch() == [("other line", True), ("and much more than before", True)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.log").write_text("b\n")
    (tmp_path / "c.txt").write_text("c\n")
    os.symlink(path, tmp_path / "link.log")
    os.remove(path)
    assert batch() == [("b", True)]
    path.write_text("other line\n")  # it comes back
    assert batch() == [("other line", True)]


def rollout(text, role="user"):
    return json.dumps({"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}})


META = json.dumps({"type": "session_meta", "timestamp": "2026-03-01T09:00:01Z", "payload": {"id": UUID}})


def test_rollouts_are_followed_as_they_grow(spark, tmp_path):
    logs, notes, table = (tmp_path / n for n in ("in", "notes", "table"))
    logs.mkdir()
    path = logs / "rollout-1.jsonl"

    def follow():
        sync.follow_rollouts(spark, str(logs), str(notes), str(table), str(tmp_path / "cp")).awaitTermination()
        return next(iter(texts(notes).values()), None)

    lines = lambda n: spark.read.parquet(f"{table}/events/batch={n}").count()
    path.write_text("\n".join([META, rollout("a first question"), "{bad", rollout("torn")]))
    assert follow().endswith("msg_count: 1\ntags:\n  - codex\n---\n\n# a first question\n\n## Q1\na first question\n\n") and lines(0) == 2
    with path.open("a") as f:
        f.write("\n" + rollout("an answer", "assistant") + "\n")
    body = follow()
    assert "msg_count: 3" in body and body.endswith("## Q2\ntorn\n\n## A1\nan answer\n\n") and lines(1) == 2
    assert follow() == body and not (table / "events" / "batch=2").exists()
    # Another file of the same session counts if its path is smaller, and only then.
    (logs / "rollout-2.jsonl").write_text("\n".join([META, rollout("ignored")] * 5) + "\n")
    assert follow() == body
    # The same batch once more changes nothing.
    with note_files.lock(note_files.guard(str(notes))) as mine:
        assert mine
        with path.open("a") as f:
            f.write(rollout("one more") + "\n")
        with pytest.raises(Exception, match="another run holds"):
            follow()
    assert follow() == body.replace("msg_count: 3", "msg_count: 4") + "## Q3\none more\n\n"
    # A file that is begun anew replaces what came before.
    path.write_text("\n".join([META, rollout("new")]) + "\n")
    assert "msg_count: 4" in follow()
    path.write_text("\n".join([META, *(rollout(f"new {i}") for i in range(6))]) + "\n")
    assert follow().endswith("## Q4\nnew 4\n\n## Q5\nnew 5\n\n")


def test_paths_of_shared_folders():
    assert local_path("file:///a/b") == local_path("file:/a/b") == local_path("/a/b") == "/a/b" and local_path("a/b:c") == "a/b:c"
    with pytest.raises(ValueError):
        local_path("hdfs://host/a")


def test_exports_are_read_by_objects(spark, tmp_path):
    """In ranges of a few hundred bytes: braces, quotes and escapes in strings, nested arrays, odd elements."""
    rng = random.Random(5)
    odd = ["}", "{", "]", "[", '"', "\\", '\\"', "\\\\}", "é", "日", "\n", ",", "x" * 30, "}{", '"}']
    value = lambda d: rng.choice([rng.randrange(9), "".join(rng.choices(odd, k=rng.randrange(9))), None, True] if d > 3 else [{"".join(rng.choices(odd, k=2)): value(d + 1) for _ in range(rng.randrange(4))}, [value(d + 1) for _ in range(rng.randrange(3))], "".join(rng.choices(odd, k=6))])
    whole = {f"e{k}.json": [{"id": i, "v": value(0)} for i in range(n)] for k, n in enumerate((120, 1, 0, 40))}
    for k, (name, rows) in enumerate(whole.items()):
        (tmp_path / name).write_text(json.dumps(rows, ensure_ascii=k % 2 == 0, indent=2 if k == 3 else None))
    (tmp_path / "mixed.json").write_text('\ufeff [1, "a{b}", {"id":0,"v":{}} , null, [{"id":5}], {"id":1,"v":[{}]}]')
    (tmp_path / "object.json").write_text('{"a":{"id":0},"b":[{"id":1}]}')
    (tmp_path / "torn.json").write_text('[{"id":0,"v":1},{"id":1,"v":"}')
    (tmp_path / "empty.json").write_text("")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301")
    try:
        rows = [tuple(r) for r in R.array_objects(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    got = {}
    for file, at, text in sorted(rows):
        got.setdefault(file, []).append(json.loads(text))
        assert at == len(got[file]) - 1
    assert got == {f: r for f, r in whole.items() if r} | {"mixed.json": [{"id": 0, "v": {}}, {"id": 1, "v": [{}]}], "torn.json": [{"id": 0, "v": 1}]}


def test_an_object_may_fill_many_ranges(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"title": "a", "create_time": 1.5, "mapping": {"n": {"message": {"author": {"role": "user"}, "content": {"parts": ["}" * 5000]}, "create_time": 2}}}}, {"title": None, "mapping": {}}, {"no": "conversation"}]))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        found = R.export_conversations(spark, str(tmp_path))
        assert [(r["at"], r["title"]) for r in found.orderBy("at").collect()] == [(0, "a"), (1, "Untitled")]
        assert [r["text"] for r in R.export_messages(found).collect()] == ["}" * 5000]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "rollout-a.jsonl").write_text('{"type": "session_meta", "payload": {"id": "x"}}\n[1]\n{bad')
    events = R.rollout_events(R.rollout_lines(spark, str(tmp_path)))
    assert [r.session.session_id for r in events.collect()] == ["x"]
    assert events._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
