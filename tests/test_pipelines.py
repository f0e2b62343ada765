import json
import os

import pytest
from pyspark.sql import functions as F

from spindle.plans import pipelines as P
from spindle.sources import note_files
from spindle.sources import transcripts as R
from spindle.streaming import reminder, sync

FENCE = "`" * 3
UUID = "01234567-89ab-cdef-0123-456789abcdef"


def document(folder, sid, source, stamp, *messages):
    content = {"session_id": sid, "source": source, "cwd": "/w", "timestamp": stamp, "messages": [{"role": r, "content": c, "timestamp": stamp} for r, c in messages]}
    (folder / f"{sid}.json").write_text(json.dumps(content, ensure_ascii=False), encoding="utf-8")


def run(spark, docs, notes, **more):
    held = R.notes_snapshot(spark, str(notes)) if any(notes.iterdir()) else None
    rows = P.sync_sessions(spark, R.session_documents(spark, str(docs)), held, **more)
    return {r["action"]: r["sessions"] for r in P.write(rows, str(notes)).collect()}


def texts(folder):
    return {p.name: p.read_text(encoding="utf-8") for p in folder.iterdir() if not p.name.startswith(".")}


GOLDEN = """---
date: 2026-04-05
title: "\\u30af\\u30eb\\u30df\\u306e\\u53ce\\u7a6b\\u306f\\u3044\\u3064"
source: "Claude Code"
session_id: "walnut-harvest-77"
tags:
  - "claude"
---

# クルミの収穫はいつ

## Q1
クルミの収穫はいつ

## A1
十月の初めです

"""


@pytest.fixture
def folders(tmp_path):
    for n in ("docs", "notes"):
        (tmp_path / n).mkdir()
    return tmp_path / "docs", tmp_path / "notes"


def test_session_is_created_appended_and_left_alone(spark, folders):
    docs, notes = folders
    said = [("user", "クルミの収穫はいつ"), ("assistant", "十月の初めです")]
    document(docs, "walnut-harvest-77", "claude", "2026-04-05T08:30:00Z", *said)
    assert run(spark, docs, notes) == {"created": 1}
    name = "2026-04-05_クルミの収穫はいつ_walnut-h.md"
    assert texts(notes) == {name: GOLDEN}
    document(docs, "walnut-harvest-77", "claude", "2026-04-05T08:30:00Z", *said, ("user", "乾かし方は"), ("assistant", "風通しの良い所で"))
    assert run(spark, docs, notes) == {"appended": 1}
    after = texts(notes)
    assert after == {name: GOLDEN + "## Q2\n乾かし方は\n\n## A2\n風通しの良い所で\n\n"}
    assert run(spark, docs, notes) == {"unchanged": 1}
    assert texts(notes) == after


def test_catalogue_without_sources(spark, folders, tmp_path):
    docs, notes = folders
    document(docs, "heron-1", "claude", "2026-04-06T10:00:00Z", ("user", "where do herons nest"), ("assistant", "x"))
    document(docs, "heron-2", "codex", "2026-04-06T10:00:00Z", ("user", "and in the winter"), ("assistant", "y"))
    listed = tmp_path / "list.txt"
    listed.write_text(json.dumps({"sessions": [{"session_id": "heron-1"}, {"session_id": "heron-2"}, {"session_id": "gone"}]}))
    wanted = R.session_catalogue(spark, str(listed))
    rows = P.sync_sessions(spark, R.session_documents(spark, str(docs)), None, wanted)
    got = {r["session_id"]: (r["action"], r["filename"], r["reason"]) for r in rows.collect()}
    assert got == {
        "heron-1": ("created", "2026-04-06_where_do_herons_nest_heron-1.md", None),
        "heron-2": ("created", "2026-04-06_and_in_the_winter_heron-2.md", None),
        "gone": ("failed", None, "can't be read"),
    }
    listed.write_text("{}")
    with pytest.raises(Exception, match="no list of sessions"):
        R.session_catalogue(spark, str(listed)).collect()


def test_lines_and_code_are_kept(spark, folders):
    docs, notes = folders
    said = [("user", "a first line\n\nand a third one"), ("assistant", f"see\n\n{FENCE}python\n## Q9\nprint(1)\n{FENCE}\nthat is all")]
    document(docs, "otter-9", "claude", "2026-04-07T10:00:00Z", *said)
    assert run(spark, docs, notes) == {"created": 1}
    (body,) = texts(notes).values()
    assert said[0][1] in body and said[1][1] in body
    said += [("user", "more\nof it"), ("assistant", "a\nb\nc")]
    document(docs, "otter-9", "claude", "2026-04-07T10:00:00Z", *said)
    assert run(spark, docs, notes) == {"appended": 1}
    (body,) = texts(notes).values()
    assert "## Q2\nmore\nof it\n\n## A2\na\nb\nc\n\n" in body


@pytest.mark.parametrize("open_code", [FENCE + "\ncode that never ends", "## Q1 and\n## A7", FENCE + "\n## Q3\n" + FENCE + "\n" + FENCE])
def test_runs_over_open_code_repeat_nothing(spark, folders, open_code):
    docs, notes = folders
    said = [("user", "please show some code"), ("assistant", open_code), ("user", "thanks"), ("assistant", open_code)]
    document(docs, "open", "claude", "2026-04-08T10:00:00Z", *said)
    assert run(spark, docs, notes) == {"created": 1}
    before = texts(notes)
    for _ in range(2):
        assert run(spark, docs, notes) == {"unchanged": 1} and texts(notes) == before
    document(docs, "open", "claude", "2026-04-08T10:00:00Z", *said, ("user", open_code))
    assert run(spark, docs, notes) == {"appended": 1}
    assert list(texts(notes).values()) == [next(iter(before.values())) + f"## Q3\n{open_code}\n\n"]
    assert run(spark, docs, notes) == {"unchanged": 1}


def test_sessions_of_system_messages_get_names_of_their_own(spark, folders):
    docs, notes = folders
    for i in range(3):
        document(docs, f"sys/{i}".replace("/", "~~~~~~~~"), "claude", "2026-04-08T10:00:00Z", ("system", "rules"))
    document(docs, "sys~", "claude", "2026-04-08T10:00:00Z", ("system", "rules"))
    document(docs, "~sys", "claude", "2026-04-08T10:00:00Z", ("system", "rules"))
    assert run(spark, docs, notes) == {"created": 5}
    before = texts(notes)
    assert len(before) == 5 and {"2026-04-08_untitled_sys.md", "2026-04-08_untitled_sys_1.md"} <= set(before)
    assert run(spark, docs, notes) == {"unchanged": 5} and texts(notes) == before


def event(sid, role, content, **more):
    return json.dumps({"type": role, "sessionId": sid, "timestamp": "2026-03-01T00:00:00Z", "message": {"role": role, "content": content}} | more)


def test_catalogue_hooks_and_event_logs(spark, folders, tmp_path):
    """The whole catalogue but for sessions of rollout files; an unreadable document from its log; then
    one session that a hook names."""
    docs, notes = folders
    logs = tmp_path / "logs"
    logs.mkdir()
    document(docs, "crane-1", "claude", "2026-04-06T10:00:00Z", ("user", "how tall is a crane"))
    (docs / "crane-2.json").write_text("{ not JSON")
    (logs / "crane-2.jsonl").write_text("\n".join([event("crane-2", "user", "what do cranes eat"), "{bad", event("crane-2", "assistant", ["seeds"])]))
    (logs / "unlisted.jsonl").write_text(event("unlisted", "user", "who asked for this"))
    listed = [{"session_id": "crane-1", "source": "claude"}, {"session_id": "crane-2"}, {"session_id": "rolled", "source": "codex"}, {"session_id": "gone", "source": None}]
    (tmp_path / "list.txt").write_text(json.dumps({"sessions": listed}))
    now = lambda wanted=None: {r["action"]: r["sessions"] for r in sync.sync_sessions_now(spark, str(tmp_path / "list.txt"), str(docs), str(logs), str(notes), wanted, log=str(tmp_path / "log"), index=str(tmp_path / "index")).collect()}
    assert now() == {"created": 2, "failed": 1}
    assert sorted(texts(notes)) == ["2026-03-01_what_do_cranes_eat_crane-2.md", "2026-04-06_how_tall_is_a_crane_crane-1.md"]
    told = {r["session_id"]: (r["action"], r["reason"]) for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert told == {"crane-1": ("created", None), "crane-2": ("created", P.FROM_EVENT_LOG), "gone": ("failed", "can't be read")}
    assert {tuple(r) for r in R.read_index(spark, str(tmp_path / "index")).collect()} == {("crane-1", "2026-04-06_how_tall_is_a_crane_crane-1.md"), ("crane-2", "2026-03-01_what_do_cranes_eat_crane-2.md")}
    (tmp_path / "hooks").mkdir()
    (tmp_path / "hooks" / "a.json").write_text('{"session_id":"crane-1"}')
    document(docs, "crane-1", "claude", "2026-04-06T10:00:00Z", ("user", "how tall is a crane"), ("assistant", "up to two metres"))
    seen = []
    hooks = spark.readStream.schema("session_id string").json(str(tmp_path / "hooks"))
    sync.follow(hooks, lambda batch: seen.append(now(sync.hooked(batch))), str(tmp_path / "cp")).awaitTermination()
    assert seen == [{"appended": 1}]
    assert now() == {"unchanged": 2, "failed": 1}
    assert sync.hooked(spark.createDataFrame([("a",), ("",)], "session_id string")) is None


def test_bad_sessions_fail_and_the_rest_goes_on(spark, folders):
    docs, notes = folders
    document(docs, "no-stamp", "claude", "", ("user", "hello there"))
    document(docs, "bad-date", "claude", "yesterday", ("user", "hello there"))
    document(docs, "empty", "claude", "2026-02-11T10:00:00Z")
    document(docs, "system", "other", "2026-02-11T10:00:00Z", ("system", "rules"))
    document(docs, "false-source", False, "2026-02-11T10:00:00Z", ("user", "hello there"))
    document(docs, "null-stamp", "claude", None, ("user", "hello there"))
    (docs / "null.json").write_text("null")
    (docs / "broken.json").write_text("{")
    assert run(spark, docs, notes) == {"failed": 4, "skipped": 1, "created": 1}
    assert list(texts(notes)) == ["2026-02-11_untitled_system.md"]


def test_event_logs_stand_in(spark, tmp_path):
    logs = tmp_path / ".codex" / "deep"
    logs.mkdir(parents=True)
    lines = [event("s1", "user", "   "), "{bad", "", "[1]", event("s1", "user", ["q", {"type": "text", "text": "r"}], timestamp="2026-03-02T00:00:00Z"), event("s2", "assistant", "other"), event("s1", "assistant", "answer")]
    (logs / "s1.jsonl").write_bytes("\r\n".join(lines).encode() + b"\n\xff\n")
    found = R.event_log_documents(spark, str(tmp_path / ".codex"))
    docs = tmp_path / "docs"
    docs.mkdir()
    document(docs, "s0", "claude", "2026-03-01T00:00:00Z", ("user", "hello there"))
    both = R.with_fallback(R.session_documents(spark, str(docs)), found)
    assert {r["session_id"]: (r["source"], r["started_at"], r["used_fallback"]) for r in both.collect()} == {"s0": ("claude", "2026-03-01T00:00:00Z", False), "s1": ("codex", "2026-03-01T00:00:00Z", True)}
    said = R.session_messages(found).orderBy("seq").collect()
    assert [(r["role"], r["text"]) for r in said] == [("user", "q\nr"), ("assistant", "answer")]


ROLLOUT = [
    '{"type":"session_meta","timestamp":"2026-03-01T09:00:01Z","payload":{"id":"%s","cwd":"/w"}}' % UUID,
    "{bad json",
    "",
    '{"type":"event_msg","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"ignored type"}]}}',
    '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"  <environment_context>x"}]}}',
    '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"Please fix the parser"},{"type":"image"}]}}',
    '{"type":"response_item","payload":{"type":"reasoning","role":"assistant","content":[]}}',
    '{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"Done."},{"type":"output_text","text":"Bye."}]}}',
    '{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"   "}]}}',
]


def test_rollouts(spark, tmp_path):
    logs, notes = tmp_path / "in" / "2026", tmp_path / "notes"
    logs.mkdir(parents=True)
    (logs / "rollout-1.jsonl").write_text("\n".join(ROLLOUT))
    (logs / "rollout-2.jsonl").write_text('{"type":"session_meta","timestamp":"2026-02-30T09:00:01Z","payload":{"id":"%s"}}' % UUID.replace("0", "9"))
    (logs / "other.jsonl").write_text(ROLLOUT[0])
    assert {r["action"]: r["sessions"] for r in sync.sync_now(spark, str(tmp_path / "in"), str(notes)).collect()} == {"created": 1, "failed": 1}
    (name,) = texts(notes)
    assert name == "2026-03-01_Please_fix_the_parser_01234567.md"
    note = texts(notes)[name]
    assert note == f'---\ndate: 2026-03-01\ntitle: "Please fix the parser"\nsource: Codex\nsession_id: {UUID}\nmsg_count: 2\ntags:\n  - codex\n---\n\n# Please fix the parser\n\n## Q1\nPlease fix the parser\n\n## A1\nDone.\nBye.\n\n'
    more = '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"Thanks"}]}}'
    (logs / "rollout-1.jsonl").write_text("\n".join([*ROLLOUT, more]))
    assert {r["action"] for r in sync.sync_now(spark, str(tmp_path / "in"), str(notes)).collect()} == {"appended", "failed"}
    assert texts(notes)[name] == note.replace("msg_count: 2", "msg_count: 3") + "## Q2\nThanks\n\n"
    damaged = note.replace("msg_count: 2", "msg_count: x")
    (notes / name).write_text(damaged)
    assert {r["action"] for r in sync.sync_now(spark, str(tmp_path / "in"), str(notes)).collect()} == {"skipped", "failed"}
    assert texts(notes)[name] == damaged


def test_links_are_no_notes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "notes").mkdir()
    (tmp_path / "in" / "rollout-1.jsonl").write_text("\n".join(ROLLOUT))
    (tmp_path / "elsewhere.txt").write_text(f"---\nsession_id: {UUID}\nmsg_count: 9\n---\n")
    os.symlink(tmp_path / "elsewhere.txt", tmp_path / "notes" / "link.md")
    assert {r["action"] for r in sync.sync_now(spark, str(tmp_path / "in"), str(tmp_path / "notes")).collect()} == {"created"}


def test_names_with_odd_characters_are_found_again(spark, folders):
    docs, notes = folders
    document(docs, "odd+id 100%", "claude", "2026-02-10T12:00:00Z", ("user", "50% of a+b & c=d #1"), ("assistant", "yes indeed"))
    assert run(spark, docs, notes) == {"created": 1}
    assert run(spark, docs, notes) == {"unchanged": 1}


def test_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x.md"), ("b", "y.md")], "session_id string, filename string")
    R.append_index(rows, str(tmp_path / "index"))
    R.append_index(rows.where("session_id = 'a'").withColumn("filename", F.lit("z.md")), str(tmp_path / "index"))
    assert {tuple(r) for r in R.read_index(spark, str(tmp_path / "index")).collect()} == {("a", "x.md"), ("b", "y.md")}


def test_stream_of_hooks_drives_the_sync(spark, tmp_path):
    for n in ("in", "hooks"):
        (tmp_path / n).mkdir()
    (tmp_path / "in" / "rollout-1.jsonl").write_text("\n".join(ROLLOUT))
    (tmp_path / "hooks" / "a.json").write_text('{"session_id":"s"}')
    hooks = spark.readStream.schema("session_id string").json(str(tmp_path / "hooks"))
    sync.follow(hooks, lambda batch: sync.sync_now(spark, str(tmp_path / "in"), str(tmp_path / "notes")), str(tmp_path / "cp")).awaitTermination()
    assert len(texts(tmp_path / "notes")) == 1


def test_export(spark, tmp_path):
    node = lambda role, parts, at: {"message": {"author": {"role": role}, "content": {"parts": parts}, "create_time": at}}
    mapping = {
        "n1": {"message": None}, "n2": node("user", ["hello there", {"image": 1}], 20), "n3": node("assistant", ["hi"], 10), "n4": node("system", ["x"], 1),
        "n5": node("user", [""], None), "n6": node("assistant", [{"image": 1}], 30), "n7": node("user", ["tie"], 20),
    }
    whole = [{"title": 'Say "hi"\nnow', "create_time": 1700000000.5, "mapping": mapping}, {"title": "none", "create_time": None, "mapping": {}}, {"title": 'Say "hi"\nnow', "create_time": 1700000000.5, "mapping": mapping}]
    path = tmp_path / "conversations.json"
    path.write_text(json.dumps(whole))
    got = P.export_notes(spark, str(path)).orderBy("session_id").collect()
    assert [(r["action"], r["filename"]) for r in got] == [("created", "2023-11-14_Say_hinow.md"), ("skipped", None), ("created", "2023-11-14_Say_hinow_1.md")]
    assert got[0]["markdown"] == '---\ndate: 2023-11-14\ntitle: "Say \\"hi\\"\\nnow"\nsource: ChatGPT\ntags: [chatgpt]\n---\n\n# Say "hi" now\n\n## Q1\n\n\n## A1\nhi\n\n## Q2\nhello there\n\n## Q3\ntie\n'


def test_guards(tmp_path):
    (tmp_path / "real").mkdir()
    os.symlink(tmp_path / "real", tmp_path / "link")
    with pytest.raises(ValueError):
        note_files.guard(str(tmp_path / "link"))
    with pytest.raises(ValueError):
        note_files.guard("")
    for name in ("../x.md", "", "..", ".hidden.md", "a\0b"):
        with pytest.raises(ValueError):
            note_files.plain_name(name)
    with note_files.lock(str(tmp_path)) as mine, note_files.lock(str(tmp_path)) as other:
        assert mine and not other


def test_reminders(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    rows = ["s1"] * 45 + ["s2"] * 19 + ["", "//"]
    (events / "a.json").write_text("\n".join(json.dumps({"session_id": s}) for s in rows))
    stream = lambda: spark.readStream.schema("session_id string").json(str(events))
    got = reminder.run_available(spark, stream(), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted((r["session_id"], r["turn"]) for r in got.collect()) == [("s1", 20), ("s1", 40)]
    (events / "b.json").write_text("\n".join(json.dumps({"session_id": s}) for s in ["s1"] * 15 + ["s2"]))
    got = reminder.run_available(spark, stream(), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted((r["session_id"], r["turn"]) for r in got.collect()) == [("s1", 20), ("s1", 40), ("s1", 60), ("s2", 20)]


def test_counters_are_taken_over_once(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    (events / "a.json").write_text("\n".join(json.dumps({"session_id": s}) for s in ["s1", "s2", "s2", "s3"]))
    counters = spark.createDataFrame([("s1", "19"), ("s1", "7"), ("/s2/", "18"), ("s3", "x19"), ("s4", "99"), ("", "5"), (None, "5"), ("s5", None)], "session_id string, value string")
    stream = lambda: spark.readStream.schema("session_id string").json(str(events))
    now = lambda: sorted((r["session_id"], r["turn"]) for r in reminder.run_available(spark, stream(), str(tmp_path / "cp"), str(tmp_path / "out"), counters).collect())
    assert now() == [("s1", 20), ("s2", 20)]
    (events / "b.json").write_text("\n".join(json.dumps({"session_id": s}) for s in ["s1"] * 20 + ["s3"] * 19 + ["s4"]))
    assert now() == [("s1", 20), ("s1", 40), ("s2", 20), ("s3", 20), ("s4", 100)]


def test_documents_are_read_and_parsed_once_and_not_shuffled(spark, folders, monkeypatch):
    documents, _ = folders
    (documents / "a.json").write_text(json.dumps({"source": "claude", "timestamp": "2026-02-10T12:00:00Z", "messages": [{"role": "user", "content": "one and two"}, {"role": "assistant", "content": ["x", {"type": "text", "text": "y"}]}]}))
    (documents / "b.json").write_text(json.dumps({"source": "claude", "timestamp": "10 Feb", "messages": [{"role": "user", "content": "z"}]}))
    (documents / "c.json").write_text("false")
    monkeypatch.setattr(P, "stage", lambda df, label: df)
    read = P._read(R.session_documents(spark, str(documents)), False)
    rows = {r.session_id: r for r in read.collect()}
    assert sorted(rows) == ["a", "b"] and rows["b"].reason == "bad date" and rows["b"].said is None
    assert [tuple(m) for m in rows["a"].said] == [(0, "user", "one and two", "one and two"), (1, "assistant", "x\ny", None)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan binaryFile") == 1 and plan.count("parseJson") == 1
