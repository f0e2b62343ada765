"""The folder of notes: lock, commit and recovery, links, and what is read of notes."""

import json
import os
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from spindle.operators import notes as N
from spindle.operators import sync as S
from spindle.plans import pipelines as P
from spindle.sources import note_files as W
from spindle.sources import transcripts as R
from spindle.streaming import sync

from .test_pipelines import ROLLOUT, UUID, texts


def left(folder):
    """What a run has left besides notes."""
    return sorted(p.name for p in folder.iterdir() if p.name.startswith(".") and p.name != W.MUTEX)


def age(folder, seconds):
    then = time.time() - seconds
    os.utime(folder / W.LOCK, (then, then))


def writer(folder, run="r", **options):
    return W._Writer({"path": str(folder), "run": run, **options})


def note(name, text, expects=None, keep_from=None):
    return {"filename": name, "markdown": text, "expects": expects, "keep_from": keep_from}


# -- the lock --------------------------------------------------------------------------------------


def test_a_run_that_was_taken_over_neither_writes_nor_frees_the_lock(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "_live", lambda *_: None)  # the first run gives no signs of life
    with W.lock(str(tmp_path)) as first:
        age(tmp_path, 299)
        with W.lock(str(tmp_path)) as early:
            assert early is None
        age(tmp_path, 301)
        second = W.lock(str(tmp_path))
        token = second.__enter__()
        assert token and token != first and W.holder(str(tmp_path)) == token
        late = writer(tmp_path, token=first)
        with pytest.raises(W.Conflict, match="taken over"):
            late.commit([late.write([note("a.md", "late")])])
        late.abort([])
        assert texts(tmp_path) == {} and left(tmp_path) == [W.LOCK]
    assert W.holder(str(tmp_path)) == token  # the end of the first run leaves the second's lock
    with W.lock(str(tmp_path)) as third:
        assert third is None
    own = writer(tmp_path, token=token)
    own.commit([own.write([note("a.md", "own")])])
    second.__exit__(None, None, None)
    assert texts(tmp_path) == {"a.md": "own"} and left(tmp_path) == []


def test_a_run_that_lives_never_loses_the_lock(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "LOCK_STALE_S", 0.4)
    with W.lock(str(tmp_path)) as mine:
        until = time.time() + 1.5
        while time.time() < until:
            with W.lock(str(tmp_path)) as other:
                assert other is None
            time.sleep(0.05)
        assert W.holder(str(tmp_path)) == mine
    assert W.holder(str(tmp_path)) is None


def test_locks_of_other_kinds_are_left_alone(tmp_path):
    os.mkdir(tmp_path / W.LOCK)
    os.utime(tmp_path / W.LOCK, (0, 0))
    with W.lock(str(tmp_path)) as mine:
        assert mine is None
    assert (tmp_path / W.LOCK).is_dir()


# -- commit and recovery ---------------------------------------------------------------------------


def test_a_run_that_fails_leaves_the_folder_as_it_was(spark, tmp_path):
    (tmp_path / "n0.md").write_text("before")
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md")).alias("filename"), F.when(F.col("id") == 13, F.raise_error(F.lit("a task dies")).cast("string")).otherwise("new").alias("markdown"))
    with pytest.raises(Exception, match="a task dies"):
        W.write_notes(rows, str(tmp_path))
    assert texts(tmp_path) == {"n0.md": "before"} and left(tmp_path) == []
    W.write_notes(rows.where("filename <> 'n13.md'"), str(tmp_path))
    assert texts(tmp_path) == {f"n{i}.md": "new" for i in range(20) if i != 13} and left(tmp_path) == []
    with pytest.raises(Exception, match="no file name"):
        W.write_notes(rows.limit(1).withColumn("filename", F.lit("../out.md")), str(tmp_path))
    W.write_notes(rows.limit(0), str(tmp_path))
    assert left(tmp_path) == []


@pytest.mark.parametrize("moved", [0, 1, 2, 3])
def test_a_run_that_ends_after_its_journal_is_finished_by_the_next(tmp_path, monkeypatch, moved):
    (tmp_path / "b.md").write_text("before")
    run, real = writer(tmp_path), os.rename
    done = [run.write([note("a.md", "A"), note("b.md", "B")]), None, run.write([note("c.md", "C")])]

    def dying(*args, **how):
        nonlocal moved
        if not moved:
            raise KeyboardInterrupt
        moved -= 1
        real(*args, **how)

    with monkeypatch.context() as m:
        m.setattr(os, "rename", dying)
        if moved == 3:
            m.setattr(W.shutil, "rmtree", lambda *_, **__: None)
            run.commit(done)
        else:
            with pytest.raises(KeyboardInterrupt):
                run.commit(done)
    run.abort(done)  # after the journal nothing is taken back
    assert left(tmp_path) == [".run-r"]
    with W.lock(str(tmp_path)) as mine:
        assert mine and texts(tmp_path) == {"a.md": "A", "b.md": "B", "c.md": "C"}
        W.recover(str(tmp_path))
    assert texts(tmp_path) == {"a.md": "A", "b.md": "B", "c.md": "C"} and left(tmp_path) == []


def test_a_run_that_ends_before_its_journal_is_removed(tmp_path):
    run = writer(tmp_path)
    run.write([note("a.md", "A")])
    assert left(tmp_path) == [".run-r"]
    with W.lock(str(tmp_path)):
        pass
    assert texts(tmp_path) == {} and left(tmp_path) == []


def test_notes_that_changed_meanwhile_are_not_overwritten(tmp_path):
    path, outside = tmp_path / "a.md", tmp_path / "outside.txt"
    path.write_text("read")
    outside.write_text("secret")
    read = os.stat(path).st_mtime_ns // 1_000_000
    for change, expects in (
        (lambda: (path.write_text("edited by hand"), os.utime(path, (1, 1))), read),
        (lambda: (os.remove(path), os.symlink(outside, path)), read),
        (lambda: (os.remove(path), os.symlink(outside, path)), None),
        (lambda: (os.remove(path), os.mkdir(path)), None),
        (lambda: os.remove(path), read),
        (lambda: None, W.FREE),
    ):
        run = writer(tmp_path)
        done = [run.write([note("new.md", "N"), note("a.md", "A", expects)])]
        change()
        with pytest.raises(W.Conflict):
            run.commit(done)
        run.abort(done)
        assert not (tmp_path / "new.md").exists() and outside.read_text() == "secret" and left(tmp_path) == []
        os.rmdir(path) if path.is_dir() and not path.is_symlink() else path.unlink(missing_ok=True)
        path.write_text("read")
        os.utime(path, ns=(read * 1_000_000,) * 2)
    run = writer(tmp_path)
    run.commit([run.write([note("a.md", "A", read), note("new.md", "N", W.FREE)])])
    assert path.read_text() == "A" and (tmp_path / "new.md").read_text() == "N"


# -- notes in pieces -------------------------------------------------------------------------------


def test_a_note_of_many_pieces_takes_a_bounded_memory(tmp_path):
    def pieces():
        yield note("a.md", "---\nmsg_count: 9\n---\n", None, 5)
        for i in range(60_000):
            yield note(None, f"{i:04096d}")
        yield note("b.md", "B")
        yield note(None, "")
        yield note(None, "é\r\n")

    old = b"old\n\xff" + b"kept\n" * 3_000_000 + b"\n" * 50_000
    (tmp_path / "a.md").write_bytes(old)
    run = writer(tmp_path, sync="false")
    tracemalloc.start()
    run.commit([run.write(pieces())])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 2 << 20
    data = (tmp_path / "a.md").read_bytes()
    front = b"---\nmsg_count: 9\n---\n" + old[5:].rstrip(b"\n") + b"\n\n"
    assert len(data) == len(front) + 60_000 * 4096 and data.startswith(front) and data.endswith(b"%04096d" % 59_999)
    assert (tmp_path / "b.md").read_bytes() == "Bé\r\n".encode() and left(tmp_path) == []


@pytest.mark.parametrize("old", ["", "\n", "\n\n\n", "x", "x\n", "x\n\n", "x\n\n\n\n", "x\n" * 9000 + "\n" * 20_000, "x" * W.BLOCK, "x" * (W.BLOCK - 1) + "\n", "\n" * W.BLOCK * 2])
def test_a_note_held_ends_with_one_empty_line(tmp_path, old):
    (tmp_path / "a.md").write_text(old)
    run = writer(tmp_path)
    run.commit([run.write([note("a.md", "", None, 0), note(None, "new")])])
    assert texts(tmp_path) == {"a.md": old.rstrip("\n") + "\n\nnew"}


def test_pieces_need_a_note_and_the_note_that_was_read(tmp_path):
    with pytest.raises(ValueError, match="without a note"):
        writer(tmp_path, "r1").write([note(None, "x")])
    (tmp_path / "a.md").write_text("a")
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    (tmp_path / "dir.md").mkdir()
    read = os.stat(tmp_path / "a.md").st_mtime_ns // 1_000_000
    for i, (name, expects) in enumerate([("a.md", read + 1), ("link.md", None), ("dir.md", None), ("gone.md", None)]):
        run = writer(tmp_path, f"x{i}")
        with pytest.raises(W.Conflict):
            run.write([note(name, "", expects, 0)])
        run.abort([])
    assert (tmp_path / "a.md").read_text() == "a"


def test_notes_in_pieces_are_those_that_are_whole(spark, tmp_path):
    """Created and appended notes of rollouts, one of them with nearly all messages, of held notes edited by hand."""
    ids = [UUID[:-1] + c for c in "abcdef"]
    held = {
        "a": "---\nsession_id: {}\nmsg_count: 3\n---\n## Q1\n```\n## Q2\n## A1\n", "b": "---\nmsg_count: 1\nsession_id: {}\nmsg_count: 2\n---\n\n\n## A1\n\n\n",
        "c": "---\nsession_id: {}\nmsg_count: 1\n---", "d": "---\nsession_id: {}\nmsg_count: 5000\n---\nx",
    }
    logs = tmp_path / "in"
    logs.mkdir()
    for i, sid in enumerate(ids):
        lines = [ROLLOUT[0].replace(UUID, sid)]
        for n in range(4000 if i == 0 else 5):
            lines.append(json.dumps({"type": "response_item", "payload": {"type": "message", "role": ("user", "assistant")[n % 3 == 1], "content": [{"type": "input_text", "text": f"{n} tell me ü\n\n## Q7\r\n"}]}}))
        (logs / f"rollout-{i}.jsonl").write_text("\n".join(lines))
    folders = [tmp_path / "pieces", tmp_path / "whole"]
    for folder in folders:
        folder.mkdir()
        for c, text in held.items():
            (folder / f"{c}.md").write_text(text.format(UUID[:-1] + c))
    for _ in range(2):
        P.write(P.plan_rollouts(spark, str(logs), R.held_notes(spark, str(folders[0]))), str(folders[0]))
        P.write(P.sync_rollouts(spark, str(logs), R.notes_snapshot(spark, str(folders[1]))), str(folders[1]))
        pieces, whole = ({p.name: p.read_bytes() for p in f.glob("*.md")} for f in folders)
        assert pieces == whole and len(pieces) == 6
    assert pieces["a.md"].startswith(f"---\nsession_id: {ids[0]}\nmsg_count: 4000\n---\n## Q1\n```\n## Q2\n## A1\n\n## Q2\n3 tell".encode())
    assert pieces["a.md"].count(b"tell me") == 3997 and pieces["d.md"].endswith(b"---\nx")


# -- what is read of notes -------------------------------------------------------------------------


def test_heads_say_what_whole_notes_say(spark, tmp_path):
    bodies = ["", "---", "---\n", "---\n---\n", "---\n---", "---\nsession_id: x\n---", "---\nsession_id: y\nmsg_count: 3\n---\n\n## Q1\n## A7\r## Q8 ## A9\n ## Q1\n## Q\n",
              "---\nno end\n", "text\n---\nsession_id: z\n---\n", "---\n" + "a: b\n" * 9000 + 'session_id: "far"\nmsg_count: 5\n---\n## Q1', "---\nx\n----\nsession_id: w\n---more\n---\n", "----\nsession_id: v\n---\n"]
    for i, body in enumerate(bodies):
        (tmp_path / f"n{i} é+%.md").write_bytes(body.encode())
    (tmp_path / "dir.md").mkdir()
    os.symlink(tmp_path / "n5 é+%.md", tmp_path / "link.md")
    snapshot = {r["filename"]: (r["session_id"], r["msg_count"], r["headings"]) for r in R.notes_snapshot(spark, str(tmp_path)).collect() if r["filename"] != "link.md"}
    snapshot["n0 é+%.md"] = (None, None, 0)  # of an empty file the text reader has no row
    assert len(snapshot) == len(bodies)
    for whole in (True, False):
        got = {r["filename"]: (r["session_id"], r["msg_count"], r["headings"]) for r in R.held_notes(spark, str(tmp_path), whole=whole).heads.collect()}
        assert got == {f: (s, n, h if whole else None) for f, (s, n, h) in snapshot.items()}


def test_marks_in_place_are_those_of_whole_notes(spark, tmp_path):
    bodies = ["", "---\n---", "---\nsession_id: y\n---\n## Q1\n## A12\n## Q٣\n## Q1 \n## Q\n ## Q4\n## A1\r\n## Q5", "```\n## Q1\n```js\n## Q2\n\n```\n## A1\n",
              "---\né: ü\n---\n" + "x" * (W.BLOCK - 2) + "## Q1\n" + "y" * (W.BLOCK - 18) + "\n```" + "z" * W.BLOCK + "```\n## A3\n```\n## A4\n"]
    for i, body in enumerate(bodies):
        (tmp_path / f"n{i}.md").write_bytes(body.encode())
    (tmp_path / "dir.md").mkdir()
    os.symlink(tmp_path / "n2.md", tmp_path / "link.md")
    rows = spark.createDataFrame([(f"n{i}.md", b) for i, b in enumerate(bodies)], "filename string, markdown string")
    names = rows.select("filename").union(spark.createDataFrame([("dir.md",), ("link.md",), ("gone.md",)], "filename string"))
    assert {tuple(r) for r in W.marks(names, str(tmp_path)).collect()} == {tuple(r) for r in N.marks(rows).collect()}
    assert {(r["q"], r["a"]) for r in N.marks(rows).collect()} == {(0, 0), (3, 1), (1, 0), (0, 1)}


def test_indexed_notes_are_not_opened_until_they_change(spark, tmp_path, monkeypatch):
    notes, index = tmp_path / "notes", str(tmp_path / "index")
    notes.mkdir()
    body = lambda i, n: f"---\nsession_id: s{i}\nmsg_count: {n}\n---\n## Q1\n"
    for i in range(30):
        (notes / f"n{i}.md").write_text(body(i, 1))
    (notes / "by hand.md").write_text("no session")
    opened, real = [], R.stage
    monkeypatch.setattr(R, "stage", lambda df, label: (opened.append((label, out := real(df, label))), out)[1])

    def held(**how):
        opened.clear()
        found = R.held_notes(spark, str(notes), index, **how)
        (read,) = (t for label, t in opened if label == "note-heads")
        return {r["filename"]: (r["session_id"], r["msg_count"]) for r in found.heads.collect()}, read.count(), found

    first, n, _ = held()
    assert n == 31 and len(first) == 31 and first["by hand.md"] == (None, None)
    assert held()[:2] == (first, 0)
    assert held(whole=True)[:2] == (first, 31) and held(whole=True)[:2] == (first, 0)  # the headings were missing
    status = os.stat(notes / "n3.md")
    (notes / "n3.md").write_text(body(3, 7))
    os.utime(notes / "n3.md", ns=(status.st_atime_ns, status.st_mtime_ns))
    assert held()[:2] == (first, 0)  # same length and time: it is not opened
    os.utime(notes / "n3.md", (5, 5))
    os.remove(notes / "n4.md")
    os.rename(notes / "n5.md", notes / "renamed.md")
    now, n, found = held()
    assert n == 2 and now["n3.md"] == ("s3", 7) and now["renamed.md"] == ("s5", 1) and "n4.md" not in now and "n5.md" not in now
    os.symlink(notes / "n3.md", notes / "link.md")
    text = found.texts(spark.createDataFrame([("n3.md",), ("gone.md",), ("link.md",)], "filename string"))
    assert [tuple(r) for r in text.collect()] == [("n3.md", body(3, 7))]
    (notes / "empty.md").touch()
    taken = {r[0] for r in R.held_notes(spark, str(notes), index).names.collect()}
    assert {"link.md", "empty.md", "n3.md"} <= taken and "n4.md" not in taken


def test_a_run_without_news_moves_no_text(spark, tmp_path, monkeypatch):
    logs, notes = tmp_path / "in", tmp_path / "notes"
    logs.mkdir()
    (logs / "rollout-1.jsonl").write_text("\n".join(ROLLOUT))
    index = str(tmp_path / "index")
    run = lambda: {r["action"]: r["sessions"] for r in sync.sync_now(spark, str(logs), str(notes), index=index).collect()}
    assert run() == {"created": 1}
    asked, real = [], W.marks
    monkeypatch.setattr(W, "marks", lambda names, folder: (asked.append(names), real(names, folder))[1])
    monkeypatch.setattr(W, "note_texts", lambda names, folder: pytest.fail("a note's text is moved"))
    assert run() == {"unchanged": 1}
    assert [x.count() for x in asked] == [0]
    (name,) = texts(notes)
    assert {tuple(r) for r in R.read_index(spark, index).collect()} == {(UUID, name)}
    with (logs / "rollout-1.jsonl").open("a") as f:
        f.write("\n" + ROLLOUT[5].replace("Please fix the parser", "And the printer"))
    asked.clear()
    assert run() == {"appended": 1} and [x.count() for x in asked] == [1]
    assert texts(notes)[name].endswith("## Q2\nAnd the printer\n\n") and left(notes) == []
    assert N.ROLLOUT.has_msg_count and "msg_count: 3" in texts(notes)[name]


def test_a_snapshot_of_notes_is_read_once_for_what_they_say(spark, tmp_path):
    """Its names and beginnings come from a written table, so notes that are gone by then are known all the same."""
    (tmp_path / "n.md").write_text("---\nsession_id: s1\nmsg_count: 2\n---\n\n## Q1\na\n\n## A1\nb\n")
    notes = S.of_snapshot(R.notes_snapshot(spark, str(tmp_path)))
    os.unlink(tmp_path / "n.md")
    assert [tuple(r) for r in notes.heads.collect()] == [("s1", "n.md", 2, 2, None)] and [r["filename"] for r in notes.names.collect()] == ["n.md"]


def test_files_that_no_one_reads_yet_are_put_by_their_tasks(spark, tmp_path):
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".json")).alias("filename"), F.lit("\u00e9\n").alias("text"))
    for _ in range(2):  # a second time changes nothing
        W.put_files(rows, str(tmp_path))
        assert texts(tmp_path) == {f"n{i}.json": "\u00e9\n" for i in range(20)} and left(tmp_path) == []
    with pytest.raises(Exception, match="no file name"):
        W.put_files(rows.limit(1).withColumn("filename", F.lit("../out")), str(tmp_path))
