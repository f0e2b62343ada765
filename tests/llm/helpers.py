"""Small tables with every awkward case, and plain-Python versions of the operators' rules."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, node int, row string, digest string, n string, component int, _spans int, _n_lines int, label string, seq int, task int"
EXTRA = ("en", "src0", 7, "m", 1, "r", "d", "n", 3, 4, 5, "l", 6, 8)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def messy_rows():
    long = words(1, 30_000, 9_000)
    near = list(long)
    for i in range(0, len(near), 400):
        near[i] = "changed"
    base = words(2, 60)
    rows = [(1, "Hello World"), (2, "hello world"), (None, None), (None, ""), (None, "null id"), (3, None), (4, ""), (4, ""), (5, "x"), (5, "x"), (5, "y z"), (6, " ".join(long)), (7, " ".join(near)), (8, "É É"), (9, "é é"), (10, "a\nb\nc\nd"), (11, "z\na\nb\nc\nd\ne"), (12, "\n\n\n\n"), (13, "\n\n\n\n"), (14, "one\ntwo"), (15, "one\ntwo")]
    rows += [(20 + i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(12)]
    return rows


def messy(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in messy_rows()], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(sets, threshold=80):
    """Index of the first member of each set's component; empty sets are alone."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= threshold * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def deduplicated_lines(rows, size=3):
    """[(id, text)] -> the texts without later windows; rows that repeat are one place."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, gone = {}, {}
    for has, doc, text in order:
        lines = text.split("\n")
        for i in range(max(1, len(lines) - size + 1)):
            window = tuple(lines[i : i + size])
            if not re.search(r"\S", "\n".join(window)):
                continue
            if window in seen:
                gone.setdefault((has, doc, text), set()).update(range(i, min(i + size, len(lines))))
            seen.setdefault(window, 1)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        cut = gone.get((doc is not None, doc or 0, text or ""), set())
        out.append((doc, len(lines), len(cut), "\n".join(x for i, x in enumerate(lines) if i not in cut)))
    return out
