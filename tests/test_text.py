import os
import re

import pytest
from pyspark.sql import functions as F

from spindle.functions import content as C
from spindle.functions import text as T


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


TITLES = [
    ("Fix the login bug\nmore", "Fix the login bug"),
    ('<ctx a="1">secret\nstuff</ctx>\n## Plan the trip', "Plan the trip"),
    ("# AGENTS.md instructions", None),
    ("---\ntitle: x\nhello world", None),
    ("---\nhello world", "hello world"),
    ("Implement the following plan:\nBuild the parser", "Build the parser"),
    ("hi\nok\nthis one is long enough", "this one is long enough"),
    ("<b>bold</b> title", "title"),
    ("<instructions only", None),
    ("####", None),
    ("a" * 60, "a" * 50),
    ("", None),
    (None, None),
]


def test_titles(spark):
    assert apply(spark, T.title_of, [t for t, _ in TITLES]) == [x for _, x in TITLES]


NAMES = [
    ('a/b: "c" d　e..f.', "ab_c_d_e..f", "ab_c_d_e..f", "ab_c_d　e..f"),
    ("a  b__c", "a_b__c", "a_b_c", "a_b_c"),
    ("x\ty", "xy", "xy", "xy"),
    ("a" * 49 + ".b", "a" * 49, "a" * 49 + ".", "a" * 49 + "."),
    ("...", "untitled", "untitled", "untitled"),
    ("", "untitled", "untitled", "untitled"),
]


@pytest.mark.parametrize("at,function", [(1, T.sanitize_export), (2, T.sanitize_session), (3, T.sanitize_rollout)])
def test_names(spark, at, function):
    assert apply(spark, function, [n[0] for n in NAMES]) == [n[at] for n in NAMES]


def test_yaml_escape_is_the_json_escape(spark):
    import json

    values = ['あ"b\\', "😀", "tab\tline\nend\r\b\f", "\x01\x7f é  plain ~", ""]
    assert apply(spark, T.yaml_escape, values) == [json.dumps(v)[1:-1] for v in values]


def test_ids_and_dates(spark):
    assert apply(spark, T.short_id, ["walnut-harvest-77", "a/b/c", "日本"]) == ["walnut-h", "abc", "cf2abf0c"]
    assert apply(spark, T.date_from_epoch, [1700000000.5, 0.0, None], "double") == ["2023-11-14", "unknown", "unknown"]
    days = ["2026-02-30", "2026-2-3", "2026-02-03", None, "2026-02-03\n"]
    assert apply(spark, T.has_date_shape, days) == [True, False, True, False, False]
    assert apply(spark, T.is_date, days) == [False, False, True, False, False]
    assert apply(spark, T.date_prefix, ["2026-02-10T23:59:59+09:00", "x"]) == ["2026-02-10", "x"]
    assert apply(spark, T.is_uuid, ["01234567-89ab-cdef-0123-456789ABCDEF", "01234567-89ab-cdef-0123-456789abcdef\n", ""]) == [True, False, False]
    assert apply(spark, T.counter_value, ["12", "x", "-1", ""]) == [12, 0, 0, 0]
    assert apply(spark, T.state_key, ["a/b c_1-" + "z" * 80]) == ["abc_1-" + "z" * 58]


def test_tags_go_as_with_two_plain_patterns(spark):
    """Also on whole pages; the first pattern needs a back reference."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] if os.path.isdir("/root/testdata/sf0.001") else []
    values = ["<a>x</a>y", "<a><a>x</a>y</a>z", "<b\nclass='1'>t\nu</b> v", "1 < 2 > 0", "<x-y>in</x-y><br/>out", "<>", "<a>no end", "</a>b<a", *pages]

    def plain(text):
        once = re.sub(r"<([a-zA-Z][\w-]*)(?:\s[^>]*)?>.*?</\1>", "", text, flags=re.DOTALL)
        return re.sub(r"<[^>]+?>", "", once).strip()

    assert apply(spark, T.strip_tags, values) == [plain(v) for v in values]


def test_strip_knows_unicode_space(spark):
    values = ["　 a b \x1c\x85", "\u2028x", "none"]
    assert apply(spark, T.strip, values) == [v.strip() for v in values]
    assert apply(spark, T.is_blank, ["　\n", "", "x"]) == [True, True, False]


MIXED = '["a",{"type":"text","text":"b"},{"type":"tool_use"},{"type":"x","text":"c"},5]'


@pytest.mark.parametrize(
    "function,expected",
    [
        (C.flatten_event, ["plain", "a\nb", "", ""]),
        (C.flatten_body, ["plain", "a\nb\n\n\n", "None", ""]),
        (C.flatten_title, ["plain", "a\nb\nc", None, None]),
    ],
)
def test_flatten(spark, function, expected):
    rows = spark.createDataFrame([(0, '"plain"'), (1, MIXED), (2, "null"), (3, None)], "i int, j string")
    got = rows.orderBy("i").select(function(F.try_parse_json("j"))).collect()
    assert [r[0] for r in got] == expected


def test_flatten_rollout(spark):
    rows = spark.createDataFrame([('[{"type":"input_text","text":"x"},{"type":"image"},{"type":"output_text"}]',)], "j string")
    assert rows.select(C.flatten_rollout(F.parse_json("j"))).first()[0] == "x\n"
