import json

import pytest
from pyspark.sql import functions as F

from footfall.functions.metadata import canonical, contains, text_at
from footfall.functions.text import blank, blank_to_null, utf16_length


def matches(spark, document, wanted):
    rows = spark.createDataFrame([(document,)], "metadata string")
    return rows.select(contains(F.col("metadata"), wanted)).first()[0]


@pytest.mark.parametrize("document, wanted, expected", [
    ('{"plan":"pro"}', {"plan": "pro"}, True),
    ('{"plan": "pro", "x": 1}', {"plan": "pro"}, True),
    ('{"plan":"pro","country":"SE"}', {"plan": "pro", "country": "SE"}, True),
    ('{"plan":"pro","country":"NO"}', {"plan": "pro", "country": "SE"}, False),
    ('{"plan":"PRO"}', {"plan": "pro"}, False),
    ('{"Plan":"pro"}', {"plan": "pro"}, False),
    ('{"plan":1}', {"plan": "1"}, False),
    ('{"plan":"1"}', {"plan": "1"}, True),
    ('{"plan":1.5}', {"plan": "1.5"}, False),
    ('{"plan":true}', {"plan": "true"}, False),
    ('{"plan":"true"}', {"plan": "true"}, True),
    ('{"plan":null}', {"plan": "null"}, False),
    ('{"plan":"null"}', {"plan": "null"}, True),
    ('{"plan":["pro"]}', {"plan": "pro"}, False),
    ('{"plan":["pro"]}', {"plan": '["pro"]'}, False),
    ('{"plan":"[\\"pro\\"]"}', {"plan": '["pro"]'}, True),
    ('{"plan":{"a":"pro"}}', {"plan": "pro"}, False),
    ('{"a":{"plan":"pro"}}', {"plan": "pro"}, False),
    ('{"b":"pro"}', {"plan": "pro"}, False),
    ('{"app.version":"2.1"}', {"app.version": "2.1"}, True),
    ('{"app":{"version":"2.1"}}', {"app.version": "2.1"}, False),
    ('{"plan":"x","plan":"pro"}', {"plan": "pro"}, True),
    ('{"plan":"pro","plan":"x"}', {"plan": "pro"}, False),
    ('{"plan":"2","plan":2}', {"plan": "2"}, False),
    ('{"plan":"pr\\u006f"}', {"plan": "pro"}, True),
    ('{"pl\\u0061n":"pro"}', {"plan": "pro"}, True),
    ('{"a":{"plan":"pro"},"plan":"pro"}', {"plan": "pro"}, True),
    ('{"a":{"plan":"pro"},"plan":"free"}', {"plan": "pro"}, False),
    ('{"a":[{"plan":"pro"}]}', {"plan": "pro"}, False),
    ('{"x":"plan","y":"pro"}', {"plan": "pro"}, False),
    ('{"xplan":"pro"}', {"plan": "pro"}, False),
    ('{"plan":"pro plus"}', {"plan": "pro"}, False),
    ('{"plan":"{pro"}', {"plan": "{pro"}, True),
    ('{"plan":"x:\\"plan\\":\\"pro\\""}', {"plan": "pro"}, False),
    (' {"plan" : "pro"} ', {"plan": "pro"}, True),
    ("{}", {"plan": "pro"}, False),
])
def test_containment_is_type_strict(spark, document, wanted, expected):
    assert matches(spark, document, wanted) is expected


@pytest.mark.parametrize("value", [
    'say "hi"', "back\\slash", "line\nbreak", "tab\t", "\x01", "größe", "日本", "😀", "a:b", "/x?y=1&z", "%_", "NaN", "Infinity", "-", "+1",
])
def test_containment_of_awkward_texts(spark, value):
    for ascii_only in (True, False):
        assert matches(spark, json.dumps({"k": value}, ensure_ascii=ascii_only), {"k": value}) is True
    assert matches(spark, json.dumps({"k": value + "x"}), {"k": value}) is False


def test_text_at(spark):
    rows = spark.createDataFrame(
        [('{"a":"x"}',), ('{"a":1}',), ('{"a":true}',), ('{"a":null}',), ("{}",), ('{"a":{"b":1}}',), ('{"a":[1,2]}',), ('{"b.c":"y"}',)],
        "m string",
    )
    assert [r[0] for r in rows.select(text_at(F.col("m"), "a")).collect()] == [
        "x", "1", "true", None, None, '{"b":1}', "[1,2]", None]
    assert rows.select(text_at(F.col("m"), "b.c").alias("t")).where("t is not null").first()[0] == "y"


def test_canonical(spark):
    rows = spark.createDataFrame(
        [('{"b": 1, "a":"x","b":2}',), ("[1]",), ('"{}"',), ("null",), ("7",), ("{}",), ('{"a":"\\n{"}',)], "m string"
    )
    assert [r[0] for r in rows.select(canonical(F.try_parse_json("m"))).collect()] == [
        '{"a":"x","b":2}', None, None, None, None, "{}", '{"a":"\\n{"}']


def test_blank_and_length(spark):
    texts = [None, "", " ", "\t\n", "\u2003", "\u3000\x1c", "\u00a0", "a", " a "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(blank(F.col("t"))).collect()] == [True] * 6 + [False] * 3
    assert [r[0] for r in rows.select(blank_to_null(F.col("t"))).collect()] == [None] * 6 + ["\u00a0", "a", " a "]
    wide = spark.createDataFrame([("a😀",)], "t string")
    assert wide.select(utf16_length(F.col("t"))).first()[0] == 3
