"""Literal rendering fixtures."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartable.functions.render import render_text, split_separated

MATRIX = T.ArrayType(T.ArrayType(T.StringType()))


def render(spark, table, **kw):
    df = spark.createDataFrame([(table,)], T.StructType([T.StructField("t", MATRIX)]))
    return df.select(render_text("t", **kw).alias("x")).first()["x"]


@pytest.mark.parametrize("table,kw,expected", [
    ([["A", "B"], ["x", "y"]], {}, "A | B A | B A | B x | y"),
    ([["A", "B"], ["x", "y"]], {"layout": "entetes_seuls"}, "A | B"),
    ([["A", "B"], ["x", "y"]], {"layout": "separe"}, "A | B __CONTENU__ x | y"),
    ([], {}, ""),
    ([], {"layout": "separe"}, ""),
    (None, {}, ""),
    ([["A"]], {}, "A A A"),
    ([["A"]], {"layout": "separe"}, "A __CONTENU__ "),
    ([[""], ["x"]], {}, "x"),
    ([["  a\t b "], [None, "", "y"]], {"header_weight": 1}, "a b y"),
    ([["A"], ["1", ""], ["2", "3"]], {"max_content_cells": 2, "header_weight": 1}, "A 1 | 2"),
    ([["A", "B", "C"], ["x"]], {"header_weight": 1}, "A | B | C x"),
    ([["A"], ["x"]], {"header_rows": 5, "header_weight": 1}, "A | x"),
    ([["A"], ["x"]], {"header_rows": 0}, "A | x"),
    ([["A"], ["x"]], {"header_weight": 0}, "x"),
    ([["ABC"], ["x"]], {"header_weight": 1, "max_length": 2}, "AB"),
    ([["A"], ["850 000"]], {"header_weight": 1}, "A 850 000"),
    ([["A"], ["a b　c\x1fd"]], {"header_weight": 1}, "A a b c d"),
    ([["A"], None, ["x"]], {"header_weight": 1}, "A x"),
])
def test_render_fixtures(spark, table, kw, expected):
    assert render(spark, table, **kw) == expected


def test_json_scalars_keep_json_spelling(spark):
    df = spark.createDataFrame([('[["A"],[1, 1.5, true]]',)], "j string")
    out = df.select(render_text(F.from_json("j", "array<array<string>>"), header_weight=1).alias("x")).first()["x"]
    assert out == "A 1 | 1.5 | true"


def test_split_separated(spark):
    df = spark.createDataFrame([("h1 __CONTENU__ c1 __CONTENU__ c2",), ("only header",)], "t string")
    h, b = split_separated(F.col("t"))
    rows = df.select(h.alias("h"), b.alias("b")).collect()
    assert (rows[0]["h"], rows[0]["b"]) == ("h1", "c1 __CONTENU__ c2")
    assert (rows[1]["h"], rows[1]["b"]) == ("only header", "")


def test_unknown_layout_is_an_error():
    with pytest.raises(ValueError):
        render_text(F.col("t"), layout="nope")


def test_render_plan_has_no_python(spark):
    df = spark.createDataFrame([([["a"]],)], T.StructType([T.StructField("t", MATRIX)]))
    plan = df.select(render_text("t").alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
