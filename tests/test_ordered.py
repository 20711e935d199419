"""Ordered scans against plain loops, with many ranges forced on small inputs."""

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracegrid.functions.text import blank_to_null
from tracegrid.operators import ordered as o

ROWS = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", "", "  ", None])), min_size=1, max_size=40
)


def loop(data, grouped):
    last, count, out = {}, {}, []
    order = sorted(range(len(data)), key=lambda i: i)
    for i in order:
        group, value = data[i]
        key = group if grouped else 0
        if value and value.strip():
            last[key] = value
        count[key] = count.get(key, 0) + 1
        out.append((i, last.get(key), count[key]))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=ROWS, ranges=st.integers(2, 7), grouped=st.booleans())
def test_scan_equals_loop(spark, data, ranges, grouped):
    shuffled = [(i, g, v) for i, (g, v) in enumerate(data)]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "i int, g string, v string")
    part = ["g"] if grouped else []
    filled = o.fill_down(df, ["v"], ["i"], part, ranges=ranges)
    done = o.row_number(filled, ["i"], "n", part, ranges=ranges)
    assert [(r["i"], r["v"], r["n"]) for r in rows(done, "i")] == loop(data, grouped)


def test_hot_group_is_split_into_ranges(spark):
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("g"))
    ranged = o.assign_ranges(df, ["g", "id"], 6)
    sizes = ranged.where("g = -1").groupBy(o.RANGE).count().agg(F.count("*").alias("n"), F.max("count").alias("m")).first()
    assert sizes.n >= 3 and sizes.m < 3000
    done = o.row_number(df, ["id"], "n", ["g"], ranges=6).where("g = -1").agg(F.max("n"), F.countDistinct("n")).first()
    assert tuple(done) == (6000, 6000)


def test_blank_number_is_carried_as_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, None)], "i int, v string")
    done = o.ordered_scan(df, ["i"], fills={"f": F.col("v")}, ranges=3)
    assert [r["f"] for r in rows(done, "i")] == ["a", "a", "", ""]


def test_fill_typed_columns(spark):
    df = spark.createDataFrame([(0, "", 1), (1, "", None), (2, "x", 2), (3, "", None)], "i int, A string, B int")
    done = rows(o.fill_down(df, ["A", "B", "unknown"], ["i"]), "i")
    assert [r["A"] for r in done] == [None, None, "x", "x"]
    assert [r["B"] for r in done] == [1, 1, 2, 2]


def test_infer_fill_down(spark):
    data = [(0, None, "p", 1), (1, "A", None, 2), (2, None, "q", 3), (3, "B", None, 4)]
    df = spark.createDataFrame(data, "i int, Category string, Subcategory string, ID int")
    assert o.fill_columns(df, ["Category", "Subcategory", "ID", "none"], ["i"]) == ["Category", "Subcategory"]
    blank = spark.createDataFrame([(0, "A"), (1, "B")], "i int, c string")
    assert o.fill_columns(blank, ["c"], ["i"]) == []


@pytest.mark.parametrize("block", [5, 4096])
def test_neighbours_across_blocks(spark, block):
    df = spark.range(23).select("id", (F.col("id") % 2).alias("g"))
    done = rows(o.neighbours(df, ["g"], ["id"], F.col("id"), 2, 1, block=block), "id")
    for r in done:
        same = [x for x in range(23) if x % 2 == r["g"]]
        at = same.index(r["id"])
        assert r["prev"] == same[max(0, at - 2) : at][::-1]
        assert r["next"] == same[at + 1 : at + 2]


def test_distinct_first_keeps_null_key(spark):
    df = spark.createDataFrame([(2, "a", "late"), (1, "a", "early"), (3, None, "n")], "i int, k string, v string")
    assert [(r["k"], r["v"]) for r in rows(o.distinct_first(df, ["k"], ["i"]), "k")] == [(None, "n"), ("a", "early")]


def test_parts_of_group(spark):
    df = spark.range(10).select("id", F.lit("g").alias("g"))
    parts = rows(o.parts_of_group(df, ["g"], ["id"], 4).groupBy("part").agg(F.collect_set("id").alias("ids")), "part")
    assert [sorted(p["ids"]) for p in parts] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_distinct_first_by_any_order(spark):
    """Nulls come first; numbers, dates and texts in the order; ties of the first column; no rows."""
    data = [
        ("a", None, 9, "late", "x"), ("a", 1, 2, "early", "y"), ("b", 2, 1, "z", "p"), ("b", 2, -5, "a", "q"),
        ("b", -3, 7, "m", "r"), (None, 2**62, 1, "k", "s"), (None, -(2**62), None, "j", "t"),
    ]
    df = spark.createDataFrame(data, "k string, n bigint, m int, s string, v string")
    small = lambda x: (x is not None, x)
    for order in (["n"], ["n", "m"], ["m", "n"], ["s"], ["s", "n"], ["n", "m", "s"]):
        at = [["k", "n", "m", "s", "v"].index(c) for c in order]
        want = {}
        for r in sorted(data, key=lambda r: [small(r[i]) for i in at], reverse=True):
            want[r[0]] = r
        if order == ["n"]:
            df_, want = df.where("not (k <=> 'b' and m <=> 1)"), {**want, "b": data[4]}
        else:
            df_ = df
        got = {r.k: tuple(r) for r in o.distinct_first(df_, ["k"], order).collect()}
        assert got == want, order
    dated = df.selectExpr("k", "date_add(date'1960-01-01', coalesce(m, 0)) as d", "timestamp_micros(n) as t", "v")
    assert {r.v for r in o.distinct_first(dated.where("v <> 'p'"), ["k"], ["d", "t"]).select("v").collect()} == {"y", "q", "t"}
    assert o.distinct_first(df.where("false"), ["k"], ["n", "m"]).count() == 0


def test_distinct_first_sorts_nothing(spark):
    df = spark.range(1000).selectExpr("cast(id % 7 as string) as k", "id as i", "cast(id as int) as j", "repeat('x', 50) as wide")
    plan = o.distinct_first(df, ["k"], ["i", "j"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_an_order_of_one_key_is_an_error(spark):
    same = spark.range(2).selectExpr("1 as i", "id as v")
    with pytest.raises(ValueError, match="unique"):
        o.row_number(same, ["i"], "n")
    assert o.row_number(same.limit(1), ["i"], "n").select("n").collect() == [(1,)]


@pytest.mark.parametrize("parts", [1, 5])
def test_kept_scan_equals_loop(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        data = [(i, None if i % 7 else f"v{i}", "  " if i % 3 else f"w{i}") for i in range(1, 60)]
        df = spark.createDataFrame(random.Random(1).sample(data, len(data)), "n int, a string, b string")
        fills = {c: blank_to_null(c) for c in ("a", "b")}
        got = rows(o.kept_scan(df, ["n"], fills, "place", {"a": "own"}), "n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    a = b = None
    for place, ((n, x, y), r) in enumerate(zip(data, got, strict=True), 1):
        a, b = x or a, y.strip() or b
        assert r == {"n": n, "a": a, "b": b, "place": place, "own": x is not None}


def test_kept_scan_of_no_rows(spark):
    df = spark.createDataFrame([], "n int, a string")
    assert rows(o.kept_scan(df, ["n"], {"a": F.col("a")}, "place")) == []
