"""Numbers worked out where the rows pass anyway."""

from conftest import rows
from pyspark.sql import functions as F

from tracegrid.operators import ordered
from tracegrid.operators import requirements as r
from tracegrid.plans import requirements as plan


def test_order_of_known_spans_is_a_long(spark):
    data = [(-5, 2), (None, 7), (10**12, None), (10**12, -3), (0, 0)]
    df = spark.createDataFrame(data, "a long, b int")
    spans = ordered.order_spans(df, ["a", "b"])
    assert spans == {"a": (-5, 10**12), "b": (-3, 7)}
    packed = df.withColumn("v", ordered.order_value(df, ["a", "b"], spans))
    assert dict(packed.dtypes)["v"] == "bigint"
    assert [(x["a"], x["b"]) for x in rows(packed, "v")] == [(x["a"], x["b"]) for x in rows(df, "a", "b")]
    wide = spark.createDataFrame([(-(2**63), 2**63 - 1), (2**63 - 1, 0)], "a long, b long")
    assert ordered.order_value(wide, ["a", "b"], ordered.order_spans(wide, ["a", "b"])) is not None
    assert dict(wide.withColumn("v", ordered.order_value(wide, ["a", "b"], ordered.order_spans(wide, ["a", "b"]))).dtypes)["v"] != "bigint"


def test_merged_values_keep_their_order_over_two_long_columns(spark):
    data = [("g", 2, 1, "b,a"), ("g", 1, 9, "c"), ("g", 1, 2, "a"), ("h", None, 1, "z")]
    df = spark.createDataFrame(data, "g string, o long, n long, c string")
    got = rows(r.merge_duplicates(df, ["g"], ["o", "n"], ["c"], ["c"]), "g")
    assert [(x["o"], x["n"], x["ids"]["c"], x["texts"]["c"]) for x in got] == [(1, 2, ["a", "c", "b"], "a | c | b,a"), (None, 1, ["z"], "z")]


def test_sheets_are_numbered_in_their_own_scans(spark, monkeypatch):
    generic = r.DocKind("D", "generic", ids=("ID",), texts=("Text",))
    sheet = spark.createDataFrame(
        [(1, "1", "", "Head"), (2, "1-1", "r-1", "one"), (3, "1-2", "", "no id"), (4, "", "r-2", "no number"), (5, "1-3", "r-3", "three")],
        "d long, `Object Number` string, ID string, Text string",
    )
    guide = spark.createDataFrame([(1, "s-1", "Info", "x"), (2, "s-2", "", "y"), (3, "", "", "z"), (4, "s-3", None, "w")], "d long, ID string, `Object Type` string, Text string")
    ssg = r.DocKind("S", "ssg", ids=("ID",), texts=("Text",))
    seen = []
    real = plan.row_number
    monkeypatch.setattr(plan, "row_number", lambda df, *a, **k: (seen.append(df.columns), real(df, *a, **k))[1])
    sheets = [plan.Sheet(sheet, generic, "A", "", ["d"]), plan.Sheet(guide, ssg, "B", "", ["d"]), plan.Sheet(sheet.where("d > 1"), generic, "C", "", ["d"])]
    got = rows(plan.build_requirements(sheets).rows, "row_idx")
    assert [(x["row_idx"], x["Doc_Name"], x["Row_Index"]) for x in got] == [
        (0, "A", 0), (1, "A", 1), (2, "A", 4), (3, "B", 1), (4, "B", 3), (5, "C", 0), (6, "C", 3),
    ]
    # No stacked texts are moved for their numbers.
    assert not seen and "doc_seq" not in got[0] and plan.PLACE not in got[0]


def test_own_normalizers_need_no_numbers(spark):
    sheet = spark.createDataFrame([(3, "x"), (1, "y")], "d long, Text string")

    def own(s):
        cells = {"Req_ID": F.col("Text"), "Object_Number": F.lit(""), "Section_Number": F.lit(""), "Is_Section_Header": F.lit(False)}
        return s.rows.select(*[e.alias(n) for n, e in (cells | s.document.columns()).items()], F.col("d").alias("Row_Index")), None, None

    kind = r.DocKind("D", "own")
    got = rows(plan.build_requirements([plan.Sheet(sheet, kind, "A", "", ["d"])], registry={"own": own}).rows, "row_idx")
    assert [(x["row_idx"], x["Req_ID"]) for x in got] == [(0, "y"), (1, "x")]
