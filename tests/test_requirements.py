import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracegrid.functions import ids as I
from tracegrid.operators import render, views
from tracegrid.operators import requirements as r
from tracegrid.plans.requirements import Sheet, build_requirements

SRS = r.DocKind(
    "SRS",
    "srs",
    ids=("SRS Section", "Req't No"),
    texts=("Requirement Text",),
    required=("SRS Section",),
    optional=("Traceability Doc Reqd #", "Trace Source"),
    parents=("Traceability Doc Reqd #",),
    infer=r.InferRule(False, False, True, True, "SRS_Local_Req_No", "SRS_Section", "Section_Title", None),
)


def one(spark, **values):
    return spark.createDataFrame([values], ", ".join(f"`{k}` string" for k in values))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ids(spark):
    norm = lambda s: value(spark, I.normalize_req_id(F.lit(s)))
    assert [norm(s) for s in ("SSG-34", "FCSS-12A", "", "x-000", "ab-1234567", "not an id")] == [
        "SSG-00034", "FCSS-00012A", "", "X-00000", "AB-1234567", "notanid",
    ]
    assert value(spark, I.parse_id_list(F.lit("ssg-1; SSG-001; fcss-10a, FCSS-10A"))) == ["SSG-00001", "FCSS-00010A"]


def test_merged_sheet(spark):
    schema = "n int, `SRS Section` string, `Req't No` string, `Requirement Text` string, `Traceability Doc Reqd #` string, `Trace Source` string"
    df = spark.createDataFrame(
        [(0, "3.2", "1a", "Shall work", "DOC-1", "one"), (1, "3.2", "1a", "Shall work", "DOC-2", "two")], schema
    )
    accepted, collapsed = r.normalize_merged(df, SRS, r.Document("D", "SRS", "Low"), ["n"])
    got = rows(accepted)
    assert [(x["Req_ID"], x["Parent_Req_IDs"]) for x in got] == [("SRS-3.2-1a", "DOC-00001, DOC-00002")]
    assert "Trace Source: one | two" in got[0]["Combined_Text"]
    assert collapsed.first().duplicate_rows_collapsed == 1


def test_inference(spark):
    df = one(spark, Req_ID="SRS-3.2-1a", SRS_Section="", SRS_Local_Req_No="")
    got = rows(r.infer_sections(df, SRS.infer))[0]
    assert (got["SRS_Section"], got["SRS_Local_Req_No"], got["Section_Inferred"]) == ("3.2", "1a", True)
    bare = one(spark, Req_ID="R-1", Object_Number="1.2-1", Section_Title="", Section_Number="", Section_Type="")
    context = {"title": F.lit("Hydraulics"), "number": F.lit("1.2"), "type": F.lit("")}
    got = rows(r.infer_sections(bare, r.InferRule(from_req_id=False), context))[0]
    assert (got["Section_Title"], got["Section_Number"], got["SectionTitle"]) == ("Hydraulics", "1.2", "Hydraulics")


@pytest.mark.parametrize(
    "text, number, title",
    [("1.2.3-1 The pump", "1.2.3-1", "The pump"), ("No number", "", "No number"), ("1.2 one\ntwo", "", "1.2 one\ntwo"), ("7", "", "7")],
)
def test_leading_number(spark, text, number, title):
    df = one(spark, Req_ID="x", Requirement_Text=text, Section_Title="", Section_Number="")
    got = rows(r.infer_sections(df, r.InferRule(False, False, True, False, aliases=())))[0]
    assert (got["Section_Number"], got["Section_Title"]) == (number, title)


KIND = r.DocKind(
    "T", "generic", required=("Requirement ID", "Object Number"), optional=("Safety",), parents=("Up", "Up 2"), sections=r.SectionRule(("Requirement Text",))
)


def sheet(spark, data):
    return spark.createDataFrame(
        data, "n int, `Requirement ID` string, `Object Number` string, `Requirement Text` string, `Requirement Type` string, Up string, `Up 2` string, Safety string"
    )


def test_traceable_sheet(spark):
    df = sheet(
        spark,
        [
            (0, None, "1", "Intro", None, None, None, None),
            (1, "r-1; r-2", "1-1", "First", "Header", "p-1", "P-1", "high"),
            (2, "", "1-2", "No id", None, None, None, None),
            (3, "r-3", "", "No number", None, None, None, None),
            (4, "", "", "Old style", "Section Heading", None, None, None),
            (5, "r-4", "2-1", "Last", "Note", None, None, " "),
        ],
    )
    doc = r.Document("Doc", "T", "Low")
    accepted, rejected = r.normalize_traceable(df, KIND, doc, ["n"])
    got = rows(accepted, "Row_Index")
    assert [x["Req_ID"] for x in got] == ["1", "R-00001", "SECTION_2", "R-00004"]
    assert [x["Section_Number"] for x in got] == ["1", "1", "", "2-1"]
    assert [x["Section_Type"] for x in got] == ["section", "section", "Section Heading", "Note"]
    assert got[1]["Aliases"] == "R-00002" and got[1]["Parent_Req_IDs"] == "P-00001"
    assert "Title: Intro\\nDocument: Doc (T)" in got[0]["Combined_Text"]
    assert [(x["Reason"], x["Row_Index"]) for x in rows(rejected, "Row_Index")] == [
        ("missing_requirement_id", 2), ("missing_object_number", 3),
    ]
    twice, _ = r.normalize_traceable(df, KIND, doc, ["n"], dedupe_links=False)
    assert rows(twice, "Row_Index")[1]["Parent_Req_IDs"] == "P-00001, P-00001"


def test_dots_in_column_names(spark):
    kind = r.DocKind("T", "generic", ids=("Req. ID",), texts=("Text v1.0",), optional=("Opt. A",), sections=r.SectionRule(("Text v1.0",), "Obj. No"))
    df = spark.createDataFrame(
        [(0, "r-1", "1-1", "First", "a"), (1, "r-2", "1-2", "Second", "")], "n int, `Req. ID` string, `Obj. No` string, `Text v1.0` string, `Opt. A` string"
    )
    got = rows(r.normalize_traceable(df, kind, r.Document("D", "T"), ["n"])[0], "Row_Index")
    assert [(x["Req_ID"], x["Object_Number"], x["Opt._A"]) for x in got] == [("R-00001", "1-1", "a"), ("R-00002", "1-2", "")]


def test_section_columns_override(spark):
    schema = "n int, `Object Number` string, `Requirement Text` string, `Section Title` string, `OLE Title` string, `Section Type` string"
    df = spark.createDataFrame(
        [(0, "1", "Head", None, "no", None), (1, "1-1", "x", "Named", "no", "CHAPTER"), (2, "1-2", "y", None, "no", "chapter"), (3, "1-3", "z", None, "no", "Other")],
        schema,
    )
    done = rows(r.section_context(df, r.SectionRule(("Requirement Text",)), ["n"]), "Row_Index")
    assert [x["ctx_title"] for x in done] == ["Head", "Named", "Named", "Named"]
    assert [x["ctx_type"] for x in done] == ["section", "CHAPTER", "CHAPTER", "Other"]


def reqs(spark, data):
    names = "row_idx int, Req_ID string, Doc_Name string, Doc_Type string, Level string, Requirement_Text string, Combined_Text string, Parent_Req_IDs string, Child_Req_IDs string"
    return spark.createDataFrame(data, names)


def test_star_has_each_trace_once(spark):
    df = reqs(spark, [(0, "P-1", "D", "T", "L", "t", "c", "", "C-1"), (1, "C-1", "D", "T", "L", "t", "c", "P-1", "")])
    star = r.build_star(df, ["row_idx"])
    assert {n: t.count() for n, t in star.items()} == {"documents": 1, "requirements": 2, "traces": 1}
    assert rows(star["traces"])[0]["source_req_id"] == "C-1"


def test_unique_names_and_text(spark):
    df = reqs(spark, [(0, "REQ-1", "Doc", "T", "L", "t", "c", "", ""), (1, "REQ-1", "Doc", "T", "L", "t", "c", "", "")])
    done = rows(render.rag_text(df, ["row_idx"]), "row_idx")
    assert [f"{x['folder']}/{x['file_name']}" for x in done] == ["Doc/REQ-1.txt", "Doc/REQ-1-1.txt"]
    assert done[0]["content"].startswith("Tag: Info\nRequirement ID: REQ-1\n")


def test_generated_names_leave_stems_alone(spark):
    stems = ["a", "a", "a-1", "a", "a-2", "a-1", "b"]
    df = spark.createDataFrame([(i, "f", s) for i, s in enumerate(stems)], "i int, f string, s string")
    done = rows(views.unique_names(df, ["f"], F.col("s"), ["i"]), "i")
    assert [x["unique_name"] for x in done] == ["a", "a-3", "a-1", "a-4", "a-2", "a-1-1", "b"]


def test_large_sections_come_in_parts(spark):
    df = spark.range(30).select(
        F.col("id").alias("row_idx"),
        F.concat(F.lit("R-"), F.col("id").cast("string")).alias("Req_ID"),
        F.lit("D").alias("Doc_Name"),
        F.lit("T").alias("Doc_Type"),
        F.lit("L").alias("Level"),
        F.lit("1.1-1").alias("Section_Number"),
        F.lit("").alias("Section_Title"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("Requirement_Text"),
        F.lit(False).alias("Is_Section_Header"),
    )
    whole = rows(render.section_documents(df, ["row_idx"]), "part")
    parts = rows(render.section_documents(df, ["row_idx"], part_lines=7), "part")
    assert len(whole) == 1 and len(parts) > 3
    assert "\n".join(p["content"] for p in parts) == whole[0]["content"]


def test_section_order(spark):
    data = ["2", "10", "1.2", "1.10", "1", "1.0", "", "1.2.0.1"]
    df = spark.createDataFrame([(s,) for s in data], "s string")
    got = [x["s"] for x in rows(df.withColumn("k", views.section_order("s")), "k", "s")]
    assert got == ["1", "1.0", "1.2", "1.2.0.1", "1.10", "2", "10", ""]


def test_build_skips_incomplete_sheets(spark):
    full = sheet(spark, [(0, "r-1", "1-1", "First", None, "p-1", None, None)])
    done = build_requirements(
        [Sheet(full.drop("Object Number"), KIND, "bad", "L", ["n"]), Sheet(full, KIND, "good", "L", ["n"])], "v9"
    )
    assert [(x["Doc_Name"], x["missing_column"]) for x in rows(done.missing)] == [("bad", "Object Number")]
    assert [(x["Doc_Name"], x["Schema_Version"]) for x in rows(done.rows)] == [("good", "v9")]
    assert done.star()["traces"].count() == 1 and done.markdown().count() == 1 and done.blocks().count() == 1
