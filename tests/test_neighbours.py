"""Requirements with what is around them: rows put together from short columns and texts that move by row number."""

from conftest import rows
from pyspark.sql import functions as F

from tracegrid.operators import ordered, render

SCHEMA = """row_idx long, Req_ID string, Doc_Name string, Doc_Type string, Section_Number string, Section_Title string,
Requirement_Text string, Is_Section_Header boolean, Parent_Req_IDs string, Child_Req_IDs string"""


def reqs(spark, *texts):
    head = (0, "REQ-00000", "D", "T", "1.1", "Brakes", "Area", True, None, "REQ-00001")
    data = [(n, f"REQ-{n:05d}", "D", "T", f"1.1-{n}", "", t, False, f"REQ-{n - 1:05d}, NO-1", "") for n, t in enumerate(texts, 1)]
    return spark.createDataFrame([head, *data], SCHEMA)


def section(content, start, stop):
    return content.split(start)[1].split(stop)[0].strip().splitlines()


def test_neighbours_and_linked_texts(spark):
    df = reqs(spark, "one\nline", "two", "", "four")
    got = {r["row_idx"]: r for r in rows(render.neighbour_markdown(df, ["row_idx"], include_trace_text=True))}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert section(got[2]["content"], "**Previous:**", "**Next:**") == ["- REQ-00001: one line"]
    assert section(got[2]["content"], "**Next:**", "## Trace") == ["- REQ-00004: four"]
    assert section(got[2]["content"], "**Parents:**\n-", "**Children:**") == ["REQ-00001: one line", "- NO-1"]
    # A text that is blank shows its id alone; a header has links and no neighbours.
    assert section(got[4]["content"], "Snippets\n\n**Parents:**", "**Children:**") == ["- REQ-00003", "- NO-1"]
    assert "_No neighboring requirements" in got[0]["content"] and "- REQ-00001: one line" in got[0]["content"]
    assert got[0]["file_name"] == "REQ-00000.md"


def test_rows_of_one_order_share_links(spark):
    df = reqs(spark, "one", "two")
    twice = df.unionByName(df.where("row_idx = 2"))
    got = rows(render.neighbour_markdown(twice, ["row_idx"], include_trace_text=True).where("row_idx = 2"))
    assert {r["file_name"] for r in got} == {"REQ-00002-1.md", "REQ-00002.md"}
    shown = [section(r["content"], "Snippets\n\n**Parents:**", "**Children:**") for r in got]
    assert shown == [["- REQ-00001: one"] * 2 + ["- NO-1"] * 2] * len(got)


def test_names_and_numbers_are_worked_out_without_texts(spark, monkeypatch):
    seen = []
    for module, name in ((render, "_placed"), (ordered, "row_number")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, _real=real, **k: (seen.append(df.columns), _real(df, *a, **k))[1])
    render.neighbour_markdown(reqs(spark, "one", "two"), ["row_idx"], include_trace_text=True)
    assert len(seen) >= 3 and not any("Requirement_Text" in columns for columns in seen)


def test_blocks_of_neighbours(spark):
    df = spark.range(1, 41).select(F.lit("g").alias("g"), "id", F.concat(F.lit("v"), "id").alias("v"))
    got = {r["id"]: r for r in rows(ordered.neighbours(df, ["g"], ["id"], F.col("v"), 2, 1, block=4))}
    assert all(got[n]["prev"] == [f"v{k}" for k in (n - 1, n - 2) if k >= 1] for n in got)
    assert all(got[n]["next"] == [f"v{k}" for k in (n + 1,) if k <= 40] for n in got)
    assert set(next(iter(got.values()))) == {"g", "id", "v", "prev", "next"}
