from conftest import rows

from tracegrid.operators import diff as d
from tracegrid.plans.compare import diff_and_report
from tracegrid.sources.flat import widen_numeric

MAPPING = {"id": "id", "val": "val_r"}


def sides(spark):
    left = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, val string")
    right = spark.createDataFrame([(1, "A"), (2, "B_mod"), (4, "D")], "id long, val_r string")
    return left, right


def test_statuses(spark):
    done = rows(d.table_diff(*sides(spark), MAPPING, ["id"]), "id")
    assert [(r["id"], r["_merge"], r["changed_columns"]) for r in done] == [
        (1, "equal", ""),
        (2, "changed", "val"),
        (3, "left_only", ""),
        (4, "right_only", ""),
    ]
    assert done[3]["val"] is None and done[3]["val_right"] == "D"


def test_mirror_and_self(spark):
    left, right = sides(spark)
    forth = d.diff_summary(d.table_diff(left, right, MAPPING, ["id"])).first()
    back = d.diff_summary(d.table_diff(right, left, {"id": "id", "val_r": "val"}, ["id"])).first()
    assert (forth.left_only, forth.right_only, forth.changed) == (back.right_only, back.left_only, back.changed)
    same = d.diff_summary(d.table_diff(left, left, {"id": "id", "val": "val"}, ["id"])).first()
    assert (same.total, same.equal) == (3, 3)


def test_null_and_repeated_keys(spark):
    left = spark.createDataFrame([(None, "a"), (1, "x"), (1, "y")], "id long, val string")
    right = spark.createDataFrame([(None, "a"), (1, "x"), (1, "z")], "id long, val_r string")
    got = sorted((str(r["id"]), r["_merge"]) for r in rows(d.table_diff(left, right, MAPPING, ["id"])))
    assert got == [("1", "changed")] * 3 + [("1", "equal"), ("None", "left_only"), ("None", "right_only")]


def test_filled_keys(spark):
    left = spark.createDataFrame([(0, "A", 1), (1, None, 2), (2, "B", 3)], "n int, Category string, ID int")
    right = spark.createDataFrame([(0, "A", 1), (1, " ", 2), (2, "C", 3)], "n int, Cat string, ID int")
    mapping = {"n": "n", "Category": "Cat", "ID": "ID"}
    done = d.table_diff(left, right, mapping, ["ID"], fill_down=["Category"], order_by=["n"])
    assert [r["_merge"] for r in rows(done, "ID")] == ["equal", "equal", "changed"]


def test_generated_counts(spark):
    left = spark.range(1, 501).selectExpr("id", "concat('n', id) as name", "id * 1.5 as price")
    right = spark.sql(
        "select id, concat('n', id) as name, case when id > 200 then id * 2.0 else id * 1.5 end as price "
        "from range(1, 401) union all select id, 'new', 1.0 from range(501, 551)"
    )
    s = d.diff_summary(d.table_diff(left, right, {c: c for c in ("id", "name", "price")}, ["id"])).first()
    assert (s.equal, s.changed, s.left_only, s.right_only) == (200, 200, 100, 50)


def test_row_diff_counts_copies(spark):
    left = spark.createDataFrame([("ab", "c"), ("ab", "c"), (None, "q")], "a string, b string")
    right = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "q")], "a string, b string")
    got = {(r["a"], r["b"], r["_merge"]): r["rows"] for r in rows(d.row_diff(left, right, {"a": "a", "b": "b"}))}
    assert got == {
        ("ab", "c", "equal"): 1,
        ("ab", "c", "left_only"): 1,
        ("a", "bc", "right_only"): 1,
        (None, "q", "equal"): 1,
    }


def test_hybrid_ignores_case_and_blanks(spark):
    old = spark.createDataFrame([(1, 5, "A b"), (2, 6, None), (3, 7, "x")], "k int, row_number int, SIGNAL_NAME string")
    new = spark.createDataFrame([(1, 8, "aB"), (2, 9, "y"), (4, 1, "z")], "k int, row_number int, SIGNAL_NAME string")
    done = rows(d.hybrid_diff(old, new, ["k"]), "k")
    assert [(r["k"], r["change_type"], r["changed_fields"]) for r in done] == [
        (2, "Modified", "SIGNAL_NAME"),
        (3, "Deleted", "SIGNAL_NAME"),
        (4, "Inserted", "SIGNAL_NAME"),
    ]
    assert d.compare_columns(old, new, ["k"], [], False, "row_number", "SIGNAL_NAME") == []


def test_cells_and_report(spark, tmp_path):
    left, right = sides(spark)
    diff = d.table_diff(left, right, MAPPING, ["id"])
    assert rows(d.diff_cells(diff, ["id"], MAPPING)) == [{"id": 2, "column_name": "val", "change": "B -> B_mod"}]
    assert rows(d.diff_side_by_side(diff, ["id"], MAPPING)) == [{"id": 2, "val_old": "B", "val_new": "B_mod"}]
    text = [df.select(*[df[c].cast("string") for c in df.columns]) for df in (left, right)]
    done = diff_and_report(*text, MAPPING, ["id"], ["id"], hierarchy=["val"])
    tree = {r["h1"]: r["total"] for r in rows(done.tree()) if r["level"] == 1}
    assert tree == {"A": 1, "B": 1, "C": 1, "D": 1}
    done.write_json(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_mixed_columns_stay_text(spark):
    """One number at the head of a column of texts hides no change."""
    left = spark.createDataFrame([(i, "7" if i == 0 else f"old {i}", f"{i}.50") for i in range(300)], "k int, v string, n string")
    right = spark.createDataFrame([(i, "7" if i == 0 else f"new {i}", f"{i}.5") for i in range(300)], "k int, v string, n string")
    done = diff_and_report(left, right, {"k": "k", "v": "v", "n": "n"}, ["k"], ["k"])
    assert done.summary().first().asDict() == {"total": 300, "changed": 299, "left_only": 0, "right_only": 0, "equal": 1}
    wide, report = widen_numeric(left)
    assert wide.dtypes == [("k", "int"), ("v", "string"), ("n", "double")]
    assert {r.column_name: r.cast_errors for r in report.collect()} == {"v": 299, "n": 0}


def test_any_column_name(spark):
    """Dots, quotes, back ticks and names that differ in case only."""
    names = ["Sect. No", "Calc'd", "Rate `ms`", "a"]
    left = spark.createDataFrame([(1, "x", 2.0, "p"), (2, "y", 3.0, "q"), (None, "n", 1.0, "r")], ["k", "c", "r", "a"]).toDF(*names)
    right = spark.createDataFrame([(1, "x", 2.5, "p"), (3, "z", 3.0, "q"), (None, "n", 1.0, "r")], ["k", "c", "r", "a"]).toDF(*names)
    diff = d.table_diff(left, right, {n: n for n in names}, ["Sect. No"])
    got = {(r["Sect. No"], r._merge, r.changed_columns) for r in diff.collect()}
    assert got == {(1, "changed", "Rate `ms`"), (2, "left_only", ""), (3, "right_only", ""), (None, "left_only", ""), (None, "right_only", "")}
    assert d.diff_cells(diff, ["Sect. No"], {n: n for n in names}).first().column_name == "Rate `ms`"
    assert d.diff_side_by_side(diff, ["Sect. No"], {n: n for n in names}).count() == 1
    assert {r["h1"] for r in d.diff_tree_stats(diff, ["Calc'd"]).collect()} >= {"x", "y"}
    assert d.row_diff(left, right, {n: n for n in names}).count() == 5
    hybrid = d.hybrid_diff(left, right, ["Sect. No"], names[1:])
    found = {(r["Sect. No"], r.change_type): r.changed_fields for r in hybrid.collect() if r["Sect. No"]}
    assert set(found) == {(1, "Modified"), (2, "Deleted"), (3, "Inserted")} and found[1, "Modified"] == "Rate `ms`"


def test_rows_in_text_order_are_filled_as_numbers(spark):
    """Row 10 comes after row 9 though its text sorts before."""
    from tracegrid.plans.compare import diff_and_report

    rows = [(str(i), {1: "A", 9: "B"}.get(i)) for i in range(1, 13)]
    left = spark.createDataFrame(rows, "row string, name string")
    right = spark.createDataFrame([(r, "A" if int(r) < 9 else "B") for r, _ in rows], "nr string, label string")
    done = diff_and_report(left, right, {"row": "nr", "name": "label"}, ["row"], ["row"], ["name"])
    assert {r._merge for r in done.rows.collect()} == {"equal"}
    assert done.casts.collect() == [("left", "row", 0), ("right", "nr", 0)]


def test_files_are_compared_in_their_own_order(spark, tmp_path):
    from tracegrid.plans.compare import compare_files

    (tmp_path / "l.csv").write_text('id,group,note,size\nz,G1,"a\nb",1\ny,,c,2\nx,G2,,3x\n')
    (tmp_path / "r.csv").write_text('key,g,n,s\nz,G1,"a\nb",1.0\nx,G2,,3x\ny,,c,2\n')
    mapping = {"id": "key", "group": "g", "note": "n", "size": "s"}
    done = compare_files(spark, str(tmp_path / "l.csv"), str(tmp_path / "r.csv"), mapping, ["id"], ["group"])
    got = {r["id"]: (r.group, r.group_right, r.note, r.changed_columns) for r in done.rows.collect()}
    assert got == {"z": ("G1", "G1", "a\nb", "size"), "y": ("G1", "G2", "c", "group"), "x": ("G2", "G2", None, "")}
    assert {(r.side, r.column_name, r.cast_errors) for r in done.casts.collect()} == {("left", "size", 1), ("right", "s", 1)}
    assert not [c for c in done.rows.columns if "position" in c]
