"""What jobs leave on disk while they run: shuffle files of finished steps, second copies."""

import csv
import glob
import gzip
import os
import random

from pyspark.sql import functions as F

from tracegrid import checks
from tracegrid.operators import render, trace
from tracegrid.operators.storage import FREE_SHUFFLES, materialize
from tracegrid.sources.sinks import write_normalized

checks.load_all()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    return {p for p in paths if os.path.basename(p).startswith("shuffle_")}


def flat_input(spark, folder):
    """Lines of three orders from two suppliers; some lines come twice, some keys are null."""
    lines = [(o, line, s, 10 * s + line, 5.0 + line) for o in (1, 2, 3) for line in (1, 2) for s in (7, 8)]
    lines += [lines[0], lines[3], (4, 1, None, 1, 1.0), (None, 1, 7, 1, 1.0)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double"),
        "supplier": ([(7, 'Sup "7", x', 1), (8, "", 2)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(1, "N1", 0), (2, "N2", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R0")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_normalized_tables_leave_no_shuffle_files(spark, tmp_path):
    flat_input(spark, tmp_path)
    before, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES, None)
    done = checks.QUERIES["write_normalized_tables"](spark, str(tmp_path))
    assert shuffle_files(spark) <= before
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    rows = {fmt: sorted(map(str, done.where(f"format = '{fmt}'").drop("format").collect())) for fmt in ("parquet", "csv")}
    assert rows["csv"] == rows["parquet"] and len(rows["csv"]) == 1 + 2 + 2 + 6 + 12 + 4


def test_csv_stays_sorted_by_key_and_is_compressed(spark, tmp_path, monkeypatch):
    flat_input(spark, tmp_path)
    monkeypatch.setattr("tracegrid.checks.hierarchy.shared_folder", lambda spark: str(tmp_path))
    checks.QUERIES["write_normalized_tables"](spark, str(tmp_path))
    parts = sorted(glob.glob(f"{tmp_path}/tracegrid/*/csv/word/part-*.csv.gz"))
    keys = [(r["Wordstring_LOID"], int(r["Word_Seq_Num"])) for p in parts for r in csv.DictReader(gzip.open(p, "rt"))]
    assert keys == sorted(keys) and len(keys) == 12


def test_write_normalized_is_plain_unless_asked(spark, tmp_path):
    df = spark.createDataFrame([("b", 'q "x", y'), ("a", None), ("c", "")], "k string, v string").orderBy("k")
    write_normalized({"t": df}, df, f"{tmp_path}/plain", "csv")
    write_normalized({"t": df}, df, f"{tmp_path}/small", "csv", compression="gzip")
    assert glob.glob(f"{tmp_path}/plain/t/*.csv") and glob.glob(f"{tmp_path}/small/t/*.csv.gz")
    read = lambda p: sorted(map(str, spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/{p}/t").collect()))
    assert read("plain") == read("small") and len(read("small")) == 3


def test_kept_result_frees_its_shuffle(spark):
    before = shuffle_files(spark)
    kept = materialize(spark.range(50).groupBy("id").count(), free=True)
    assert shuffle_files(spark) <= before and kept.count() == 50


def requirements(spark, n, text):
    rows = [
        (i, f"REQ-{i:05d}", f"D {i % 2}", f"{i % 3 + 1}.{i % 5}-{i}", text(i), f"{i % 3 + 1}.{i % 5}", "Area" if i % 4 else "")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "i int, Req_ID string, Doc_Name string, Object_Number string, Requirement_Text string, Section_Number string, Section_Title string"
    )


def test_merged_sections_move_a_text_three_times(spark, tmp_path):
    """Once to its id, to its row and in its block to its section, whatever is joined; no other shuffle files stay."""
    draw, held = random.Random(3), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    alphabet = "".join(chr(c) for c in range(33, 127))
    texts = ["".join(draw.choices(alphabet, k=4000)) for _ in range(300)]
    requirements(spark, 300, lambda i: texts[i]).write.parquet(f"{tmp_path}/r")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffle_files(spark)
        done = render.merged_sections(render.rag_blocks(spark.read.parquet(f"{tmp_path}/r"), ["i"]), ["i"], max_per=3)
        sizes = {p: os.path.getsize(p) for p in shuffle_files(spark) - before if os.path.exists(p)}
        merged = done.collect()
        sizes |= {p: os.path.getsize(p) for p in shuffle_files(spark) - before if os.path.exists(p)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    moved = sum(sizes.values())
    assert moved < 4 * sum(map(len, texts))
    content = {(r.doc_slug, r.bucket): r.content for r in merged}
    assert sum(r.blocks for r in merged) == 300 and len(content) == len(merged)
    assert sum(t in c for t in texts for c in content.values()) == 300
    slugs = [r.doc_slug for r in merged]
    assert slugs == sorted(slugs) and len(set(slugs)) == 2


def test_links_of_rows_that_share_their_order(spark):
    """Rows with one order show the lines of all of them; a row without order none; a column without type stays."""
    rows = [
        (1, "REQ-00001", "see REQ-2, REQ-9", "REQ-00002"), (2, "REQ-00002", "two", ""), (2, "REQ-00003", "see REQ-1", "REQ-00001"),
        (None, "REQ-00004", "see REQ-1", "REQ-00001"),
    ]
    df = spark.createDataFrame(rows, "i int, Req_ID string, Requirement_Text string, up string").withColumns(
        {"Doc_Name": F.lit("D"), "resolved_title": F.lit(""), "none": F.lit(None)}
    )
    done = trace.link_context(df, ["i"], F.col("up"), F.lit(""))
    got = {r.Req_ID: (r.linked_lines, r.referenced_lines, r.none) for r in done.collect()}
    two, one = "- [in] REQ-00002 (D, N/A): two", "- [in] REQ-00001 (D, N/A): see REQ-2, REQ-9"
    shared = ([one], ["Referenced REQ-00001: see REQ-2, REQ-9"], None)
    assert got["REQ-00001"] == (
        [two, "- [text] REQ-00009: N/A"], ["Referenced REQ-00002: two", "Referenced REQ-00009: N/A"], None
    )
    assert got["REQ-00002"] == got["REQ-00003"] == shared
    assert got["REQ-00004"] == ([], [], None)
