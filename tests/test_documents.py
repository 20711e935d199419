import math
import uuid

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracegrid.functions import text as X
from tracegrid.operators import chunks as c
from tracegrid.operators import ingest as i
from tracegrid.operators import retrieval as t
from tracegrid.operators.hierarchy import cascade_filter, hierarchy_index, normalize_tables
from tracegrid.operators.matching import fuzzy_best_match
from tracegrid.operators.storage import empty_frame
from tracegrid.sources import flat, sinks
from tracegrid.streaming.ingest import current_chunks, current_manifest, stream_ingest


def docs(spark, *texts):
    return spark.createDataFrame([(f"/d/{n}.md", x) for n, x in enumerate(texts)], "source_path string, text string")


@pytest.mark.parametrize(
    "text", ["word " * 900, "x" * 5000, "a " + "y" * 3000 + " b", "line\n" * 700, "short", "  ", "é ñ " * 2000]
)
def test_chunks_cover_the_text(spark, text):
    got = rows(c.chunk_text(docs(spark, text), "text", 1200, 200), "chunk_index")
    clean = text.strip()
    assert bool(got) == bool(clean)
    at = 0
    for piece in got:
        assert piece["start_char"] <= at and piece["end_char"] > at
        assert piece["end_char"] - piece["start_char"] <= 1200
        assert clean[piece["start_char"] : piece["end_char"]].strip() == piece["chunk"]
        at = piece["end_char"]
    assert at == len(clean)


def test_blocks(spark):
    md = "---\nk: 'v'\nk: w\nno colon\n---\n# A\none\n## B\ntwo\n---\n\n---\n### C\nthree\n"
    df = docs(spark, md)
    got = rows(c.markdown_blocks(df, "text"), "index")
    assert [(b["block"], b["heading_path"], b["heading_text"]) for b in got] == [
        ("# A\none\n## B\ntwo", "A > B", "B"),
        ("### C\nthree", "A > B > C", "C"),
    ]
    front, body = c.front_matter("text")
    assert df.select(front.alias("f")).first().f == {"k": "w"}
    unclosed = docs(spark, "---\nk: v\nrest")
    assert unclosed.select(c.front_matter("text")[0].alias("f"), c.front_matter("text")[1].alias("b")).first() == ({}, "---\nk: v\nrest")


def test_chunk_metadata(spark):
    md = "---\ndoc_level: HLR\nowner: me\n---\n## SSG-00042: Title\nReq_ID: SSG-00042\nSection: 2.3\nText"
    got = rows(c.chunk_documents(docs(spark, md), "source_path", "text"))[0]
    assert (got["req_id"], got["section_id"], got["object_number"], got["doc_level"]) == ("SSG-00042", "2.3", "2.3", "HLR")
    assert got["extra"] == {"owner": "me"} and got["doc_name"] == "0"
    assert got["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "/d/0.md::0"))


def test_optional_group_falls_back_to_the_match(spark):
    rules = {"req_id": [r"ID(?P<req_id>\d*)"]}
    meta = c.regex_metadata(F.lit("see ID here"), F.lit(""), F.lit(""), rules)
    assert spark.range(1).select(meta["req_id"].alias("v")).first().v == "ID"


def test_pipe_tables(spark):
    md = "x | y\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n3|4\n\n| c |\n|---|\n"
    got = rows(c.parse_pipe_tables(docs(spark, md), "text"), "table_index", "row_index")
    assert [(g["table_index"], g["headers"], g["cells"]) for g in got] == [(0, ["a", "b"], ["1", "2"]), (0, ["a", "b"], ["3", "4"])]


def test_heading_before_the_first(spark):
    headings = spark.createDataFrame([("d", 5, "H1"), ("d", 9, "H2")], "doc string, pos int, heading_path string")
    chunks = spark.createDataFrame([("d", 0), ("d", 5), ("d", 8), ("d", 20), ("e", 1)], "doc string, start int")
    got = rows(c.heading_at_offset(chunks, headings, "doc", "start", "pos"), "doc", "start")
    assert [g["heading_path"] for g in got] == ["H1", "H1", "H1", "H2", ""]


def test_heading_block_stops(spark):
    df = docs(spark, "# T\n## Model\nkeep\n### sub\nmore\n## Next\nno\n# Top")
    shown = [X.heading_block("text", "model", s).alias(s) for s in ("h1_h2", "h2", "end")]
    got = df.select(*shown, X.heading_block("text", "absent").alias("none")).first()
    assert got.h1_h2 == got.h2 == "keep\n### sub\nmore" and got.end.endswith("# Top") and got.none == ""


def test_ingest_is_repeatable(spark):
    first = docs(spark, "alpha", "beta", "gamma " * 400, "")
    store, manifest, status = i.incremental_ingest(first, empty_frame(spark, i.MANIFEST))
    assert {r.status for r in status.collect()} == {"new"}
    again = i.incremental_ingest(first, manifest, store)
    assert {r.status for r in again[2].collect()} == {"unchanged"}
    assert sorted(store.collect(), key=repr) == sorted(again[0].collect(), key=repr)
    shrunk = docs(spark, "alpha", "beta two", "gamma")
    store2, manifest2, status2 = i.incremental_ingest(shrunk, manifest, store, prune=True)
    assert {r.source_path: r.status for r in status2.collect()} == {
        "/d/0.md": "unchanged", "/d/1.md": "changed", "/d/2.md": "changed", "/d/3.md": "deleted",
    }
    assert store2.where("source_path = '/d/2.md'").count() == 1
    assert manifest2.select("source_path").distinct().count() == 3
    reset = i.incremental_ingest(shrunk, manifest, store, reset=True)
    assert {r.status for r in reset[2].collect()} == {"new"}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, store, check = (str(tmp_path / n) for n in ("src", "store", "check"))
    schema = "source_path string, text string"
    all_docs = docs(spark, *[f"text {n} " * (n * 60 + 1) for n in range(6)])
    all_docs.where("source_path < '/d/3'").coalesce(1).write.parquet(src)
    stream_ingest(spark, src, schema, store, check)
    stream_ingest(spark, src, schema, store, check)
    all_docs.where("source_path >= '/d/3'").coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("/d/0.md", "text replaced")], schema).coalesce(1).write.mode("append").parquet(src)
    stream_ingest(spark, src, schema, store, check)
    final = all_docs.withColumn("text", F.when(F.col("source_path") == "/d/0.md", "text replaced").otherwise(F.col("text")))
    batch, manifest, _ = i.incremental_ingest(final, empty_frame(spark, i.MANIFEST))
    key = ("id", "text", "chunk_index", "start_char")
    assert rows(current_chunks(spark, store).select(*key), "id") == rows(batch.select(*key), "id")
    assert current_manifest(spark, store).count() == manifest.count()


def test_nearest_with_copies_and_zero_vectors(spark):
    vectors = [[1.0, 0.0]] * 40 + [[0.0, 0.0]] * 3 + [[0.6, 0.8]] * 5 + [[-1.0, 0.0]]
    corpus = spark.createDataFrame(list(enumerate(vectors)), "id int, embedding array<float>").repartition(7)
    queries = spark.createDataFrame([("a", [2.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<float>")
    got = rows(t.vector_top_k(corpus, queries, 45), "query_id", "rank")
    mine = [(g["id"], round(g["distance"], 6)) for g in got if g["query_id"] == "a"]
    want = sorted(((n, round(1 - v[0] / math.hypot(*v) if any(v) else 1.0, 6)) for n, v in enumerate(vectors)), key=lambda x: (x[1], x[0]))
    assert mine == want[:45]
    assert [g["id"] for g in got if g["query_id"] == "z"] == list(range(45))


def test_several_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(t, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(t, "LEAST_ROWS", 3)
    corpus = spark.range(20).selectExpr("id", "array(cast(cos(id) as float), cast(sin(id) as float)) as embedding")
    queries = corpus.where("id < 5").withColumnRenamed("id", "query_id")
    got = rows(t.vector_top_k(corpus, queries, 1), "query_id")
    assert [(g["query_id"], g["id"]) for g in got] == [(n, n) for n in range(5)]


def test_blocks_that_cannot_hold_a_nearest_are_skipped(spark, monkeypatch):
    """Exact on clustered vectors, with far fewer pairs compared than there are."""
    monkeypatch.setattr(t, "LEAST_ROWS", 20)
    monkeypatch.setattr(t, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    vectors = np.repeat(centres, 150, axis=0) + 0.08 * rng.standard_normal((3000, 16))
    vectors[:200] = vectors[0]  # copies, more than a block holds
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, embedding array<double>").repartition(5)
    some = list(range(0, 3000, 60))
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in some], "query_id int, embedding array<double>")
    got = {}
    for r in t.vector_top_k(corpus, queries, 25).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i in some:
        far = np.round(1 - units @ units[i], 12)
        assert [x for _, x in sorted(got[i])] == np.lexsort((np.arange(3000), far))[:25].tolist()
    held = corpus.select("id", F.col("embedding").alias("v"), F.size("embedding").alias("width"))
    asked = queries.select(F.col("query_id").alias("q"), F.col("embedding").alias("v"), F.size("embedding").alias("width"))
    pivots = t._pivots(held, 3000)
    blocks = t._blocks(held, pivots)
    sizes = t._Sizes(blocks, pivots, 3000, 8)
    dealt = blocks.withColumn("part", F.pmod("deal", sizes.parts()).cast("int")).groupBy("width", "pivot", "part").count()
    compared = t.placed_queries(asked, sizes, 25).join(dealt, ["width", "pivot", "part"]).agg(F.sum("count")).first()[0]
    assert compared < 0.5 * len(some) * 3000


def test_vectors_of_several_widths(spark):
    """A query meets the vectors of its own width; null vectors and components take no part."""
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [0.0, 0.0, 2.0])]
    corpus = spark.createDataFrame(vectors, "id int, embedding array<float>")
    queries = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 0.0, 1.0]), ("c", [1.0])], "query_id string, embedding array<float>")
    got = rows(t.vector_top_k(corpus, queries, 9), "query_id", "rank")
    assert [(g["query_id"], g["id"]) for g in got] == [("a", 1), ("a", 3), ("b", 6), ("b", 2)]


def test_front_matter_lists(spark):
    md = "---\ntags:\n- alpha\n  - 'be ta'\nother: [x, \"y\", ]\nplain: v\ntags2: []\n---\n# T\nbody"
    front, body = c.front_matter("text")
    got = docs(spark, md).select(front.alias("f"), body.alias("b")).first()
    assert got.f == {"tags": '["alpha","be ta"]', "other": '["x","y"]', "plain": "v", "tags2": "[]"} and got.b == "# T\nbody"
    chunk = c.chunk_documents(docs(spark, md), "source_path", "text")
    assert t.local_filter(chunk, tags="be ta").count() == 1 and t.local_filter(chunk, tags="be").count() == 0
    loose = docs(spark, "---- title\nk: v\n---\nrest")
    assert loose.select(c.front_matter("text")[0].alias("f")).first().f == {}
    assert loose.select(c.front_matter("text", loose=True)[0].alias("f")).first().f == {"k": "v"}


def test_fuzzy_matches_brute_force(spark):
    left = ["System Name", "Port Lane", "Bus", "Rate ms", "identical", "", "zzz"]
    right = ["System_Name", "Port Lanes", "Bas", "Rate_ms", "identical", "Unrelated Column", "Bux", "a"]
    frames = [spark.createDataFrame([(s,) for s in side], "name string") for side in (left, right)]
    got = {r["name"]: r["match"] for r in rows(fuzzy_best_match(*frames, "name"))}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for x, ca in enumerate(a, 1):
            row, prev = [x], row
            for y, cb in enumerate(b, 1):
                row.append(min(prev[y] + 1, row[-1] + 1, prev[y - 1] + (ca != cb)))
        return row[-1]

    for name in left:
        scored = [(-(1 - lev(name, r) / max(len(name), len(r))), r) for r in right if name or r]
        best = min(scored)
        assert got[name] == (best[1] if -best[0] * 100 > 60 else "")


def test_local_filter_passes_missing_tags(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", None)], "id string, tags array<string>")
    assert [r["id"] for r in rows(t.local_filter(df, tags="x"), "id")] == ["a", "c"]
    texts = df.select("id", F.array_join("tags", ",").alias("tags"))
    assert [r["id"] for r in rows(t.local_filter(texts, tags="x"), "id")] == ["a", "c"]


@pytest.mark.parametrize("name, cleaned", [("System LOID LOID", "System LOID"), ("Name NAME", "Name"), ("a b A B", "a b"), ("x", "x"), ("X x y", "X y")])
def test_header_names(name, cleaned):
    assert flat.clean_header(name) == cleaned


def test_header_collision():
    with pytest.raises(ValueError, match="collide"):
        flat.clean_headers(["Name NAME", "Name"])


@pytest.mark.parametrize("header_row", [1, 3])
def test_read_flat(spark, tmp_path, header_row):
    path = tmp_path / "in.csv"
    body = "Name NAME,,Seq\na,1,x\nb,,\nName NAME,dup,row\nshort\n"
    path.write_text("pre\nName NAME,,Seq\n"[: None if header_row == 3 else 0] + body)
    df = flat.read_flat(spark, str(path), header_row)
    assert df.columns == ["Name", "col_2", "Seq"]
    assert sorted(str(r.Name) for r in df.collect()) == ["Name NAME", "a", "b", "short"]


@pytest.mark.parametrize("header_row", [1, 4])
def test_records_over_several_lines(spark, tmp_path, header_row):
    for i in range(3):
        top = "title\n\nmade by,me\n" if header_row == 4 else ""
        body = f'id,note\n{i}1,"line one\nline ""two"""\n{i}2\n{i}3,x,y,z\n'
        (tmp_path / f"{i}.csv").write_text(top + body)
    path = str(tmp_path / "*.csv")
    got = sorted(map(tuple, flat.read_flat(spark, path, header_row).collect()))
    want = [row for i in range(3) for row in ((f"{i}1", 'line one\nline "two"'), (f"{i}2", None), (f"{i}3", "x"))]
    assert got == want
    assert sorted(r.record.strip() for r in flat.surplus_rows(spark, path, header_row).collect()) == ["03,x,y,z", "13,x,y,z", "23,x,y,z"]


@pytest.mark.parametrize("header_row", [1, 3])
def test_read_flat_split_by_lines(spark, tmp_path, header_row):
    path = tmp_path / "in.csv"
    path.write_text("pre\nName,x\n"[: None if header_row == 3 else 0] + "Name,x\na,1\nb,2\n")
    assert sorted(map(tuple, flat.read_flat(spark, str(path), header_row, multi_line=False).collect())) == [("a", "1"), ("b", "2")]


def test_csv_quotes_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"', "a,b"), ("", None)], "q string, c string")
    sinks.export_csv(df, str(tmp_path / "out.csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out.csv").glob("part-*")))
    assert '"say ""hi""","a,b"' in text and '""' in text


FLAT = "n int, `System LOID LOID` string, `Phys LOID` string, `Output LOID` string, `WS LOID` string, `Param LOID` string, Seq int"
MAPPING = {
    "system": {"System_LOID": "System LOID"},
    "physport": {"PhysicalPort_LOID": "Phys LOID", "System_LOID": "System LOID"},
    "outputport": {"OutputPort_LOID": "Output LOID", "PhysicalPort_LOID": "Phys LOID"},
    "wordstring": {"Wordstring_LOID": "WS LOID", "OutputPort_LOID": "Output LOID"},
    "word": {"Wordstring_LOID": "WS LOID", "Word_Seq_Num": "Seq"},
    "parameter": {"Parameter_LOID": "Param LOID", "OutputPort_LOID": "Output LOID"},
}


def test_sparse_export(spark):
    df = spark.createDataFrame([(0, "S", "P", "O", "W", "A", 1), (1, "", None, " ", None, "B", 2), (2, None, None, None, None, "B", 3)], FLAT)
    done = normalize_tables(df, ["n"], MAPPING)
    assert {n: t.count() for n, t in done.tables.items()} == {
        "system": 1, "physport": 1, "outputport": 1, "wordstring": 1, "word": 3, "parameter": 2,
    }
    index = rows(hierarchy_index(done.tables))
    assert [(x["word_count"], x["parameter_count"]) for x in index] == [(3, 2)]
    named = {n: t.withColumn("Wordstring_Name", F.lit("w")).withColumn("Wordstring_Mnemonic", F.lit("m")).withColumn("Parameter_Name", F.lit("p")).withColumn("Parameter_Mnemonic", F.lit(None).cast("string")) for n, t in done.tables.items()}
    assert cascade_filter(named, physport="none")["word"].count() == 0
    assert cascade_filter(named, physport="none", outputport="O")["word"].count() == 3
    with pytest.raises(ValueError, match="missing required"):
        normalize_tables(df.drop("Seq"), ["n"], MAPPING)


def test_hierarchy_tables_are_found_without_a_join(spark):
    """First rows by one shuffle on the keys, also where keys repeat, are blank or come before any value."""
    mapping = {"system": {"System_LOID": "s", "System_Name": "t"}, "word": {"Wordstring_LOID": "w", "Word_Seq_Num": "q"}}
    data = [(1, "", "t0", " ", "1"), (2, "S1", "t1", "W1", "1"), (3, "", "", "", "2"), (4, "S2", "", "W1", "1"), (5, "S1", "t5", "W2", "")]
    done = normalize_tables(spark.createDataFrame(data, "n int, s string, t string, w string, q string"), ["n"], mapping)
    assert [tuple(r) for r in done.tables["system"].collect()] == [(None, "t0"), ("S1", "t1"), ("S2", "t1")]
    assert [tuple(r) for r in done.tables["word"].collect()] == [(None, "1"), ("W1", "1"), ("W1", "2"), ("W2", "1")]
    assert done.inferred == ["s", "t", "w", "q"]
    plan = done.tables["word"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_index_keeps_parameters_of_a_port_without_a_row(spark):
    tables = {
        "system": spark.createDataFrame([("S1", "s")], "System_LOID string, System_Name string"),
        "physport": spark.createDataFrame([("P1", "S1")], "PhysicalPort_LOID string, System_LOID string"),
        "outputport": spark.createDataFrame([("O1", "P1"), (None, "P1")], "OutputPort_LOID string, PhysicalPort_LOID string"),
        "wordstring": spark.createDataFrame([("W1", "O1"), ("W2", "O2"), ("W3", None)], "Wordstring_LOID string, OutputPort_LOID string"),
        "word": spark.createDataFrame([("W2", 1)], "Wordstring_LOID string, Word_Seq_Num int"),
        "parameter": spark.createDataFrame([("A", "O2"), ("B", "O2"), ("C", None)], "Parameter_LOID string, OutputPort_LOID string"),
    }
    got = {r["Wordstring_LOID"]: (r["System_Name"], r["word_count"], r["parameter_count"]) for r in hierarchy_index(tables).collect()}
    assert got == {"W1": ("s", 0, 0), "W2": (None, 1, 2), "W3": (None, 0, 0)}


def test_headings_scan_carries_no_digest_of_chunks(spark):
    """Chunks of one place are told apart by a number, not by 64 characters a row."""
    chunks = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 5, "z")], "doc string, start int, t string")
    headings = spark.createDataFrame([("a", 3, "H")], "doc string, pos int, heading_path string")
    done = c.heading_at_offset(chunks, headings, "doc", "start", "pos")
    assert [tuple(r) for r in done.orderBy("start", "t").collect()] == [("a", 1, "x", "H"), ("a", 5, "y", "H"), ("a", 5, "z", "H")]
    assert "sha2" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_documents_pass_to_python_a_few_hundred_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([("a.md", "# H\nbody")], "path string, md string")
    try:
        for asked, held in (("10000", "500"), ("0", "500"), ("7", "7")):
            spark.conf.set(key, asked)
            assert c.chunk_documents(docs, "path", "md").count() == 1
            assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, before)
