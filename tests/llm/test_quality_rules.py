import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, messy, messy_rows, words
from tracegrid.llm.quality_rules import COUNTS, document_counts, quality_rules


def plain(text):
    text = text or ""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_lines": len(lines),
    }


def test_counts(spark):
    rows = document_counts(messy(spark)).select("text", *COUNTS).collect()
    assert len(rows) == len(messy_rows())
    for r in rows:
        assert {c: r[c] for c in COUNTS} == plain(r["text"]), r["text"]


def test_verdicts_follow_groups(spark):
    """A share of symbols that is usual in one source is an outlier in another."""
    clean = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}**" for i in range(80))
    rows = [(i, marked if i % 2 else clean, "en", "math" if i % 2 else "prose", 0) for i in range(600)]
    rows += [(1001, marked, "en", "prose", 0), (1000, "short", "en", "prose", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(found) == 602
    assert all(found[i].kept for i in range(600))
    assert not found[1001].kept and not found[1001].base_failed
    assert found[1000].base_failed and not found[1000].kept


def test_edges(spark):
    assert quality_rules(empty(spark)).count() == 0
    out = quality_rules(clashing(spark))
    assert [c for c in out.columns if c in ("n.words", "size", "score")] == ["size", "score", "n.words"]
    rows = out.select("text", "base_failed", "kept").collect()
    assert len(rows) == len(messy_rows(1, 60))
    for r in rows:
        c = plain(r.text)
        assert r.base_failed == (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"])
        assert not (r.base_failed and r.kept)


def test_native(spark):
    plan = quality_rules(messy(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    kept = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), carry=["doc_id", "lang", "source"])
    seen = kept.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    counts = {(r.quality, r.kept): r["count"] for r in seen.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[(1, True)]
    assert counts.get((0, True), 0) <= 0.1 * counts[(0, False)]


def test_no_step_and_the_sql_form(spark):
    """Fences move little from 199 to 201 documents of a group, and are those of the SQL form."""
    import duckdb

    from tracegrid.llm.quality_rules import fences
    from tracegrid.llm.sql import QUALITY_RULES

    rows = []
    for size in (3, 199, 200, 201):
        for i in range(size):
            marks = "*" * (i % 7) if i % 5 else ""
            rows.append((len(rows), " ".join(f"word{(i * 7 + k) % 911}{marks}" for k in range(60 + i % 9)), "en", f"g{size}", 0))
    rows += [(len(rows) + i, " ".join(f"mot{i + k}" for k in range(70)), "fr", "g3", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    limits = {(r["__lang"], r["__source"]): r for r in fences(document_counts(docs)).collect()}
    for name in ("__max_symbol_share", "__max_word_length", "__min_word_length"):
        a, b, c = (limits["en", f"g{n}"][name] for n in (199, 200, 201))
        assert abs(a - b) < 0.02 * abs(b) + 1e-9 and abs(c - b) < 0.02 * abs(b) + 1e-9
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cursor = con.execute(QUALITY_RULES)
    names = [d[0] for d in cursor.description]
    want = {r[0]: dict(zip(names, r)) for r in cursor.fetchall()}
    for r in quality_rules(docs).collect():
        assert (r.base_failed, r.kept) == (want[r.doc_id]["base_failed"], want[r.doc_id]["kept"])
