import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, messy, messy_rows
from tracegrid.llm.fill_in_middle import fill_in_middle, restored

ODD = ["a\nb\n\nc", "\n", "\n\n\n", "no end", "with <S> mark\nb", "$1 \\ \\Q \\E\n$2<\nP><", "<\n<P\nS>\n", "\r\n\x85 \nx", "🦆\n日本\n"]


def brute(doc_id, text, seed=7, rearranged=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rearranged:
        return n, "plain", text, None, None
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rearranged": 40, "suffix_first": 0}, {"suffix_first": 100}])
def test_equals_brute_force(spark, options):
    rows = [*messy_rows(), *((1000 + 100 * k + i, t, "en", "s", 1) for k in range(6) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame(rows, messy(spark).schema)
    formed = fill_in_middle(docs, **options).withColumn("back", restored(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.back) for r in formed.collect()]
    want = [(r[0], *brute(r[0], r[1], **options), r[1] or "") for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rows_and_clashing_names(spark):
    assert fill_in_middle(empty(spark)).count() == 0
    docs = clashing(spark).withColumn("form", F.lit(1)).withColumn("n", F.lit("n"))
    out = fill_in_middle(docs)
    assert set(out.columns) == set(docs.columns) | {"output", "prefix_chars", "middle_chars"}
    assert sorted(map(repr, out.select("doc_id", "n", "form", "output").collect())) == sorted(
        map(repr, fill_in_middle(messy(spark, 1, 60)).select("doc_id", "n", "form", "output").collect())
    )


def test_very_long_texts(spark):
    """Neither very many lines nor a very long one exhausts the matcher's stack."""
    texts = [("a\n" * 300_000,), ("x" * 1_000_000,), ("\n" * 300_000,), ("<" * 300_000 + "\nb",)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id int, text string")
    formed = fill_in_middle(docs)
    same = formed.select((restored(F.col("output"), F.col("form")) == F.col("text")).alias("ok"), "form", "n").collect()
    assert all(r.ok and r.form != "plain" for r in same)
    assert sorted(r.n for r in same) == [1, 2, 300_000, 300_000]


def test_one_pass_without_a_shuffle(spark, capsys):
    fill_in_middle(messy(spark)).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_other_units_and_marks(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour ") for i in range(40)], "doc_id int, text string")
    marks = ("[p$]", "[s]", "[m\\]")
    formed = fill_in_middle(docs, unit=r"\S++\s*+|\s++", marks=marks).collect()
    assert {r.n for r in formed} == {4}
    for r in formed:
        parts = re.split(r"\[p\$\]|\[s\]|\[m\\\]", r.output)
        p, s, m = (parts[1], parts[2], parts[3]) if r.form == "psm" else (parts[2], parts[1], parts[3])
        assert p + m + s == "one two  three\nfour " and (len(p), len(m)) == (r.prefix_chars, r.middle_chars)
    with pytest.raises(ValueError):
        fill_in_middle(docs, marks=("<P>", "<<S>", "<M>"))
