"""Packages whose metadata and body are taken from one reading of a text."""

import hashlib

from conftest import rows
from pyspark.sql import functions as F

from tracegrid.operators import chunks, packaging


def test_front_matter_parts(spark):
    texts = ["---\nk: v\n---\nbody\n", "--- x\nk: v\n ---\t\n\n\n", "---\nk: v\nopen\n", "plain\n", "", None, "---\n---", "---\nk: [a, b]\n---"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    front, body = chunks.front_matter("t", loose=True)
    got = rows(df.select("id", front.alias("front"), body.alias("body")), "id")
    assert [(r["front"], r["body"]) for r in got] == [
        ({"k": "v"}, "body"), ({"k": "v"}, "\n"), ({}, "---\nk: v\nopen\n"), ({}, "plain\n"), ({}, ""), ({}, ""), ({}, ""),
        ({"k": '["a","b"]'}, ""),
    ]
    front, body = chunks.front_matter("t")
    assert df.where("id = 1").select(front.alias("f"), body.alias("b")).first() == ({}, texts[1])


def test_both_packages_from_one_pass(spark):
    lines = "---\n" + "no end\n" * 3000
    df = spark.createDataFrame([("/d/1.md", "---\ntitle: T\n---\nText\n"), ("/d/2.md", lines)], "path string, md string")
    done = packaging.package_documents(df, "path", "md", packaging.PackageRule(companion=True))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    got = {(r["path"], r["kind"]): r for r in rows(done)}
    first, brief = got["/d/1.md", "document"], got["/d/1.md", "summary"]
    assert first["text"].split("\n\n")[1:3] == ["## Content", "Text"] and brief["metadata"]["title"] == "T (summary)"
    assert brief["text"].endswith("Excerpt:\n" + first["text"]) and first["metadata"]["source"] == "/d/1.md"
    assert brief["original_sha256"] == brief["packaged_sha256"] == hashlib.sha256(brief["text"].encode()).hexdigest()
    assert "## Content\n\n" + lines + "\n\n" in got["/d/2.md", "document"]["text"] and len(got) == 4
    assert packaging.package_documents(df, "path", "md").where(F.col("kind") == "document").count() == 2
