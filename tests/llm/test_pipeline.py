"""Each stage on its own input against the operator it stands for, and the whole run."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, messy, messy_rows, words
from tests.llm.test_jaccard_join import plain_components, plain_set, similar
from tests.llm.test_quality_rules import plain
from tracegrid.llm.quality_classifier import quality_scores
from tracegrid.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_return_documents(spark, tmp_path):
    for make in (messy, clashing, empty):
        path = str(tmp_path / make.__name__)
        make(spark).write.parquet(path)
        frame = spark.read.parquet(path)
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns and [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
            assert set(as_rows(out)) <= set(as_rows(frame))
        assert pipeline.pack_sequences(spark, frame, SF).count() >= (frame.count() > 0)


def test_quality_stages(spark, docs):
    kept = pipeline.by_quality_rules(spark, docs, SF)
    assert as_rows(kept) == as_rows(quality_rules(docs).where("kept").select(docs.columns))
    assert all(not (plain(r.text)["n_words"] < 50) for r in kept.collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality_scores(docs, labels).where("score >= 0.3").select("doc_id")
    assert as_rows(pipeline.by_quality_classifier(spark, docs, SF).select("doc_id")) == as_rows(good)


def test_one_of_each_group(spark, tmp_path):
    path = str(tmp_path / "d")
    messy(spark, 5).write.parquet(path)
    kept = pipeline.one_of_each_group(spark, spark.read.parquet(path), SF).collect()
    rows = messy_rows(5)
    sets = [plain_set(r.text) for r in kept]
    assert not any(similar(a, b) for i, a in enumerate(sets) for b in sets[:i])
    groups = {c for _, n, c in plain_components(rows) if n and c is not None}
    assert {r.doc_id for r, s in zip(kept, sets, strict=True) if s and r.doc_id is not None} == groups
    assert sum(not s for s in sets) == sum(not plain_set(r[1]) for r in rows)


def test_run(spark, docs):
    out = pipeline.run(spark, SF)
    pieces = out.collect()
    step = docs
    for _, stage in pipeline.STAGES[:-1]:
        step = pipeline.materialize(stage(spark, step, SF))
    left = step.collect()
    want, got = {}, {}
    for r in left:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(words(r.text))
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.n_words
    assert got == want and len(got) > 10
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert set(got) <= ids
    assert out.where(F.col("bin").isNull()).count() == 0


def test_mix_stage(spark, docs):
    """Sources come near their targets with whole documents."""
    mixed = pipeline.mix_to_weights(spark, docs, SF).collect()
    sizes, taken = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    from tests.llm.test_mixing import plain_targets

    target = plain_targets(sizes)
    largest = max(len(words(r.text)) for r in docs.collect())
    for s, t in target.items():
        assert abs(taken.get(s, 0) - t) <= largest / 2 + 2


def test_classifier_stage_without_bad_labels(spark, docs, tmp_path):
    """Bad documents go even where none of those that reach the stage is labelled as bad."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = docs.join(labels.where("quality = 0"), "doc_id").select(docs.columns)
    good = docs.join(labels.where("quality = 1"), "doc_id").select(docs.columns)
    path = str(tmp_path / "d")
    bad.withColumn("doc_id", F.col("doc_id") + 10**9).unionByName(good).write.parquet(path)
    kept = {r.doc_id for r in pipeline.by_quality_classifier(spark, spark.read.parquet(path), SF).select("doc_id").collect()}
    left = sum(i >= 10**9 for i in kept)
    assert bad.count() >= 10 and left <= 0.2 * bad.count() and len(kept) - left >= 0.8 * good.count()


def test_groups_do_not_depend_on_splits(spark, tmp_path):
    """Files may be dealt to tasks in another way between finding copies and removing them."""
    path = str(tmp_path / "d")
    messy(spark, 5).repartition(12).write.parquet(path)
    kept = as_rows(pipeline.one_of_each_group(spark, spark.read.parquet(path), SF))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")
        stage = pipeline.one_of_each_group(spark, spark.read.parquet(path), SF)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert as_rows(stage) == kept
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert as_rows(pipeline.one_of_each_group(spark, messy(spark, 5), SF)) == kept
