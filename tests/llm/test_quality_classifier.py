import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, messy, messy_rows, messy_texts
from tracegrid.llm.quality_classifier import TEMPERATURE, THRESHOLD, TO_IDENTITY, TO_POOLED, fit, quality_scores
from tracegrid.llm.text_stats import FEATURES, text_features

SF = "/root/testdata/sf0.01"


def test_features_do_not_depend_on_neighbours():
    texts = messy_texts(7)
    together = text_features(pa.array(texts))
    alone = np.concatenate([text_features(pa.array([t], pa.string())) for t in texts])
    assert together.shape == (len(texts), len(FEATURES))
    assert np.isfinite(together).all()
    assert np.allclose(together, alone)


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    n = len(FEATURES)
    x = [rng.normal(0, 1, (60, n)) @ rng.normal(0, 1, (n, n)) + y for y in (0, 1)]
    rows = [(y, [float(v) for v in r]) for y in (0, 1) for r in x[y]]
    model = fit(spark.createDataFrame(rows, "y int, f array<double>"), "y", "f")
    cov = [np.cov(a.T, bias=True) for a in x]
    pooled = (cov[0] + cov[1]) / 2
    scale = np.sqrt(np.diag(pooled))
    test = rng.normal(0, 1, (20, n))
    density = []
    for y in (0, 1):
        s = ((1 - TO_POOLED) * cov[y] + TO_POOLED * pooled) / np.outer(scale, scale)
        s = (1 - TO_IDENTITY) * s + TO_IDENTITY * np.eye(n) * np.trace(s) / n
        d = (test - x[y].mean(axis=0)) / scale
        density.append(np.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -40, 40)))
    assert model.score(test) == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) >= 0.95
    # What labels say of held-out rows changes no score.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_scores(docs, turned).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)


def test_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, quality int")
    rows = quality_scores(messy(spark), labels).collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(empty(spark), labels).count() == 0
    assert {r.score for r in quality_scores(messy(spark), labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_scores(messy(spark), labels.where("quality = 1")).collect()} == {1.0}
    named = quality_scores(clashing(spark), labels, carry=["n.words", "kept", "id"])
    assert named.columns == ["doc_id", "n.words", "kept", "id", "held_out", "score", "predicted"]
    assert named.count() == len(messy_rows(1, 60))


def test_few_rows_of_a_class(spark):
    """From one row of each class on the model tells classes apart; more rows change it little by little."""
    rng = np.random.default_rng(5)
    n = len(FEATURES)
    test = [rng.normal(3 * y, 1, (200, n)) for y in (0, 1)]
    for bad, good in ((1, 1), (1, 500), (n - 1, 500), (n, 500), (n + 1, 500), (6, 6)):
        rows = [(y, [float(v) for v in r]) for y, k in ((0, bad), (1, good)) for r in rng.normal(3 * y, 1, (k, n))]
        model = fit(spark.createDataFrame(rows, "y int, f array<double>"), "y", "f")
        right = [(model.score(test[y]) >= THRESHOLD) == bool(y) for y in (0, 1)]
        assert min(r.mean() for r in right) >= 0.9, (bad, good)
