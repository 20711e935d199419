import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import bit_sliced
from tracegrid.llm.bit_sliced import Slices, top_k

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k, every):
    kept = [
        (r[0], [math.floor(64 * float(np.float32(x))) for x in r[1]])
        for r in rows
        if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    out = set()
    for q, v in kept:
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in kept if i != q and len(w) == len(v)]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def rows_of(n, width, seed, ties=False):
    rng = np.random.default_rng(seed)
    values = rng.integers(-1, 2, (n, width)) / 16 if ties else rng.normal(0, 0.3, (n, width))
    return [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(values)]


@pytest.mark.parametrize("ties", [False, True])
def test_brute_force(spark, monkeypatch, ties):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 70)
    rows = rows_of(300, 9, 3, ties)
    got = top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, 7).collect()
    assert {tuple(r) for r in got} == plain(rows, 7, 5)
    assert len(got) == 60 * 7


def test_edges(spark):
    rows = rows_of(40, 4, 1) + [
        (100, None, 0), (105, [], 0), (110, [1.0, None, 2.0, 0.0], 0), (115, [float("nan"), 0.0, 0.0, 0.0], 0),
        (120, [float("inf"), 0.0, 0.0, 0.0], 0), (125, [0.5, 0.5], 0), (130, [1e3, -1e3, 0.0, 7.0], 0), (126, [0.25, 1.0], 0),
        (None, [1.0, 1.0, 1.0, 1.0], 0),
    ]
    docs = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("rank", F.lit(None))
    got = top_k(docs, F.col("vec_id") % 5 == 0, 60)
    assert {tuple(r) for r in got.collect()} == plain([r for r in rows if r[0] != 105], 60, 5)
    assert top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0


def test_large_components(spark):
    """Exact far beyond any usual component; refused where 64 bits would not do."""
    rows = [(0, [1.0, 0.0], 0), (1, [300_000.0, 0.0], 0), (2, [270_000.0, 0.0], 0), (3, [-1.5e7, 2e7], 0), (5, [2e7, 1.9e7], 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = {tuple(r) for r in top_k(frame, F.col("vec_id") % 5 == 0, 4).collect()}
    assert got == plain(rows, 4, 5)
    assert (0, 2, 1, 1_228_800_000) in got and (0, 3, 2, 1_105_920_000) in got
    with pytest.raises(ValueError, match="64 bits"):
        top_k(spark.createDataFrame([*rows, (6, [3e38, 1.0], 0)], VECTORS), F.col("vec_id") == 0)


def test_rows_move_once(spark, monkeypatch):
    """Every row is dealt to one block; only queries are copied."""
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 50)
    found = top_k(spark.createDataFrame(rows_of(400, 4, 7), VECTORS), F.col("vec_id") % 20 == 0, 3)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("explode(") > 0 and "FlatMapCoGroups" not in plan
    assert {tuple(r) for r in found.collect()} == plain(rows_of(400, 4, 7), 3, 20)


def test_repeated_rows(spark):
    """Rows of a query's own id are no candidates; other repeated rows count one by one."""
    rows = rows_of(12, 3, 2) + [(11, rows_of(12, 3, 2)[11][1], 0)] * 30
    got = top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, 50).collect()
    assert sum(r.vec_id == 11 for r in got) == 31 and len(got) == 41


def test_slices_add_up():
    rng = np.random.default_rng(9)
    rows = rng.integers(-50, 50, (130, 6))
    index = Slices(rows)
    for query in rng.integers(-40, 40, (5, 6)):
        score = index.score(query)
        bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little", count=130) for s in score])
        total = (bits.astype(np.int64) << np.arange(len(score))[:, None]).sum(axis=0)
        want = rows @ query
        assert (total - total[0] == want - want[0]).all()
