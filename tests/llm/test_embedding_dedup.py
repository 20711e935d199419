import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import embedding_dedup as e
from tracegrid.llm.embedding_dedup import Plan, calibrated_count, links_between, near_duplicate_vectors, same_strip, units, within

KIND = "vec_id bigint, embedding array<double>, label int"


def brute(rows, cosine=0.9):
    """(id, links, component, kept) of each row; and the links whose cosine is the threshold but for rounding."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v) / max(map(abs, v)) if k else None for (_, v), k in zip(rows, ok)]
    unit = [u / math.sqrt(float(u @ u)) if u is not None else None for u in unit]
    n = len(rows)
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return out


def crowd(seed, n=400, width=16):
    """Strays, groups of near copies of several sizes, chains, exact copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    vectors = [unit(rng.standard_normal(width)) for _ in range(n)]
    for size in (2, 5, 40):
        base = unit(rng.standard_normal(width))
        vectors += [base * rng.uniform(0.1, 9) + rng.standard_normal(width) * 0.02 for _ in range(size)]
    here = unit(rng.standard_normal(width))
    for _ in range(12):  # a chain: neighbours are near, its ends are not
        vectors.append(here)
        here = unit(here + 0.35 * unit(rng.standard_normal(width)))
    vectors += [vectors[0]] * 30 + [vectors[n]] * 7
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * width, [math.nan] + [1.0] * (width - 1), [math.inf] + [1.0] * (width - 1), [None] + [1.0] * (width - 1)]
    rows += [(10_000 + i, v) for i, v in enumerate(odd)]
    rows += [(20_000, [1.0, 2.0]), (20_001, [1.0, 2.1]), (20_002, [1e300, 2e300]), (20_003, [1e-320, 2e-320]), (None, [-1.0, 3.0]), (None, [3.0, 1.0]), (20_004, [3.0, 1.1])]
    rows += rows[5:8]
    rng.shuffle(rows)
    return rows


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 0) for r in rows], KIND).repartition(3)
    out = near_duplicate_vectors(frame, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_cell_equals_brute_force(spark, seed):
    """Copies, near copies, chains, ties and rows that take no part."""
    rows = crowd(seed)
    assert found(spark, rows) == sorted(brute(rows), key=repr)


def test_many_cells_and_parts(spark):
    """Small cells: several tables and cells in parts; nothing counted twice, recall as promised."""
    rows = crowd(3, 900)
    want = {repr(w[0]): w for w in brute(rows) if w[0] is not None}
    got = found(spark, rows, cell=64)
    assert Plan(len(rows), 0.9, 64).lead > 2
    over = [g for g in got if g[0] is not None and g[1] > want[repr(g[0])][1]]
    assert not over
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in brute(rows))


def test_large_cell_in_parts_is_exact(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.01 * rng.standard_normal(8)).tolist()) for i in range(300)]
    got = found(spark, rows, cell=50)
    assert {g[1:3] for g in got} == {(299, 0)}


def test_recall_at_the_threshold():
    """Pairs at the threshold itself, measured against what the plan promises."""
    rng = np.random.default_rng(5)
    a = units(rng.standard_normal((4000, 64)))
    b = units(rng.standard_normal((4000, 64)))
    b = units(b - (a * b).sum(1, keepdims=True) * a)
    cosine = 0.9
    near = cosine * 1.000001 * a + math.sqrt(1 - (cosine * 1.000001) ** 2) * b
    plan = Plan(1_000_000, cosine)
    share = (plan.cells(a) == plan.cells(near)).any(axis=1)
    assert plan.lead >= 3 and plan.tables >= 3
    # Tables lean on the same vectors, so allow for a little dependence.
    assert share.mean() > e.CELL_RECALL - 0.02
    directions = plan.directions(64, True)
    counted = (np.abs(a @ directions - near @ directions) <= e.WINDOW * plan.apart).sum(1)
    assert (counted >= plan.least).mean() > e.COUNT_RECALL - 0.004
    far = (np.abs(a @ directions - b @ directions) <= e.WINDOW * plan.apart).sum(1)
    assert (far >= plan.least).mean() < 1e-3


def test_links_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    vectors = units(np.repeat(rng.standard_normal((60, 32)), 6, axis=0) + 0.1 * rng.standard_normal((360, 32)))
    plan = Plan(360, 0.9)
    got = {(int(x), int(y)) for i, j in links_between(vectors, None, plan, 0.9) for x, y in zip(i, j)}
    near = vectors @ vectors.T
    want = {(i, j) for i in range(360) for j in range(i + 1, 360) if near[i, j] >= 0.9}
    assert got == want
    cross = {(int(x), int(y)) for i, j in links_between(vectors[:100], vectors[100:], plan, 0.9) for x, y in zip(i, j)}
    assert cross == {(i, j - 100) for i, j in want if i < 100 <= j}


def test_calibration():
    rng = np.random.default_rng(7)
    assert abs(within(1.5) - (np.abs(rng.standard_normal(400_000)) < 1.5).mean()) < 0.003
    start = rng.random(400_000) * 2
    moved = start + rng.standard_normal(400_000)
    assert abs(same_strip(2) - ((moved >= 0) & (moved < 2)).mean()) < 0.003
    tries = (rng.random((100_000, 48)) < 0.8).sum(1)
    least = calibrated_count(48, 0.8, 0.99)
    assert (tries >= least).mean() >= 0.988 and (tries >= least + 1).mean() < 0.99


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert near_duplicate_vectors(none).count() == 0
    floats = spark.createDataFrame([(1, [1.0, 2.0], 3), (2, [2.0, 4.0], 3)], "vec_id int, embedding array<float>, kept int")
    got = near_duplicate_vectors(floats.withColumn("n_links", F.lit("x"))).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False)]
