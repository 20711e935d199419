import heapq
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, messy, messy_rows, words
from tracegrid.llm.mixing import block_quotas, mix, source_targets, taken


def plain_targets(sizes):
    """Share by weight; sources over their cap stop and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: Fraction(3 * sizes[s]) for s in over}
        open_ -= over
    return target


def awards(targets, caps, seats):
    """Sainte-Lague one seat at a time."""
    heap = [(-Fraction(t), i, 1) for i, t in enumerate(targets) if t > 0]
    heapq.heapify(heap)
    got = [0] * len(targets)
    for _ in range(seats):
        while heap and got[heap[0][1]] >= caps[heap[0][1]]:
            heapq.heappop(heap)
        if not heap:
            break
        _, i, k = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-Fraction(targets[i]) / (2 * k + 1), i, k + 1))
    return got


@pytest.mark.parametrize("sizes", [[10, 500, 3, 80, 0, 41, 1000], [7], [1, 1, 1, 5000], [333] * 9, [0, 0], [40_000, 39_000, 41_000, 2, 1, 3, 30], [90_000] + [1] * 30])
def test_targets_and_quotas(spark, sizes):
    names = {f"s{i:02}": n for i, n in enumerate(sizes)}
    frame = spark.createDataFrame(list(names.items()), "source string, size bigint")
    targets = {r.source: r for r in source_targets(frame).collect()}
    want = plain_targets(names)
    for s, r in targets.items():
        assert r.target == pytest.approx(float(want[s])), s
    blocks, shards = 60, 4
    quotas = {r.source: r for r in block_quotas(source_targets(frame), blocks, shards).collect()}
    total = sum(sizes)
    block = max(1, total // blocks)
    most = [math.ceil(targets[s].target / block) for s in names]
    quota = [min(3 * n, math.floor(targets[s].target + 0.5)) for s, n in names.items()]
    for k in range(1, shards + 1):
        got = awards([targets[s].target for s in names], most, sum(most) * k // shards)
        assert [quotas[s].ends[k - 1] for s in names] == [min(g * block, q) for g, q in zip(got, quota)]
    assert [quotas[s].ends[-1] for s in names] == quota


def check_taken(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    for own in by_source.values():
        words_taken = sum(r.taken for r in own)
        assert abs(words_taken - own[0].target) <= 0.5 + 1e-6 * own[0].target
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert {r.source_size for r in own} == {sum(r.size for r in own)}


def test_mix(spark):
    docs = messy(spark)
    out = mix(docs).withColumn("taken", taken("draws")).select("doc_id", "text", "source", "size", "source_size", "target", "taken")
    rows = out.collect()
    assert len(rows) == len(messy_rows())
    assert all(r.size == len(words(r.text)) for r in rows)
    check_taken(rows)
    again = mix(docs.repartition(5)).withColumn("taken", taken("draws")).select(out.columns).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    want = plain_targets({r.source: r.source_size for r in rows})
    for r in rows:
        assert r.target == pytest.approx(float(want[r.source]))


def test_draws_fill_shards(spark):
    """Each shard's words of a source follow its quota to within a document."""
    rows = mix(messy(spark), shards=4).select("source", "size", "target", F.explode("draws").alias("d")).collect()
    largest = max(r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        for shard in range(4):
            got = sum(r.d["words"] for r in own if r.d["shard"] == shard)
            assert abs(got - own[0].target / 4) <= largest + 2


def test_edges(spark):
    assert mix(empty(spark)).count() == 0
    out = mix(clashing(spark))
    assert "n.words" in out.columns and out.count() == len(messy_rows(1, 60))
    plan = mix(messy(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_the_sql_form_with_a_tiny_source(spark):
    """The registered SQL, on a table with a source of thirty words beside large ones."""
    import duckdb

    from tracegrid.llm.sql import MIX_SOURCES

    rows = [(i, "w " * (200 + i % 50), f"s{i % 3}") for i in range(900)] + [(1000 + i, "x " * 10, "tiny") for i in range(3)] + [(2000, "y " * 7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: tuple(r) for r in con.execute(MIX_SOURCES).fetchall()}
    got = mix(docs).select("doc_id", "size", "source_size", "target", taken("draws").alias("taken")).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.size, r.source_size, r.taken) == (want[r.doc_id][1], want[r.doc_id][2], want[r.doc_id][4])
    assert sum(r.taken for r in got if r.doc_id in (1000, 1001, 1002)) == 90


def test_small_sources_beside_a_huge_one(spark):
    """Each source comes within a word of its target, however large the corpus."""
    rows = [(i, "huge", 5_000_000) for i in range(1000)] + [(i, "large", 300_000) for i in range(1000, 1010)]
    for s, size in enumerate([1, 2, 70, 900, 4000, 24_000, 26_000, 99_999]):
        rows += [(2000 + 10 * s + k, f"tiny{s}", size // 2 + k * (size % 2)) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, words bigint")
    mixed = mix(docs, text_col=None, size_col="words").withColumn("taken", taken("draws"))
    found = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    assert {r.source for r in found} == set(want)
    for r in found:
        assert r.target == pytest.approx(float(want[r.source]))
        assert abs(r.taken - r.target) <= 1 + 1e-9 * r.target, r
