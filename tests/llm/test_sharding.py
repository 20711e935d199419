import zlib

from tests.llm.helpers import DOCS, clashing, empty, messy, messy_rows
from tracegrid.llm.sharding import shard_by_bytes, write_shards


def check(rows, texts, shards=16):
    assert len(rows) == len(texts)
    want = [(i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in texts]
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(map(str, want))
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(shards):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= largest
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)


def test_sharding(spark):
    check(shard_by_bytes(messy(spark)).collect(), [(r[0], r[1]) for r in messy_rows()])
    check(shard_by_bytes(clashing(spark)).collect(), [(r[0], r[1]) for r in messy_rows(1, 60)])


def test_one_id_for_a_third_of_the_rows(spark):
    rows = [(7 if i % 3 == 0 else i, "same text" if i % 3 == 0 else f"text {i}", "en", "s", 1) for i in range(900)]
    check(shard_by_bytes(spark.createDataFrame(rows, DOCS)).collect(), [(r[0], r[1]) for r in rows])


def test_edges(spark, tmp_path):
    assert shard_by_bytes(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert [tuple(r)[1:3] for r in shard_by_bytes(one).collect()] == [(1, None)]
    docs = spark.createDataFrame([(i, "x" * (i % 50), "en", "s", 1) for i in range(200)], DOCS)
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 16
    assert back.drop("shard", "slot").exceptAll(docs).count() == 0
