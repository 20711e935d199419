"""The stream's store over many batches."""

import pytest

from tracegrid.streaming import ingest as s

SCHEMA = "source_path string, text string, file_time timestamp, file_path string"


def batch(spark, texts):
    rows = [(p, t) for p, t in texts.items()]
    return spark.createDataFrame(rows, "source_path string, text string").selectExpr("source_path", "text", "timestamp'2026-01-01' as file_time", "'f' as file_path")


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(s, "BUCKETS", 4)


def test_later_batches_read_no_more_files(spark, tmp_path, few_buckets):
    """The same documents in every batch: from the first compaction on the same number of files."""
    store = str(tmp_path)
    read = {}
    want = {}
    for b in range(8):
        texts = {f"/d/{i}": f"text {i} of batch {b if i % 2 else 0}" for i in range(8)}
        paths = batch(spark, texts).select("source_path")
        s.compact_manifest(spark, store, b, 2)
        found = s.manifest_files(spark, store, b, paths)
        read[b] = len(found.inputFiles()) if found is not None else 0
        s.ingest_batch(batch(spark, texts), b, store, compact_every=2)
        want |= texts
    assert read[3] == read[5] == read[7] > 0
    assert max(read.values()) <= max(read[b] for b in range(4))
    assert {r.source_path: r.text for r in s.current_chunks(spark, store).collect()} == want


def test_a_replayed_batch_changes_nothing(spark, tmp_path, few_buckets):
    """Also where it compacts, and where later batches have compacted it."""
    store = str(tmp_path)
    texts = [{f"/d/{i}": f"text {i}, {b}" for i in range(b, b + 4)} for b in range(5)]
    for b, own in enumerate(texts):
        s.ingest_batch(batch(spark, own), b, store, compact_every=2)
    rows = lambda: sorted(map(tuple, s.current_manifest(spark, store).collect()))
    before = rows()
    assert len({r[0] for r in before}) == 8
    for b in (4, 2):
        s.ingest_batch(batch(spark, texts[b]), b, store, compact_every=2)
        assert rows() == before


def test_a_failed_compaction_is_not_seen(spark, tmp_path, few_buckets, monkeypatch):
    store = str(tmp_path)
    for b in range(3):
        s.ingest_batch(batch(spark, {"/d/1": f"text {b}", f"/d/x{b}": "x"}), b, store, compact_every=99)
    before = sorted(map(tuple, s.current_manifest(spark, store).collect()))
    rows = s.current_manifest(spark, store, 3).withColumn("b", s._bucket()).limit(1)
    rows.write.partitionBy("b").parquet(f"{store}/base/upto=2")  # written in part, and no state
    assert sorted(map(tuple, s.current_manifest(spark, store).collect())) == before
    assert s.compact_manifest(spark, store, 3, 2)
    assert sorted(map(tuple, s.current_manifest(spark, store).collect())) == before


def test_batches_without_documents(spark, tmp_path):
    store = str(tmp_path)
    assert s.current_manifest(spark, store).count() == 0
    s.ingest_batch(batch(spark, {"/a": "one"}), 0, store, compact_every=2)
    s.ingest_batch(batch(spark, {"/a": "two"}), 5, store, compact_every=2)  # 1 to 4 brought nothing
    s.ingest_batch(batch(spark, {"/b": "three"}), 6, store, compact_every=2)
    assert {r.source_path: r.text for r in s.current_chunks(spark, store).collect()} == {"/a": "two", "/b": "three"}
