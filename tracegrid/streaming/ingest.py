"""Files of documents as a stream into a versioned chunk store.

Each micro-batch writes only what it changed, under its batch number: the
chunks of new and changed documents and their manifest rows. The state of a
document is its newest version, so a batch costs what it brings, and a batch
that is replayed overwrites its own folder.

The manifest of many batches is compacted: after every few batches the newest row
versions of the paths they touched go into buckets by path hash. A batch reads the
buckets of its own paths and the few batches since, by their folder names, however
many batches there have been:

    manifest/v=<batch>             what a batch wrote
    base/upto=<batch>/b=<bucket>   the newest rows of a bucket up to a batch
    state/upto=<batch>             the folder of each bucket as of then, written last

A batch compacts what lies before it, so a replayed one does the same again, and
looks only at states before itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegrid.operators.chunks import DEFAULT_RULES
from tracegrid.operators.ingest import MANIFEST, manifest_rows, plan_ingest, stored_chunks
from tracegrid.operators.storage import empty_frame, materialize


# Buckets of the compacted manifest, and batches between compactions.
BUCKETS = 64
COMPACT_EVERY = 16


def _versions(spark: SparkSession, store: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{store}/{kind}")
    except AnalysisException:
        return None  # nothing written yet


def _read(spark: SparkSession, store: str, folders: list[str]) -> DataFrame | None:
    """The folders that are there, with their partition columns but without a listing of the others."""
    found = []
    for folder in folders:
        try:
            spark.read.parquet(f"{store}/{folder}")
        except AnalysisException:
            continue  # a batch without documents
        found.append(f"{store}/{folder}")
    return spark.read.option("basePath", f"{store}/{folders[0].split('/')[0]}").parquet(*found) if found else None


def _bucket(path: str = "source_path") -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _state(spark: SparkSession, store: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """Up to which batch the manifest is compacted, and the folder of each bucket (one row per bucket)."""
    states = _versions(spark, store, "state")
    if states is None:
        return -1, {}
    states = states.withColumn("upto", F.col("upto").cast("long"))
    upto = states.where(F.col("upto") < before if before is not None else F.lit(True)).agg(F.max("upto")).first()[0]
    if upto is None:
        return -1, {}
    return upto, {r.bucket: r.folder for r in states.where(F.col("upto") == upto).collect()}


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("source_path").agg(F.max("v").alias("v"))
    return rows.join(newest, ["source_path", "v"], "left_semi")


def _last_batch(spark: SparkSession, store: str) -> int:
    rows = _versions(spark, store, "manifest")
    last = rows.agg(F.max(F.col("v").cast("long"))).first()[0] if rows is not None else None
    return -1 if last is None else last


def manifest_files(
    spark: SparkSession, store: str, before: int | None = None, paths: DataFrame | None = None
) -> DataFrame | None:
    """Manifest rows that may hold the newest version of some paths (all, if none are given), from as few files as may be."""
    before = _last_batch(spark, store) + 1 if before is None else before
    upto, folders = _state(spark, store, before)
    wanted = folders if paths is None else {r.b for r in paths.select(_bucket().alias("b")).distinct().collect()}
    base = [f"base/upto={folders[b]}/b={b}" for b in sorted(wanted) if b in folders]
    since = [f"manifest/v={v}" for v in range(upto + 1, before)]
    frames = [f for f in (_read(spark, store, base) if base else None, _read(spark, store, since) if since else None) if f is not None]
    columns = [*[f.split()[0] for f in MANIFEST.split(", ")], F.col("v").cast("long").alias("v")]
    frames = [f.select(*columns) for f in frames]
    return reduce(DataFrame.unionByName, frames) if frames else None


def current_manifest(
    spark: SparkSession, store: str, before: int | None = None, paths: DataFrame | None = None
) -> DataFrame:
    """Manifest rows of each document's newest version (below ``before``), of some ``paths`` only where given."""
    rows = manifest_files(spark, store, before, paths)
    if rows is None:
        return empty_frame(spark, MANIFEST + ", v bigint")
    if paths is not None:
        # Before anything is shuffled: a small batch meets the manifest's scan.
        rows = rows.join(paths, "source_path", "left_semi")
    return _newest(rows)


def compact_manifest(spark: SparkSession, store: str, before: int, every: int) -> bool:
    """Bring the batches before this one into buckets, once there are ``every`` since the last time."""
    upto, folders = _state(spark, store, before)
    if before - 1 - upto < every:
        return False
    since = _read(spark, store, [f"manifest/v={v}" for v in range(upto + 1, before)])
    if since is None:
        return False
    paths = materialize(since.select("source_path").distinct())
    # Whole buckets are written anew: those of the paths that changed.
    rows = manifest_files(spark, store, before, paths)
    newest = _newest(materialize(rows)).withColumn("b", _bucket())
    newest.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{store}/base/upto={before - 1}")
    touched = {r.b: before - 1 for r in paths.select(_bucket().alias("b")).distinct().collect()}
    state = [F.struct(F.lit(b).alias("bucket"), F.lit(f).cast("long").alias("folder")) for b, f in sorted({**folders, **touched}.items())]
    one = spark.range(1).select(F.inline(F.array(*state))).coalesce(1)
    one.write.mode("overwrite").parquet(f"{store}/state/upto={before - 1}")
    return True


def current_chunks(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of each document's newest version."""
    chunks = _versions(spark, store, "chunks")
    if chunks is None:
        raise ValueError(f"no chunks in {store}")
    newest = current_manifest(spark, store).select("source_path", "v").distinct()
    return chunks.withColumn("v", F.col("v").cast("long")).join(newest, ["source_path", "v"], "left_semi").drop("v")


def ingest_batch(
    docs: DataFrame,
    batch_id: int,
    store: str,
    rules: Mapping = DEFAULT_RULES,
    options: Mapping | None = None,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """One micro-batch; of several versions of a path in it the newest file's counts."""
    spark = docs.sparkSession
    compact_manifest(spark, store, batch_id, compact_every)
    newest = docs.groupBy("source_path").agg(F.max_by("text", F.struct("file_time", "file_path", "text")).alias("text"))
    latest = materialize(newest)
    paths = materialize(latest.select("source_path"))
    manifest = materialize(current_manifest(spark, store, batch_id, paths).drop("v"))
    fresh, _ = plan_ingest(latest, manifest, rules, options)
    stored_chunks(fresh).write.mode("overwrite").parquet(f"{store}/chunks/v={batch_id}")
    # Written last: a version counts once its manifest is there.
    manifest_rows(fresh).write.mode("overwrite").parquet(f"{store}/manifest/v={batch_id}")


def stream_ingest(
    spark: SparkSession,
    src_dir: str,
    schema: StructType | str,
    store: str,
    checkpoint: str,
    rules: Mapping = DEFAULT_RULES,
    options: Mapping | None = None,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    path: Column | None = None,
    compact_every: int = COMPACT_EVERY,
):
    """Ingest every new file of documents once, then stop.

    Rows carry ``text`` and ``source_path``, or what ``path`` is made of.

    Started again with the same checkpoint it goes on where it stopped.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    source_path = F.col("source_path") if path is None else path
    files = reader.load(src_dir).select(
        source_path.alias("source_path"), "text", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file_path")
    )
    query = (
        files.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, store, rules, options, compact_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
