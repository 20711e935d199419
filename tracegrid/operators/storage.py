"""Keeping an intermediate result that several later steps read."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's checkpoint folder.

    Where none is set, a local session gets a temporary folder that goes with the
    driver; on a cluster there is no folder to fall back on, so this raises.
    """
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tracegrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of the given schema, without a Python job."""
    nulls = F.from_json(F.lit(None).cast("string"), schema)
    return spark.range(0).select(nulls.alias("r")).select("r.*")


# Spark's own setting; versions that do not know it leave the files until the driver collects its garbage, as by default.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of a statement go when it ends; those of cached frames stay."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, compression: str = "snappy", free: bool = False) -> DataFrame:
    """Write once, read as often as needed.

    A table in the shared folder outlives lost executors, cuts the lineage, and
    lets every reader fetch just its columns. ``free`` drops the shuffle files of
    the write as soon as it is done.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tracegrid/{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession) if free else contextlib.nullcontext():
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
