"""Sharding by byte-size prefix sums.

Documents are put in the order of their ids and dealt to ranges of that order,
one per partition. The totals of the ranges, summed up in order, give each
document the bytes before it in the whole corpus; cutting that line at equal
targets gives contiguous shards whose sizes differ by about one document.

Scale: the documents' texts are not moved, only (id, size, checksum, tie). One
row per range passes through a single task. Ranges are cut by sampling once and
their numbers are written down before they are used twice, so that a recomputed
task cannot see other ranges. Equal ids, up to a third of all rows, are told
apart by their place in the input and so spread over ranges too.

Defined results: a null text has size 1 and no checksum, an empty one size 1;
null ids come first; repeated rows are sharded one by one; no rows give no rows;
documents larger than a target leave shards empty rather than being cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.operators.storage import materialize

SHARDS = 16


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: its id, ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    text = named(text_col).cast("binary")
    rows = docs.select(
        named(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["id", "crc", "size", "tie"]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))

    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    heads = materialize(
        totals.select(
            "range",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("total"),
        )
    )
    within = Window.partitionBy("range").orderBy(*order)
    running = ranged.select(
        "id",
        "size",
        "crc",
        "range",
        (F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.row_number().over(within) - 1).cast("long").alias("row"),
    )
    # A document belongs where its middle lies.
    placed = running.join(heads, "range").select(
        "id",
        "size",
        "crc",
        (F.col("rows_before") + F.col("row")).alias("row"),
        F.expr(f"cast((2 * (bytes_before + start) + size) * {shards} div (2 * total) as int)").alias("shard"),
    )
    placed = materialize(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(first, "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """Write the documents as one folder of Parquet files per shard (ids must be unique)."""
    placed = shard_by_bytes(docs, id_col, text_col, shards).select(named(id_col).alias("__id"), "shard", "slot")
    rows = docs.drop("shard", "slot").join(placed, named(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
