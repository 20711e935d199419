"""Writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.operators.diff import hierarchy_value
from tracegrid.operators.storage import freed_shuffles


def write_normalized(
    tables: Mapping[str, DataFrame],
    flat: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    compression: str | None = None,
) -> None:
    """One dataset per table that has columns under ``path``, and the filled flat table.

    ``compression`` is a codec of the format's, by default the session's for Parquet and none for CSV. The shuffle
    files of a table go when it is written, before the next one makes its own.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    for name, df in {**tables, "flat_filled": flat}.items():
        if not df.columns:
            continue  # no column of the input belongs to this table
        writer = df.write.mode(mode)
        if compression:
            writer = writer.option("compression", compression)
        with freed_shuffles(df.sparkSession):
            if fmt == "csv":
                writer.option("header", True).option("escape", '"').csv(f"{path}/{name}")
            else:
                writer.parquet(f"{path}/{name}")


def grouped_rows(
    diff: DataFrame, hierarchy_cols: Sequence[str], level: int, columns: Sequence[str]
) -> DataFrame:
    """Comparison rows with their group values; the right value stands in where left is null."""
    groups = [hierarchy_value(diff, c).alias(f"group_{i}") for i, c in enumerate(hierarchy_cols[: max(1, level)], 1)]

    def shown(c: str):
        return F.coalesce(named(c), named(f"{c}_right")) if f"{c}_right" in diff.columns else named(c)

    return diff.select(
        *groups, F.col("_merge").alias("status"), "changed_columns", *[shown(c).alias(c) for c in columns]
    )


def write_grouped_json(
    diff: DataFrame, hierarchy_cols: Sequence[str], level: int, columns: Sequence[str], path: str
) -> None:
    """Rows as JSON lines in one folder per group.

    The rebalance hint gathers small groups and lets adaptive execution split a
    group too large for one task into several files.
    """
    rows = grouped_rows(diff, hierarchy_cols, level, columns)
    keys = [c for c in rows.columns if c.startswith("group_")]
    rows.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").option(
        "ignoreNullFields", False
    ).partitionBy(*keys).json(path)


def publish_catalog(spark: SparkSession, old: DataFrame, new: DataFrame, diff: DataFrame, prefix: str = "") -> None:
    """Replace the tables of the old rows, the new rows and their difference; an empty difference has no table.

    All three are written under other names first, each once, and take their names
    only when all are there: a write that fails leaves the former tables as they were.
    """
    frames = {"old": old, "new": new, "diff": diff}
    staged = {name: f"{prefix}dataset_{name}__staged" for name in frames}
    try:
        for name, df in frames.items():
            df.write.mode("overwrite").saveAsTable(staged[name])
    except Exception:
        for table in staged.values():
            spark.sql(f"drop table if exists {table}")
        raise
    for name, table in staged.items():
        spark.sql(f"drop table if exists {prefix}dataset_{name}")
        if name == "diff" and spark.table(table).isEmpty():
            spark.sql(f"drop table {table}")
        else:
            spark.sql(f"alter table {table} rename to {prefix}dataset_{name}")


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Chosen columns with a header, every field quoted, quotes doubled, null as empty."""
    chosen = df.select(*map(named, columns or df.columns))
    texts = chosen.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(c) for c in chosen.columns])
    texts.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_diff_csv(diff: DataFrame, path: str) -> None:
    export_csv(diff, path)
