"""Reading flat exports."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrid.functions.text import blank_to_null, clean_str, named, py_strip
from tracegrid.operators.ordered import ordered_scan
from tracegrid.operators.storage import empty_frame
from tracegrid.sources.records import csv_records


def clean_header(name: str) -> str:
    """Collapse a phrase said twice (``Name NAME``), else words said twice in a row."""
    words = name.split()
    if not words:
        return name
    low = [w.lower() for w in words]
    for size in range(1, len(words) // 2 + 1):
        if len(words) % size == 0 and low == low[:size] * (len(words) // size):
            return clean_header(" ".join(words[:size]))
    kept = [w for i, w in enumerate(words) if i == 0 or low[i] != low[i - 1]]
    return " ".join(kept)


def clean_headers(names: Sequence[str]) -> list[str]:
    """Cleaned header names; an empty one becomes ``col_<n>``; equal names are an error."""
    cleaned = [clean_header(n) if n and n.strip() else f"col_{i}" for i, n in enumerate(names, 1)]
    twice = sorted({n for n in cleaned if cleaned.count(n) > 1})
    if twice:
        raise ValueError(f"header names collide after cleaning: {', '.join(twice)}")
    return cleaned


CSV = {"escape": '"', "enforceSchema": "true"}


def _csv_header(spark: SparkSession, path: str, header_row: int) -> tuple[list[str], int]:
    """The cleaned names in row ``header_row``, and how many records end there."""
    lines = spark.read.text(path).select("value", "_metadata.file_block_start")
    top = [r.value for r in lines.where("file_block_start = 0").limit(header_row).collect()]
    if len(top) < header_row:
        raise ValueError(f"no header in row {header_row} of {path}")
    records = [r for r in csv.reader(top) if r]
    return clean_headers(records[-1]), len(records)


def _parsed(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """Records as text columns ``c0``, ...; a record wider than the header is cut to it."""
    fields = ", ".join(f"c{i} string" for i, _ in enumerate(names))
    return records.withColumn("__r", F.from_csv("record", fields, {"escape": '"'})).select("position", "record", "__r.*")


def _numbered(found: DataFrame, position: str) -> DataFrame:
    """Rows of Parquet files with their place in file order."""
    placed = found.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = placed.groupBy("__file").agg(F.count("*").alias("__rows"))
    # One row per file.
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__file", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    place = (F.col("__before") + F.col("__at") + 1).alias(position)
    return placed.join(before, "__file").select(place, *map(named, found.columns))


def read_flat(
    spark: SparkSession, path: str, header_row: int = 1, multi_line: bool = True, position: str | None = None
) -> DataFrame:
    """A Parquet table as it is, or CSV files as text columns with cleaned headers.

    ``header_row`` is 1-based; lines before it are skipped. Short rows are padded
    with nulls; records wider than the header are cut to it, and ``surplus_rows``
    returns them. Quoted cells may span lines, and files are split all the same
    (``records``); ``multi_line=False``, for files with a record on every line,
    saves writing the lines once. ``position`` names a first column with the place
    of each record among all of them, from 1: files by path, records as they stand.
    """
    if not path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        found = spark.read.parquet(path)
        names = clean_headers(found.columns)
        return _numbered(found, position).toDF(position, *names) if position else found.toDF(*names)
    names, skip = _csv_header(spark, path, header_row)
    if position in names:
        raise ValueError(f"a column is named {position} already")
    if multi_line or position:
        rows = _parsed(csv_records(spark, path, skip), names).drop("record")
        return rows.toDF(position, *names) if position else rows.drop("position").toDF(*names)
    fields = ", ".join(f"c{i} string" for i, _ in enumerate(names))
    if header_row == 1:
        return spark.read.csv(path, schema=fields, header=True, **CSV).toDF(*names)
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def below_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Only a file's first block comes here, in order; the count spans its batches.
        left: dict[str, int] = {}
        for batch in batches:
            nth = batch.groupby("file_path").cumcount()
            skip = batch["file_path"].map(lambda p: left.get(p, header_row))
            for file, size in batch["file_path"].value_counts().items():
                left[file] = max(0, left.get(file, header_row) - size)
            yield batch.loc[nth >= skip, ["value"]]

    first = lines.where("file_block_start = 0").select("value", "file_path").mapInPandas(below_header, "value string")
    rest = lines.where("file_block_start > 0").select("value")
    parsed = F.from_csv("value", fields, {"escape": '"'}).alias("r")
    return first.unionByName(rest).where("value <> ''").select(parsed).select("r.*").toDF(*names)


def surplus_rows(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """The raw ``record`` of each CSV row with more cells than the header, and its ``cells`` beyond it."""
    names, skip = _csv_header(spark, path, header_row)
    records = csv_records(spark, path, skip).select("record")
    wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    beyond = F.from_csv("record", wide, {"escape": '"'})[f"c{len(names)}"]
    return records.select("record", beyond.alias("cells")).where("cells is not null")


# Fixed value: what parses as a number.
ANY_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _parses(c: str) -> Column:
    return clean_str(c).rlike(ANY_NUMBER)


def widen_numeric(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Text columns that hold numbers and nothing else as doubles, and the columns left as text.

    One aggregate over all rows decides: a column is a number where each filled
    cell is one. A column with numbers and other text stays text, so that no value
    is lost; the second frame counts what kept it from being a number. ``keep``
    names columns never to touch.
    """
    texts = [c for c, t in df.dtypes if t == "string" and c not in keep]
    if not texts:
        return df, empty_frame(df.sparkSession, "column_name string, cast_errors bigint")
    filled = lambda c: clean_str(c) != ""
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count_if(_parses(c)).alias("numbers"),
                    F.count_if(filled(c) & ~_parses(c)).alias("cast_errors"),
                )
                for c in texts
            ]
        ).alias("r")
    )
    found = {r.column_name: r for r in counts.select(F.inline("r")).collect()}  # a row per column
    wide = {c for c, r in found.items() if r.numbers and not r.cast_errors}
    cast = df.select(*[py_strip(c).try_cast("double").alias(c) if c in wide else named(c) for c in df.columns])
    report = [(c, r.cast_errors) for c, r in found.items() if r.numbers]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(n).cast("long").alias("cast_errors")) for c, n in report]
    if not rows:
        return cast, empty_frame(df.sparkSession, "column_name string, cast_errors bigint")
    return cast, df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def ingest_with_carry(
    df: DataFrame,
    required: Mapping[str, str],
    extra: Mapping[str, str],
    order_by: Sequence[str],
    first_row: int = 1,
    name_col: str = "SIGNAL_NAME",
    copy_down: bool = True,
    path: str | None = None,
    rebuild: bool = False,
) -> DataFrame:
    """Logical columns with source row numbers; required ones filled down; blank names dropped.

    The number and the fill share one ordered scan, and rows are dropped only
    after it. With ``path`` the result is kept there as Parquet and reused
    unless ``rebuild``.
    """
    spark = df.sparkSession
    if path and not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass  # nothing there yet
    order = [f"__o{i}" for i, _ in enumerate(order_by)]
    renamed = df.select(
        *[named(c).alias(n) for n, c in {**required, **extra}.items() if c in df.columns],
        *[named(c).alias(n) for n, c in zip(order, order_by)],
    )
    known = [n for n in required if n in renamed.columns] if copy_down else []
    scanned = ordered_scan(
        renamed, order, fills={f"__f_{n}": blank_to_null(n) for n in known}, sums={"__n": F.lit(1).cast("long")}
    )
    out = scanned.select(
        (F.col("__n") + (first_row - 1)).alias("row_number"),
        *[
            named(f"__f_{c}").alias(c) if c in known else named(c)
            for c in renamed.columns
            if c not in order
        ],
    )
    if name_col in out.columns:
        out = out.withColumn(name_col, py_strip(name_col)).where(named(name_col) != "")
    if path is None:
        return out
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
