"""The records of CSV files in file order, whatever blocks the files are split in.

Spark's own reader takes a file whose cells may span lines in one task, because
only from its start can one tell which line breaks lie inside quotes. Here files are
read as lines, in as many tasks as they have blocks:

1. Of each line two patterns tell where it ends, inside quotes or not, if it began
   inside, and if it began outside. (A quote opens only at the beginning of a cell,
   so an inch mark in a plain cell opens nothing.)
2. A task goes through the lines of a block once, under both assumptions, noting
   under each which lines begin a record and how many have so far. What a block
   does to either beginning is one row.
3. A prefix scan over those rows, one per block, tells each block how it really
   began, and how many records and lines stand before it.
4. A line that is a whole record stays where it is. Only lines of records that
   span several are brought together, by record.

Lines are written once between the steps, so that both read the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracegrid.operators.storage import materialize

# A cell that ends on its line; after a closing quote anything up to the comma belongs to it.
_CELL = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
_OPEN = r'"(?:[^"]|"")*+'
ENDS_INSIDE_FROM_OUTSIDE = rf"\A(?:{_CELL},)*+{_OPEN}\z"
ENDS_INSIDE_FROM_INSIDE = rf'\A(?:[^"]|"")*+(?:"[^,]*+,(?:{_CELL},)*+{_OPEN})?+\z'
# Rows of the block table up to which it is sent to every task: one row per block of some 100 MB.
MOST_BLOCKS = 1 << 18

_LINE = "block bigint, line bigint, value string, inside_0 boolean, inside_1 boolean, records_0 bigint, records_1 bigint, ends_0 boolean, ends_1 boolean"
_BLOCK = "file string, start bigint, exit_0 boolean, exit_1 boolean, lines bigint"


class _Block:
    """What is known of a block after the lines seen so far, under either beginning."""

    def __init__(self, number: int, file: str, start: int):
        self.number, self.file, self.start = number, file, start
        self.lines = 0
        self.inside = [False, True]
        self.records = [0, 0]

    def take(self, outside_ends: np.ndarray, inside_ends: np.ndarray, blank: np.ndarray) -> list[np.ndarray]:
        """Whether each line begins inside quotes and the records so far, for both beginnings."""
        n = len(blank)
        settles, turns = outside_ends == inside_ends, np.cumsum(outside_ends & ~inside_ends)
        last = np.maximum.accumulate(np.where(settles, np.arange(n), -1))
        settled = last >= 0
        at = np.maximum(last, 0)
        flips = (turns - np.where(settled, turns[at], 0)) % 2 == 1
        inside, records = [], []
        for e in (0, 1):
            after = np.where(settled, outside_ends[at], self.inside[e]) ^ flips
            before = np.concatenate([[self.inside[e]], after[:-1]])
            inside.append(before)
            records.append(self.records[e] + np.cumsum(~before & ~blank))
            self.inside[e], self.records[e] = bool(after[-1]), int(records[e][-1])
        self.lines += n
        return [*inside, *records]

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        values = {"block": self.number, "records_0": self.records[0], "records_1": self.records[1]}
        values |= {"file": self.file, "start": self.start, "exit_0": self.inside[0], "exit_1": self.inside[1], "lines": self.lines}
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    block, number = None, TaskContext.get().partitionId() << 32
    for batch in batches:
        if not len(batch):
            continue
        file, start = batch.column("file"), batch.column("start")
        new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, len(batch) - 1)), pc.not_equal(start.slice(1), start.slice(0, len(batch) - 1)))
        cuts = np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            here = (file[a].as_py(), start[a].as_py())
            if block is None or (block.file, block.start) != here:
                if block is not None:
                    yield block.row(schema)
                    number += 1
                block = _Block(number, *here)
            ends = [batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("ends_0", "ends_1", "blank")]
            lines = pa.array(np.arange(block.lines, block.lines + b - a))
            found = block.take(*ends)
            columns = {"block": pa.array(np.full(b - a, number)), "line": lines, "value": batch.column("value").slice(a, b - a)}
            columns |= {c: pa.array(x) for c, x in zip(("inside_0", "inside_1", "records_0", "records_1"), found, strict=True)}
            columns |= {"ends_0": pa.array(ends[0]), "ends_1": pa.array(ends[1])}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(b - a, f.type)) for f in schema], schema=schema)
    if block is not None:
        yield block.row(schema)


def _begun(blocks: DataFrame, skip: int) -> DataFrame:
    """How each block began, and what stands before it: records of its file, lines of it, records of earlier files."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.when(F.col("exit_0") == F.col("exit_1"), F.col("exit_0"))
    turn = (F.col("exit_0") & ~F.col("exit_1")).cast("int")
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    known = blocks.withColumn("settled", settled).withColumn("turns", F.sum(turn).over(upto))
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    turns = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(last(F.when(F.col("settled").isNotNull(), F.col("turns"))), F.lit(0))
    known = known.withColumn("began", F.coalesce(last(F.col("settled")), F.lit(False)) != (turns % 2 == 1))
    known = known.withColumn("records", F.when(F.col("began"), F.col("records_1")).otherwise(F.col("records_0")))
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = known.withColumn("records_before", sums("records")).withColumn("lines_before", sums("lines"))
    files = known.groupBy("file").agg(F.greatest(F.sum("records") - skip, F.lit(0)).alias("data"))
    # One row per file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("data").over(earlier), F.lit(0)).alias("data_before"))
    return known.join(files, "file").select("block", "began", "records_before", "lines_before", "data_before")


def csv_records(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """``position`` (1, 2, ... over all files, by path) and ``record``, after the first ``skip`` records of each file.

    Blank lines outside quotes are no records. A line break inside quotes becomes ``\\n``.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").rlike(ENDS_INSIDE_FROM_OUTSIDE).alias("ends_0"),
        F.col("value").rlike(ENDS_INSIDE_FROM_INSIDE).alias("ends_1"),
        (F.col("value") == "").alias("blank"),
    )
    schema = T.StructType.fromDDL(f"{_LINE}, {_BLOCK}")
    arrow = to_arrow_schema(schema)
    both = materialize(lines.mapInArrow(lambda b: _scan(b, arrow), schema))
    blocks = materialize(_begun(both.where("file is not null").drop("value"), skip))
    begun = F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks
    told = both.where("file is null").select(*[f.split()[0] for f in _LINE.split(", ")]).join(begun, "block")
    which = lambda a, b: F.when(F.col("began"), F.col(b)).otherwise(F.col(a))
    inside = which("inside_0", "inside_1")
    placed = told.select(
        "value",
        (F.col("lines_before") + F.col("line")).alias("line"),
        inside.alias("inside"),
        F.when(inside, F.col("ends_1")).otherwise(F.col("ends_0")).alias("goes_on"),
        (F.col("records_before") + which("records_0", "records_1") - skip).alias("nth"),
        "data_before",
    ).where("nth > 0")
    placed = placed.withColumn("position", F.col("data_before") + F.col("nth"))
    alone = placed.where("not inside and not goes_on and value <> ''").select("position", F.col("value").alias("record"))
    spread = placed.where("inside or goes_on").groupBy("position").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("l"))
    return alone.unionByName(spread.select("position", F.array_join(F.col("l.value"), "\n").alias("record")))
