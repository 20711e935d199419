"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but token ids, two or four bytes each, every document
closed by the end-of-document id; there is no index. It is read in blocks of fixed
size that know nothing of documents. Each block is searched for the separator in
one vectorised comparison, giving the tokens before its first separator, those
after its last, and the lengths between. A prefix scan over the blocks' summaries
(separators so far, tokens carried over blocks without one) then stitches the
documents that cross block edges.

Scale: blocks are scanned independently; the scan over summaries moves one narrow
row per block, and within a file only, cut into stretches so that no task holds a
whole file's blocks. Texts and tokens are never shuffled.

Defined results: an empty or null text is a document of no tokens; tokens after a
file's last separator are a document without an end and are counted under the next
number with ``closed`` false; an empty file has no documents; repeated rows are
documents of their own; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracegrid.functions.text import named
from tracegrid.llm.tokenizer_files import byte_bpe
from tracegrid.operators.storage import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END_OF_DOCUMENT = 50256
TOKEN_BYTES = 2
BLOCK_TOKENS = 1 << 18
# Blocks whose summaries are summed in one go.
STRETCH = 4096


def write_token_stream(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end: int = END_OF_DOCUMENT,
    token_bytes: int = TOKEN_BYTES,
    block_tokens: int = BLOCK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Tokenise every whole text into flat files: (blocks, documents).

    One file per task, in blocks ``file``, ``block``, ``data`` cut wherever a block is
    full; and the order in which documents went into it: ``file``, ``doc``, the id.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType.fromDDL(f"file int, block int, data binary, doc bigint, id {kind.simpleString()}")
    arrow = to_arrow_schema(schema)
    size = block_tokens * token_bytes
    dtype = f"<u{token_bytes}"

    closing = np.array([end], dtype=dtype).tobytes()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, doc, left = TaskContext.get().partitionId(), 0, 0, b""
        encode, _ = byte_bpe(tokenizer)

        def cut(data: bytes) -> pa.RecordBatch:
            row = [pa.array([x], f.type) for x, f in zip((number, block, data, None, None), arrow, strict=True)]
            return pa.RecordBatch.from_arrays(row, schema=arrow)

        for batch in batches:
            n = len(batch)
            none = pa.nulls(n, pa.int32())
            docs_here = pa.array(np.arange(doc, doc + n), pa.int64())
            numbers = pa.array(np.full(n, number), pa.int32())
            yield pa.RecordBatch.from_arrays([numbers, none, pa.nulls(n, pa.binary()), docs_here, batch.column(0)], schema=arrow)
            doc += n
            for i in range(0, n, 64):
                texts = [t or "" for t in batch.column(1).slice(i, 64).to_pylist()]
                left = b"".join([left, *(x for ids in encode(texts) for x in (ids.astype(dtype).tobytes(), closing))])
                while len(left) >= size:
                    yield cut(left[:size])
                    block, left = block + 1, left[size:]
        if left:
            yield cut(left)

    both = materialize(docs.select(named(id_col).alias("id"), named(text_col)).mapInArrow(files, schema))
    blocks = both.where(F.col("data").isNotNull()).select("file", "block", "data")
    return blocks, both.where(F.col("doc").isNotNull()).select("file", "doc", F.col("id").alias(id_col))


def read_token_files(spark: SparkSession, path: str, token_bytes: int = TOKEN_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files on any storage Spark reads: ``file`` (its path), ``block``, ``data``."""
    size = token_bytes * block_tokens
    raw = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "content", "length")
    numbers = F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))
    cut = raw.select("file", "content", F.explode(numbers).alias("block"))
    data = F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size))
    return cut.select("file", F.col("block").cast("int").alias("block"), data.alias("data"))


def separator_scan(blocks: DataFrame, end: int = END_OF_DOCUMENT, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """Tokens of each document: ``file``, ``doc`` (its number in the file), ``n_tokens``, ``closed``."""
    kind = blocks.schema["file"].dataType.simpleString()
    dtype = f"<u{token_bytes}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer(), dtype=dtype)
                ends = np.flatnonzero(tokens == end)
                head = int(ends[0]) if len(ends) else len(tokens)
                tail = len(tokens) - int(ends[-1]) - 1 if len(ends) else len(tokens)
                found.append((len(ends), head, tail, np.diff(ends) - 1))
            bounds = np.cumsum([0] + [len(f[3]) for f in found]).astype(np.int32)
            inner = pa.array(np.concatenate([f[3] for f in found]) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds), inner),
                ],
                names=["file", "block", "ends", "head", "tail", "inner"],
            )

    schema = f"file {kind}, block int, ends bigint, head bigint, tail bigint, inner array<bigint>"
    summaries = materialize(blocks.select("file", "block", "data").mapInArrow(scan, schema))
    narrow = summaries.select("file", "block", "ends", "head", "tail").withColumn("stretch", F.expr(f"block div {STRETCH}"))

    # The summary of a run of blocks: separators, and the tokens since the last one (all, if there is none).
    order = Window.partitionBy("file", "stretch").orderBy("block")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    narrow = narrow.withColumn("seen", F.sum("ends").over(running))
    # Blocks after the same separator form a run whose open tokens add up.
    open_here = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("head"))
    run = Window.partitionBy("file", "stretch", "seen").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    narrow = narrow.withColumn("open", F.sum(open_here).over(run))
    last = narrow.groupBy("file", "stretch").agg(
        F.max("seen").alias("ends"), F.max_by("open", "block").alias("tail")
    )
    by_stretch = Window.partitionBy("file").orderBy("stretch")
    whole = by_stretch.rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("seen", F.sum("ends").over(whole))
    same = Window.partitionBy("file", "seen").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("open", F.sum("tail").over(same))
    carried = last.select(
        F.col("file"),
        F.col("stretch"),
        F.coalesce(F.lag("seen").over(by_stretch), F.lit(0)).alias("before"),
        F.coalesce(F.lag("open").over(by_stretch), F.lit(0)).alias("brought"),
    )
    stitched = narrow.join(carried, ["file", "stretch"]).select(
        "file",
        "block",
        # What stands before this block: separators, and tokens of the document it begins in.
        (F.col("before") + F.col("seen") - F.col("ends")).alias("doc"),
        (
            F.coalesce(F.lag("open").over(order), F.lit(0))
            + F.when(F.col("seen") - F.col("ends") == 0, F.col("brought")).otherwise(0)
        ).alias("open"),
    )
    closing = summaries.join(stitched, ["file", "block"]).where("ends > 0")
    lengths = F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))
    closed = closing.select("file", "doc", F.posexplode(lengths).alias("at", "n_tokens")).select(
        "file", (F.col("doc") + F.col("at")).alias("doc"), "n_tokens", F.lit(True).alias("closed")
    )
    final = last.groupBy("file").agg(F.max("seen").alias("doc"), F.max_by("open", "stretch").alias("n_tokens"))
    left = final.where("n_tokens > 0").select("file", "doc", "n_tokens", F.lit(False).alias("closed"))
    return closed.unionByName(left)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``n_tokens`` of each document: its text goes into a flat file, the count comes from the scan."""
    blocks, order = write_token_stream(docs, id_col, text_col, tokenizer)
    found = order.join(separator_scan(blocks), ["file", "doc"])
    return found.select(named(id_col), "n_tokens")
