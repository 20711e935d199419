"""The registered queries of this subpackage and, where one exists, their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import sql
from tracegrid.llm.alignment import align_tokens
from tracegrid.llm.bit_sliced import top_k
from tracegrid.llm.embedding_dedup import near_duplicate_vectors
from tracegrid.llm.fill_in_middle import fill_in_middle, restored
from tracegrid.llm.jaccard_join import near_duplicates
from tracegrid.llm.mixing import mix, taken
from tracegrid.llm.packing import best_fit, near_copies
from tracegrid.llm.quality_classifier import held_out, quality_scores
from tracegrid.llm.quality_rules import quality_rules
from tracegrid.llm.sharding import shard_by_bytes
from tracegrid.llm.token_counts import token_counts
from tracegrid.llm.toxicity import THRESHOLD, toxicity_scores
from tracegrid.llm.url_filter import url_filter
from tracegrid.llm.words import word_count
from tracegrid.operators.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_quality_rules", sql.QUALITY_RULES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, carry=["doc_id", "lang", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op1_mix_sources", sql.MIX_SOURCES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix(sized, text_col=None, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", taken("draws").alias("taken"))


@query("op2_jaccard_join", sql.JACCARD_JOIN)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of near copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_shard_by_bytes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_bit_sliced_top_k", sql.TOP_K)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")


@query("op7_url_filter", sql.URL_FILTER)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document; near copies never share a bin."""
    docs = table(spark, sf_dir, "documents")
    return best_fit(docs, copies=near_copies(docs))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    out = held_out(F.col("doc_id"), 3, 1)
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op11_align_tokens")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers, in every document."""
    found = align_tokens(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


@query("op12_fill_in_middle", sql.FILL_IN_MIDDLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in prefix, middle and suffix, and put together again from the output."""
    formed = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return formed.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op13_embedding_dedup", sql.EMBEDDING_DEDUP)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
