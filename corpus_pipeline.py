"""The corpus pipeline: quality rules, quality classifier, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it back as the next stage's documents.
All stages but the last return the columns of ``docs`` as they came, whatever they
are called: a document travels as one struct beside what a stage works out.

No stage needs ids to be unique or filled: the near-duplicate stage, the only one
that looks documents up again, tells rows apart by file and row in the Parquet files
it reads. Documents without words are removed by the quality rules. The two quality
stages read texts twice rather than write them a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.llm.jaccard_join import near_duplicates
from tracegrid.llm.mixing import mix
from tracegrid.llm.packing import best_fit
from tracegrid.llm.quality_classifier import quality_scores
from tracegrid.llm.quality_rules import quality_rules
from tracegrid.operators.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Documents in one Arrow batch, in this session from the classifier on.
BATCH_ROWS = 1000


def _beside(docs: DataFrame, *columns: str) -> DataFrame:
    """Each document as the struct ``__doc``, beside the columns that a stage reads."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("__doc"), *map(named, columns))


def _placed(docs: DataFrame) -> DataFrame:
    """The documents with ``__row``: file and row in it, the same in every scan however files are split.

    Documents that are not read straight from files are written first.
    """
    try:
        place = docs.metadataColumn("_metadata")
    except AnalysisException:
        docs = materialize(docs)
        place = docs.metadataColumn("_metadata")
    row = F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))
    return docs.select(F.struct(*map(named, docs.columns)).alias("__doc"), named("doc_id"), named("text"), row.alias("__row"))


def _small_batches(spark: SparkSession) -> None:
    """Whole documents pass to Python beside their texts: by default ten thousand at a time, which a task need not hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _documents(rows: DataFrame, keep: Column) -> DataFrame:
    return rows.where(keep).select("__doc.*")


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the fences of their language and source let pass."""
    judged = quality_rules(_beside(docs, "text", "lang", "source"), carry=["__doc", "lang", "source"], keep_counts=False)
    return _documents(judged, F.col("kept"))


def by_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones.

    It learns from the labelled rows of the whole table: the rules before it leave few bad ones.
    """
    _small_batches(spark)
    table, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(_beside(docs, "doc_id", "text"), labels, carry=["__doc"], keep_stats=False, learn_from=table)
    return _documents(scored, F.col("predicted") == 1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    _small_batches(spark)
    rows = _placed(docs)
    found = near_duplicates(rows.select(F.struct("doc_id", "__row").alias("id"), "text"), "id")
    others = materialize(found.where(F.col("id") != F.col("component_id")).select(F.col("id.__row").alias("__other")))
    return _documents(rows.join(others, F.col("__row") == F.col("__other"), "left_anti"), F.lit(True))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each pass that takes at least half of it."""
    drawn = mix(_beside(docs, "doc_id", "text", "source")).withColumn("__draw", F.explode("draws"))
    return _documents(drawn, 2 * F.col("__draw.words") >= F.col("size"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return best_fit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", by_quality_rules),
    ("quality_classifier", by_quality_classifier),
    ("jaccard_join", one_of_each_group),
    ("mix_sources", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]

# The classifier's fit has no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
