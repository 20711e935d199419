"""Toxicity scores of whole texts by a bidirectional gated recurrent network (``gru``).

The network is trained in numpy on the driver from a bounded sample of labelled
texts, at most ``PER_CLASS`` of each label, those of the smallest hash of their id
among the texts of at most ``TRAIN_CHARS`` characters. It is a few megabytes,
whatever the corpus, and goes to the tasks with the function that scores: every
text, over all its overlapping windows, without a shuffle. A text's score is that
of its worst window.

Defined results: null and empty texts, and texts without a letter, score as the
trained bias says (far below the threshold); null ids are never trained on; with
labels of one class only, or none, every text scores 0; equal texts score alike;
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid.functions.text import named
from tracegrid.llm.gru import Network, train

# Bounds of the training sample.
PER_CLASS = 1000
TRAIN_CHARS = 12000
THRESHOLD = 0.7


def training_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, per_class: int
) -> tuple[list[str], list[int]]:
    """At most ``per_class`` texts of each label, the same on every run."""
    ids = labels.select(named(id_col).alias("__id"), named(label_col).alias("__label")).distinct()
    texts = docs.where(learn & (F.length(named(text_col)) <= TRAIN_CHARS))
    # Ids are chosen before any text moves; a semi join's ids are as many as the sample has rows.
    able = texts.select(named(id_col).alias("__id")).distinct().join(ids, "__id")
    chosen = None
    for y in (0, 1):
        part = able.where(F.col("__label") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = texts.select(named(id_col).alias("__id"), named(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    once = picked.dropDuplicates(["__id", "__label"]).orderBy(F.xxhash64("__id"), "__id", "__label")
    rows = once.select("__text", "__label").collect()  # at most 2 * per_class texts of bounded length
    return [r["__text"] for r in rows], [r["__label"] for r in rows]


def with_toxicity(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the score of each whole text."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches:
            scores = network.score_texts(texts) if network else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], names=[id_col, "score"])

    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(add, schema)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> DataFrame:
    """One row per document: its id and ``score``. ``learn``: the documents whose labels may be used."""
    texts, known = training_sample(docs, labels, learn, id_col, text_col, label_col, per_class)
    network = train(texts, known) if len(set(known)) == 2 else None
    return with_toxicity(docs, network, id_col, text_col)
