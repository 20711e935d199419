"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a row of transformed statistics (``text_stats``). Of each
class the mean and the covariance are learned; covariances are shrunk towards the
pooled one and towards a multiple of the identity, the more the fewer rows there are,
so that they can be factored whatever the class looks like. A score is the difference of the classes' Mahalanobis
log densities, from Cholesky factors that are worked out once, plus the difference
of the log priors, flattened by a temperature, as a probability.

Scale: fitting is one aggregate of sums and products over all labelled rows (no
sample); the model is a few hundred numbers. Texts are read once, statistics are
kept in the shared folder, and scoring needs no shuffle.

Defined results: null, empty and blank texts are scored like any text, by their
zero statistics; a null id is never a training row; of a document labelled more
than once, every label counts; with no labels or only one class the model is
flat: each document scores the share of label 1 (0.5 without labels); repeated
rows score alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid.functions.text import named
from tracegrid.llm.text_stats import FEATURES, text_features
from tracegrid.operators.storage import materialize

# Shrinkage of a class's covariance: towards the pooled one, then towards the identity.
TO_POOLED = 0.3
TO_IDENTITY = 0.05
# Rows per statistic from which the shrinkage stays as above; with fewer it grows as they get fewer.
ENOUGH = 4
# Densities of many related statistics are overconfident: log odds are divided by this.
TEMPERATURE = 4.0
THRESHOLD = 0.3


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold that is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def with_features(docs: DataFrame, carry: Sequence[str], text_col: str = "text", name: str = "features") -> DataFrame:
    """The ``carry`` columns of the documents and an array of ``FEATURES``."""
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(name, T.ArrayType(T.DoubleType(), False))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_features(batch.column(len(carry)))
            bounds = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(FEATURES))
            lists = pa.ListArray.from_arrays(bounds, pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*carry, name])

    return _numbered(docs, [*carry, text_col]).mapInArrow(add, schema)


def _numbered(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns under plain names: ``mapInArrow`` takes no dots in those of its input."""
    return rows.select(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)])


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of the two classes on standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    offsets: tuple[float, ...] = ()
    flat: float | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [
            off - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1)
            for m, f, off in zip(self.means, self.factors, self.offsets, strict=True)
        ]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / TEMPERATURE, -40, 40)))


def _shrinkage(least: float, rows: int) -> float:
    return min(1.0, least * max(1.0, ENOUGH * len(FEATURES) / rows))


def fit(rows: DataFrame, label_col: str, features_col: str = "features") -> Discriminant:
    """Learn from all rows whose label is 0 or 1: one aggregate, combined before the shuffle."""
    n = len(FEATURES)
    label, x = named(label_col), F.col(features_col)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.where(label.isin(0, 1)).groupBy(label.alias("y")).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x[i]) for i in range(n)]).alias("first"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("second"),
    )
    found = {r.y: r for r in sums.collect()}  # two rows at most
    counts = {y: found[y].n if y in found else 0 for y in (0, 1)}
    total = counts[0] + counts[1]
    if not min(counts.values()):
        return Discriminant(np.zeros(n), np.ones(n), flat=counts[1] / total if total else 0.5)
    means, covariances = [], []
    for y in (0, 1):
        mean = np.array(found[y].first) / counts[y]
        second = np.zeros((n, n))
        for (i, j), v in zip(pairs, found[y].second, strict=True):
            second[i, j] = second[j, i] = v / counts[y]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    to_identity = _shrinkage(TO_IDENTITY, total)
    few = to_identity - TO_IDENTITY
    pooled = sum(counts[y] * covariances[y] for y in (0, 1)) / total
    centre = sum(counts[y] * means[y] for y in (0, 1)) / total
    # A few rows may agree in a statistic by chance: they get some of the spread between the classes.
    pooled = pooled + few * np.diag((means[1] - means[0]) ** 2 / 4)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9 + few * 1e-4))
    factors, offsets = [], []
    for y in (0, 1):
        to_pooled = _shrinkage(TO_POOLED, counts[y])
        shrunk = ((1 - to_pooled) * covariances[y] + to_pooled * pooled) / np.outer(scale, scale)
        shrunk = (1 - to_identity) * shrunk + to_identity * np.eye(n) * max(np.trace(shrunk) / n, 1e-6)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(counts[y] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, tuple((m - centre) / scale for m in means), tuple(factors), tuple(offsets))


def with_score(rows: DataFrame, model: Discriminant, features_col: str = "features", name: str = "score") -> DataFrame:
    """Add the score to rows that carry their statistics."""
    rest = [c for c in rows.columns if c not in (features_col, name)]
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField(name, T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(len(rest)).flatten().to_numpy(zero_copy_only=False)
            scores = model.score(flat.reshape(len(batch), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*rest, name])

    return _numbered(rows, [*rest, features_col]).mapInArrow(add, schema)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    fold: int = 0,
    carry: Sequence[str] = (),
    keep_stats: bool = True,
    learn_from: DataFrame | None = None,
) -> DataFrame:
    """The id and the ``carry`` columns of each document with ``held_out``, ``score`` and ``predicted``.

    Those columns are written with the statistics in the shared folder, so that
    texts are read once; without ``keep_stats`` only ids and statistics are, and
    texts are read again to be scored. The model learns from the labelled rows of
    ``learn_from``, by default of ``docs``.
    """
    carried = [c for c in dict.fromkeys([id_col, *carry]) if c not in ("held_out", "score", "predicted")]
    stats = materialize(with_features(docs, carried, text_col, "__features")) if keep_stats else None
    seen = stats
    if learn_from is not None or not keep_stats:
        seen = materialize(with_features(docs if learn_from is None else learn_from, [id_col], text_col, "__features"))
    out = held_out(named(id_col), folds, fold)
    known = labels.select(named(id_col).alias("__id"), named(label_col).alias("__label"))
    learned = seen.where(~out).select(named(id_col).alias("__own"), "__features").join(known, F.col("__own") == F.col("__id"))
    model = fit(learned, "__label", "__features")
    rows = stats if keep_stats else with_features(docs, carried, text_col, "__features")
    scored = with_score(rows, model, "__features", "score")
    return scored.select(
        *map(named, carried), out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
