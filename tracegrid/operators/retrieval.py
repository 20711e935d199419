"""Nearest vectors, filters on what they belong to, reranking and context texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracegrid.functions.text import _col, clean_str, named, text
from tracegrid.operators.ordered import union_all
from tracegrid.operators.storage import materialize

# Rows of a block at most, and rows below which a block is not worth a task.
BLOCK_ROWS = 65536
LEAST_ROWS = 256
# Vectors, drawn from the corpus, around which blocks are formed; and queries compared at a time.
PIVOTS = 256
QUERIES_AT_ONCE = 64
# Added to bounds on distances, far above what rounding can do.
SLACK = 1e-6
# Distances are rounded so that copies of a vector are equal whatever the batch.
DISTANCE_DIGITS = 12
MERGE_FANOUT = 32


def pre_filter(
    chunks: DataFrame,
    doc_level: str | None = None,
    doc_name: str | None = None,
    tags: str | None = None,
    section_prefix: str | None = None,
    source_prefix: str | None = None,
) -> DataFrame:
    """What the store itself can test: equality, and containment where a prefix is asked for."""
    out = chunks
    if doc_level:
        out = out.where(F.col("doc_level") == doc_level)
    if doc_name:
        out = out.where(F.col("doc_name") == doc_name)
    if tags:
        out = out.where(_has_tag(chunks, tags))
    if section_prefix:
        out = out.where(F.contains(F.col("section_id").cast("string"), F.lit(section_prefix)))
    if source_prefix:
        out = out.where(F.contains("source_path", F.lit(source_prefix)))
    return out


def _has_tag(chunks: DataFrame, tag: str) -> Column:
    if isinstance(chunks.schema["tags"].dataType, T.ArrayType):
        return F.array_contains("tags", F.lit(tag))
    # A list from the front matter is kept as JSON: its items are compared whole.
    listed = F.from_json("tags", "array<string>")
    return F.when(F.startswith("tags", F.lit("[")) & listed.isNotNull(), F.array_contains(listed, F.lit(tag))).otherwise(
        F.contains("tags", F.lit(tag))
    )


def local_filter(
    chunks: DataFrame,
    doc_level: str | None = None,
    doc_name: str | None = None,
    tags: str | None = None,
    section_prefix: str | None = None,
    source_prefix: str | None = None,
) -> DataFrame:
    """Equality on level and name, real prefixes, and a tag test that a missing value passes."""
    out = chunks
    if doc_level:
        out = out.where(F.col("doc_level") == doc_level)
    if doc_name:
        out = out.where(F.col("doc_name") == doc_name)
    if tags:
        out = out.where(F.col("tags").isNull() | _has_tag(chunks, tags))
    if section_prefix:
        out = out.where(F.startswith(text("section_id"), F.lit(section_prefix)))
    if source_prefix:
        out = out.where(F.startswith(text("source_path"), F.lit(source_prefix)))
    return out


# --- nearest vectors -----------------------------------------------------------------


def _nearest(ids: np.ndarray, distances: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n smallest by (distance, id); all ties at the border are compared by id."""
    if len(ids) > n:
        border = np.partition(distances, n - 1)[n - 1]
        near = distances <= border
        ids, distances = ids[near], distances[near]
    order = np.lexsort((ids, distances))[:n]
    return ids[order], distances[order]


def _units(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of length one; a zero vector stays zero."""
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    sizes = np.linalg.norm(vectors, axis=1)
    return np.divide(vectors, sizes[:, None], out=np.zeros_like(vectors), where=sizes[:, None] > 0)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each width, with their unit vectors."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        own = batch.filter(pa.array(widths == width))
        yield width, own, _units(own.column("v"), width)


def _apart(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0))


# A row without a direction, or of a width without a pivot, belongs to no pivot.
NO_PIVOT = -1


def _pivots(held: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Unit vectors drawn from the corpus, by width: at most ``PIVOTS`` come to the driver."""
    wanted = min(PIVOTS, rows // LEAST_ROWS)
    if wanted < 2:
        return {}
    drawn = held.select("v").orderBy(F.xxhash64(F.monotonically_increasing_id())).limit(wanted).collect()
    found: dict[int, list] = {}
    for r in drawn:
        if any(r.v):
            found.setdefault(len(r.v), []).append(r.v)
    return {w: np.unique(_units(pa.array(v, pa.list_(pa.float64())), w), axis=0) for w, v in found.items()}


def _blocks(held: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each row with its nearest ``pivot`` and the distance ``apart``, written once."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, units in _by_width(batch):
                pivot, apart = np.full(len(own), NO_PIVOT, np.int32), np.zeros(len(own))
                if width in pivots:
                    far = _apart(units, pivots[width])
                    directed = units.any(axis=1)
                    pivot = np.where(directed, far.argmin(axis=1), NO_PIVOT).astype(np.int32)
                    apart = np.where(directed, far.min(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pivot), pa.array(apart)], names=[*own.schema.names, "pivot", "apart"])

    kind = held.schema["id"].dataType.simpleString()
    placed = held.select("id", "v", "width").mapInArrow(place, f"id {kind}, v array<double>, width int, pivot int, apart double")
    return materialize(placed.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))


class _Sizes:
    """What is known of the blocks around each pivot: rows, radius, and parts."""

    def __init__(self, blocks: DataFrame, pivots: dict[int, np.ndarray], rows: int, tasks: int):
        self.pivots = pivots
        self.of: dict[int, dict[int, tuple[int, float, int]]] = {}
        # One row per pivot, and per width.
        for r in blocks.groupBy("width", "pivot").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect():
            parts = max(1, -(-r.n // BLOCK_ROWS), min(tasks * r.n // max(1, rows), r.n // LEAST_ROWS))
            self.of.setdefault(r.width, {})[r.pivot] = (r.n, r.radius, parts)

    def parts(self) -> Column:
        """The number of parts of a row's block."""
        large = [(w, p, x[2]) for w, own in self.of.items() for p, x in own.items() if x[2] > 1]
        if not large:
            return F.lit(1)
        known = F
        for w, p, parts in large:
            known = known.when((F.col("width") == w) & (F.col("pivot") == p), parts)
        return known.otherwise(1)

    def visits(self, width: int, units: np.ndarray, n: int) -> np.ndarray:
        """Which pivots' blocks (in order of ``of``) each query may have one of its n nearest in.

        The blocks with the smallest distance plus radius that hold n rows between them
        bound the n-th distance; a block is left out if none of its rows can be so near.
        """
        names = list(self.of[width])
        out = np.ones((len(units), len(names)), dtype=bool)
        around = [i for i, p in enumerate(names) if p != NO_PIVOT]
        if not around:
            return out
        held, radius = (np.array([self.of[width][names[i]][k] for i in around]) for k in (0, 1))
        far = _apart(units, self.pivots[width][[names[i] for i in around]])
        most = far + radius
        order = np.argsort(most, axis=1)
        enough = np.cumsum(held[order], axis=1) >= n
        at = enough.argmax(axis=1)
        bound = np.where(enough.any(axis=1), np.take_along_axis(most, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], np.inf)
        out[:, around] = (far - radius <= bound[:, None] + SLACK) | ~units.any(axis=1)[:, None]
        return out


def placed_queries(asked: DataFrame, sizes: _Sizes, n: int) -> DataFrame:
    """Each query once for every block that it has to be compared with: ``q``, ``v``, ``width``, ``pivot``, ``part``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, units in _by_width(batch):
                if width not in sizes.of:
                    continue
                query, block = np.nonzero(sizes.visits(width, units, n))
                names = np.array(list(sizes.of[width]), dtype=np.int32)
                parts = np.array([x[2] for x in sizes.of[width].values()])[block]
                query, block = np.repeat(query, parts), np.repeat(block, parts)
                part = np.arange(len(query)) - np.repeat(np.cumsum(parts) - parts, parts)
                for i in range(0, len(query), 4096):
                    here = own.take(pa.array(query[i : i + 4096]))
                    more = [pa.array(names[block[i : i + 4096]]), pa.array(part[i : i + 4096].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*here.columns, *more], names=[*here.schema.names, "pivot", "part"])

    kind = asked.schema["q"].dataType.simpleString()
    return asked.select("q", "v", "width").mapInArrow(place, f"q {kind}, v array<double>, width int, pivot int, part int")


def _meet(batches: Iterator[pa.RecordBatch], n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The n nearest rows of a block for each of its queries; a block's rows come before its queries."""
    here, ids, held = None, [], []
    for batch in batches:
        places = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "pivot", "part", "asks")]
        new = np.zeros(max(0, len(batch) - 1), dtype=bool)
        for p in places:
            new |= p[1:] != p[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            *place, asks = (p[a].item() for p in places)
            if place != here:
                here, ids, held = place, [], []
            units = _units(batch.column("v").slice(a, b - a), place[0])
            if not asks:
                own = batch.column("id").slice(a, b - a)
                ids.append(own.to_numpy() if pa.types.is_integer(own.type) else np.array(own.to_pylist()))
                held.append(units)
                continue
            if not held:
                continue
            ids, held = [np.concatenate(ids)], [np.concatenate(held)]
            keys = batch.column("q").slice(a, b - a)
            for i in range(0, len(keys), QUERIES_AT_ONCE):
                near = np.round(1.0 - units[i : i + QUERIES_AT_ONCE] @ held[0].T, DISTANCE_DIGITS)
                best = [_nearest(ids[0], d, n) for d in near]
                at = np.repeat(np.arange(i, i + len(best)), [len(x) for x, _ in best])
                columns = [keys.take(pa.array(at)), pa.array(np.concatenate([x for x, _ in best]).tolist(), schema.field("id").type)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([d for _, d in best]))], schema=schema)


def vector_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    n: int = 80,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """The ``n`` nearest vectors per query by cosine distance: (query_id, id, distance, rank).

    Exact. Vectors gather in blocks around pivots drawn from them. A query is sent to
    those blocks only that may hold one of its n nearest, by the triangle inequality;
    rows move once, and a task takes the queries of its block as they come. Each block
    keeps its own best, and those meet in two rounds, so no task sees more than a share
    of them. A query is compared with the vectors of its own width; null vectors and null
    components take no part. A zero vector is at distance 1. Ties by id.
    """

    def usable(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
        rows = df.select(named(key).alias(name), named(vector).cast("array<double>").alias("v"))
        return rows.where(F.forall("v", lambda x: x.isNotNull()) & (F.size("v") > 0)).withColumn("width", F.size("v"))

    held, asked = usable(corpus, id_col, vector_col, "id"), usable(queries, query_id, query_vector, "q")
    rows = held.count()
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pivots = _pivots(held, rows)
    blocks = _blocks(held, pivots)
    sizes = _Sizes(blocks, pivots, rows, tasks)
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["q"].dataType),
            T.StructField("id", held.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    place = ["width", "pivot", "part"]
    dealt = blocks.withColumn("part", F.pmod("deal", sizes.parts()).cast("int")).select(*place, F.lit(False).alias("asks"), "id", "v")
    placed = placed_queries(asked, sizes, n).select(*place, F.lit(True).alias("asks"), "q", "v")
    both = dealt.unionByName(placed, allowMissingColumns=True)
    met = both.repartition(tasks, *place).sortWithinPartitions(*place, "asks")
    found = met.mapInArrow(lambda b: _meet(b, n, arrow), schema)
    share = F.pmod(F.xxhash64("id"), F.lit(MERGE_FANOUT))
    nearest = ("distance", "id")
    first = found.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", share).orderBy(*nearest)))
    second = first.where(F.col("__r") <= n).drop("__r")
    ranked = second.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest)))
    return ranked.where(F.col("rank") <= n)


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    filters: dict[str, str] | None = None,
    top_n: int = 80,
    top_k: int = 10,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """Top ``top_n`` after the store's filter, the local filter on those, then the first ``top_k``.

    As the local filter comes after the ranking, fewer than ``top_k`` may remain.
    """
    kept = retrieve_all(corpus, queries, filters, top_n, id_col, vector_col, query_id, query_vector)
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)


def retrieve_all(
    corpus: DataFrame,
    queries: DataFrame,
    filters: dict[str, str] | None = None,
    top_n: int = 80,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """All that pass both filters: what a reranker is given."""
    filters = filters or {}
    near = materialize(vector_top_k(pre_filter(corpus, **filters), queries, top_n, id_col, vector_col, query_id, query_vector))
    # The few ids found pick their rows before any text is carried along.
    wanted = near.select("id").distinct()
    about = corpus.drop(vector_col).withColumnRenamed(id_col, "id").join(wanted, "id", "left_semi")
    return local_filter(near.join(about, "id"), **filters)


def rerank(
    candidates: DataFrame,
    scorer: Callable[[Column, Column], Column] | None,
    k: int,
    query_text: str = "query_text",
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` best per query by a scorer of (query, text); without one, by vector rank."""
    if scorer is None:
        order = Window.partitionBy("query_id").orderBy("rank")
        return candidates.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    scored = candidates.withColumn("rerank_score", scorer(F.col(query_text), F.col(text_col)).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rerank_score", F.lit(0.0)).desc(), "rank")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


# --- context ---------------------------------------------------------------------------


def context_block(df: DataFrame, text_col: str = "text") -> Column:
    """Source line and text of one result."""

    def shown(name: str) -> Column:
        value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(value, F.lit("")), F.lit("-"))

    name = F.coalesce(F.col("file_name"), F.lit("None")) if "file_name" in df.columns else F.lit("None")
    ocr = F.coalesce(F.col("ocr_used").cast("boolean"), F.lit(False)) if "ocr_used" in df.columns else F.lit(False)
    return F.concat(
        F.lit("[SOURCE: "),
        F.concat_ws(
            " | ",
            name,
            shown("doc_level"),
            shown("section_id"),
            shown("req_id"),
            F.concat(F.lit("page "), shown("page_number")),
            shown("heading_path"),
            F.concat(F.lit("ocr_used="), F.when(ocr, "True").otherwise("False")),
        ),
        F.lit("]\n"),
        clean_str(_col(text_col)),
    )


def build_context(results: DataFrame, text_col: str = "text", position: str = "position") -> DataFrame:
    """One context text per query: its results' blocks in order (at most top_k of them)."""
    blocks = results.select("query_id", F.struct(F.col(position).alias("p"), context_block(results, text_col).alias("b")).alias("x"))
    return blocks.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context")
    )


def collection_stats(chunks: DataFrame, limit: int = 5, id_col: str = "id", skip: Sequence[str] = ("text", "embedding")) -> DataFrame:
    """Number of vectors, the metadata keys that are populated, and the first rows by id."""
    keys = [c for c in chunks.columns if c not in (id_col, "extra", *skip)]
    seen = chunks.agg(F.count("*").alias("n"), *[F.max(F.col(c).isNotNull()).alias(c) for c in keys])
    total = seen.select(F.lit("total").alias("item"), F.lit("vectors").alias("name"), F.col("n").cast("string").alias("value"))
    populated = seen.select(
        F.inline(
            F.array(*[F.struct(F.lit("key").alias("item"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in keys])
        )
    ).where("value = 'true'")
    frames = [total, populated]
    if "extra" in chunks.columns:
        extra = chunks.select(F.explode(F.map_keys("extra")).alias("name")).distinct()
        frames.append(extra.select(F.lit("key").alias("item"), "name", F.lit("true").alias("value")))
    sample = chunks.orderBy(id_col).limit(limit)
    shown = F.substring(text("text"), 1, 240) if "text" in chunks.columns else F.lit("")
    frames.append(sample.select(F.lit("sample").alias("item"), F.col(id_col).cast("string").alias("name"), clean_str(shown).alias("value")))
    return union_all(frames)
