"""Exact top-k by inner product over a bit-sliced index.

Vectors are whole numbers, floor(64 x) of each component. A block of rows keeps,
for every component, one bitmap per binary digit (a slice). The score of a query
against all rows of a block is a sum of slices with weights that are powers of
two: for each set digit of a query component, the component's slices, moved up
by that digit's place (complemented where the query is negative). Slices of equal
weight are summed by full adders, three bitmaps at a time, 64 rows a word. The
result is again bit-sliced, and the best rows are found from the highest slice
down; rows that tie at the boundary are resolved exactly, by score and then id.

Scale: rows are dealt to blocks of bounded size and move once; a task builds the
index of its block and then takes the queries as they come, a batch at a time. Each
block keeps its own ``k`` best per query, and only those are shuffled again.

Defined results: vectors that are null or hold a null or non-finite component
take no part; only vectors of equal width are compared; a row is no candidate for a
query of its own id; equal queries are answered once; no rows give no rows. Scores
are exact: vectors so long that an inner product might not fit in 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions.text import named

SCALE = 64
# No inner product of vectors of at most this squared length leaves 64 bits, nor a component 32.
LONGEST = float(1 << 62)
BLOCK_ROWS = 16384


class Slices:
    """The bit slices of a block of rows (n x width whole numbers)."""

    def __init__(self, rows: np.ndarray):
        self.n, width = rows.shape
        self.low = rows.min(axis=0) if self.n else np.zeros(width, np.int64)
        raised = (rows - self.low).astype(np.uint64)
        self.digits = [int(raised[:, d].max(initial=0)).bit_length() for d in range(width)]
        self.words = -(-self.n // 64)
        self.slices = [[self.bitmap((raised[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(n)] for d, n in enumerate(self.digits)]
        self.turned = [[~s for s in own] for own in self.slices]
        self.all = self.bitmap(np.ones(self.n, np.uint8))

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, dtype=np.uint8)
        out[: self.n] = bits
        return np.packbits(out, bitorder="little").view(np.uint64)

    def score(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the scores (all raised by one constant)."""
        columns: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            own, q = (self.slices[d], q) if q >= 0 else (self.turned[d], -q)
            for place in range(q.bit_length()):
                if q >> place & 1:
                    while len(columns) < place + len(own):
                        columns.append([])
                    for b, s in enumerate(own):
                        columns[place + b].append(s)
        out, w = [], 0
        while w < len(columns):
            here = columns[w]
            up: list[np.ndarray] = []
            while len(here) > 2:
                a, b, c = here.pop(), here.pop(), here.pop()
                x = a ^ b
                carry = a & b
                carry |= x & c
                x ^= c
                up.append(carry)
                here.append(x)
            if len(here) == 2:
                up.append(here[0] & here[1])
                here = [here[0] ^ here[1]]
            if up:
                if w + 1 == len(columns):
                    columns.append([])
                columns[w + 1] += up
            out.append(here[0] if here else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def rows_of(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=self.n))

    def best(self, score: list[np.ndarray], k: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are surely among the k best, and those tied for the places left."""
        sure, tied = np.zeros(self.words, np.uint64), among
        for s in reversed(score):
            high = tied & s
            both = sure | high
            n = int(np.bitwise_count(both).sum())
            if n > k:
                tied = high
            else:
                sure, tied = both, tied & ~s
                if n == k:
                    return self.rows_of(sure), np.zeros(0, np.int64)
        return self.rows_of(sure), self.rows_of(tied)


class Block:
    """The index of some rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.index = ids, rows, Slices(rows)
        self.place: dict[int, list[int]] = {}
        for i, x in enumerate(ids.tolist()):
            self.place.setdefault(x, []).append(i)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple]:
        """For each query: (its position, ids, scores) of its k best rows, ties to the smaller id."""
        for i, (own, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
            among = self.index.all
            if own in self.place:
                mask = np.ones(self.index.n, np.uint8)
                mask[self.place[own]] = 0
                among = among & self.index.bitmap(mask)
            sure, tied = self.index.best(self.index.score(query), k, among)
            left = k - len(sure)
            tied = tied[np.lexsort((tied, self.ids[tied]))[:left]]
            chosen = np.concatenate([sure, tied]).astype(np.int64)
            yield i, self.ids[chosen], self.rows[chosen] @ query


def _scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def _fit(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def whole_numbers(vector: Column) -> Column:
    """floor(64 x) of each component as a double; null for a vector that takes no part."""
    return F.when(_fit(vector), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, np.ndarray, np.ndarray]]:
    """Runs of equal block and kind: ((width, block), asks, ids, vectors)."""
    for batch in batches:
        width, block, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "block", "asks"))
        ids = batch.column("id").to_numpy()
        new = np.flatnonzero((width[1:] != width[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
        bounds = [0, *new.tolist(), len(batch)] if len(batch) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = batch.column("ints").slice(a, b - a).flatten().to_numpy().reshape(b - a, int(width[a])).astype(np.int64)
            yield (int(width[a]), int(block[a])), bool(asks[a]), ids[a:b], own


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` best rows of each query: ``query_id``, ``rank``, the row's id, ``score``."""
    vector = named(vector_col)
    rows = vectors.where(named(id_col).isNotNull() & _fit(vector)).select(
        named(id_col).cast("long").alias("id"), vector.alias("vector"), F.size(vector).alias("width"), is_query.alias("asks")
    )
    length = F.aggregate(_scaled(F.col("vector")), F.lit(0.0), lambda a, x: a + x * x)
    n, longest = rows.agg(F.count("*"), F.max(length)).first()
    if longest is not None and not longest < LONGEST:
        raise ValueError(f"vectors as long as {longest**0.5 / SCALE:g}: an inner product may not fit in 64 bits")
    rows = rows.withColumn("ints", whole_numbers(F.col("vector"))).drop("vector")
    blocks = max(1, -(-n // BLOCK_ROWS))
    # Rows of one id are spread too: which block a row is in doesn't change the result.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    queries = rows.where("asks").select("id", "ints", "width").distinct()
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = ["width", "block", "asks", "id", "ints"]
    both = dealt.withColumn("asks", F.lit(False)).select(*columns).unionByName(queries.withColumn("asks", F.lit(True)).select(*columns))
    shuffles = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Within a block its rows come first, then the queries.
    tasks = both.repartition(max(shuffles, min(blocks, 1 << 15)), "width", "block").sortWithinPartitions("width", "block", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, index = None, [], None
        for place, asks, ids, own in _held(batches):
            if place != here:
                here, held, index = place, [], None
            if not asks:
                held.append((ids, own))
                continue
            if index is None and held:
                index, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True))), []
            if index is None:
                continue
            out: list[list] = [[], [], [], []]
            for i, found, scores in index.best(ids, own, k):
                out[0].append(np.full(len(found), ids[i]))
                out[1].append(np.full(len(found), _digest(own[i])))
                out[2].append(found)
                out[3].append(scores)
            arrays = [pa.array(np.concatenate(o), pa.int64()) for o in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "query", "id", "score"])

    found = tasks.mapInArrow(meet, "query_id bigint, query bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _digest(query: np.ndarray) -> int:
    """Tells apart two queries of one id."""
    return int.from_bytes(hashlib.blake2b(query.tobytes(), digest_size=8).digest(), "little", signed=True)
