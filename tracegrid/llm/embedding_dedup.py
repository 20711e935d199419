"""Near-duplicate vectors by collision-counting projections.

Two vectors with a cosine of at least ``c`` have unit vectors at most
``d = sqrt(2 - 2c)`` apart, so their projections on a random direction differ by a
normal variate of at most that deviation. Each vector gets ``PROJECTIONS`` of them.
A pair collides in one where the one lies in the window of +-``WINDOW`` d around the
other; it is verified by its cosine, in double precision, where it collides often
enough: the count that a pair at the threshold itself reaches with probability
``COUNT_RECALL``.

Counting every pair would take time with the square of the table. So vectors meet in
cells first: for each of ``tables`` numberings, ``lead`` further projections are cut into
strips of ``STRIP`` d from a random offset, and vectors of the same strips share a cell.
``lead`` grows with the logarithm of the number of rows, so that cells stay about as
large; ``tables`` follows from it so that a pair at the threshold shares a cell
with probability ``CELL_RECALL``. Within a cell every projection is sorted, windows
become ranges of ranks, and collisions are counted pair by pair. A pair that meets in
several cells belongs to the first.

Scale: equal vectors form one class and go on as one row with its number of copies,
so copies cost nothing further. A cell is one task; one far above ``CELL`` rows is dealt
in parts, and each pair of parts is a task. No pairs leave a task: it returns how many
vectors each of its own is linked with, and edges enough to connect what is linked.

Found links are exact (none below the threshold); a link is missed with probability
at most ``1 - CELL_RECALL * COUNT_RECALL``, at the threshold itself.

Defined results: vectors that are null, zero, empty or hold a null or non-finite
component link with nothing; only vectors of equal width are compared; repeated rows are
vectors of their own; a component whose ids are all null has a null id; no rows give
no rows. Vectors count as equal when two 64-bit hashes agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.llm.graph import components
from tracegrid.operators.storage import materialize

COSINE = 0.9
SEED = 13
PROJECTIONS = 48
WINDOW, STRIP = 1.5, 5.0
COUNT_RECALL, CELL_RECALL = 0.998, 0.99
# Rows that a cell is meant to have; one with more than some times as many is dealt in parts.
CELL = 2048
LARGE = 4
# Pairs whose counts are held at a time, and pairs verified at a time.
COUNTED, VERIFIED = 1 << 22, 1 << 15


def within(width: float) -> float:
    """Probability that a normal variate lies within +-``width`` deviations."""
    return math.erf(width / math.sqrt(2))


def same_strip(width: float) -> float:
    """Probability that two points whose distance is a normal variate share a strip of ``width`` deviations."""
    return within(width) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


def calibrated_count(trials: int, p: float, recall: float) -> int:
    """The largest count that as many trials with probability ``p`` reach with probability ``recall``."""
    reached, count = 0.0, trials + 1
    while reached < recall:
        count -= 1
        reached += math.comb(trials, count) * p**count * (1 - p) ** (trials - count)
    return count


class Plan:
    """What the number of rows and the threshold decide."""

    def __init__(self, rows: int, cosine: float, cell: int = CELL):
        self.apart = math.sqrt(2 - 2 * cosine)
        self.least = calibrated_count(PROJECTIONS, within(WINDOW), COUNT_RECALL)
        # Vectors without likeness are about sqrt(2) apart.
        stray = same_strip(STRIP * self.apart / math.sqrt(2))
        self.lead = max(0, math.ceil(math.log(max(1, rows) / cell) / -math.log(stray)))
        meets = same_strip(STRIP) ** self.lead
        self.tables = 1 if meets >= CELL_RECALL else math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - meets))

    def directions(self, width: int, count: bool) -> np.ndarray:
        """Random directions: those that are counted, or those that lead to the cells."""
        rng = np.random.default_rng([SEED, width, count])
        return rng.standard_normal((width, PROJECTIONS if count else self.tables * self.lead))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table, as a hash."""
        n, width = unit.shape
        strip = STRIP * self.apart
        offsets = np.random.default_rng([SEED, width, 2]).random(self.tables * self.lead) * strip
        strips = np.floor((unit @ self.directions(width, False) + offsets) / strip).astype(np.int64).reshape(n, self.tables, self.lead)
        out = np.broadcast_to(np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width), (n, self.tables)).copy()
        for k in range(self.lead):
            out = (out ^ strips[:, :, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, also of very large and very small ones."""
    scaled = vectors.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True, initial=0)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Windows:
    """Sorted projections of some vectors, and the ranks that fall in the window around each of others."""

    def __init__(self, asking: np.ndarray, held: np.ndarray, width: float):
        self.kind = np.uint16 if len(held) < 1 << 16 else np.uint32
        order = np.argsort(held, axis=0, kind="stable")
        ordered = np.take_along_axis(held, order, axis=0)
        self.rank = np.empty(held.shape, dtype=self.kind)
        np.put_along_axis(self.rank, order, np.arange(len(held), dtype=self.kind)[:, None], axis=0)
        low, high = np.empty(asking.shape, dtype=np.int64), np.empty(asking.shape, dtype=np.int64)
        for k in range(held.shape[1]):
            low[:, k] = np.searchsorted(ordered[:, k], asking[:, k] - width, side="left")
            high[:, k] = np.searchsorted(ordered[:, k], asking[:, k] + width, side="right")
        self.low, self.size = low.astype(self.kind), (high - low).astype(self.kind)
        self.rank = np.ascontiguousarray(self.rank.T)

    def counts(self, a: int, b: int, first: int) -> np.ndarray:
        """Collisions of those asking from ``a`` to ``b`` with the held ones from ``first`` on."""
        out = np.zeros((b - a, self.rank.shape[1] - first), dtype=np.uint8)
        for k, rank in enumerate(self.rank):
            # A rank below the window wraps round to a large number.
            out += (rank[None, first:] - self.low[a:b, k, None]) < self.size[a:b, k, None]
        return out


def links_between(a: np.ndarray, b: np.ndarray | None, plan: Plan, cosine: float, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (rows of ``a``, rows of ``b``) in pieces; without ``b`` those within ``a``, each once.

    ``skip`` tells of pairs which of them belong elsewhere.
    """
    directions = plan.directions(a.shape[1], True)
    other = a if b is None else b
    windows = Windows(a @ directions, other @ directions, WINDOW * plan.apart)
    at = 0
    while at < len(a):
        first = at if b is None else 0
        upto = min(len(a), at + max(1, COUNTED // max(1, len(other) - first)))
        i, j = np.nonzero(windows.counts(at, upto, first) >= plan.least)
        i, j = i + at, j + first
        if b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), VERIFIED):
            x, y = i[s : s + VERIFIED], j[s : s + VERIFIED]
            if skip is not None:
                own = ~skip(x, y)
                x, y = x[own], y[own]
            linked = np.einsum("ij,ij->i", a[x], other[y]) >= cosine
            if linked.any():
                yield x[linked], y[linked]
        at = upto


def _connect(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each pair; ``root`` names each row's smallest row at the end."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _met(rows: list[dict], plan: Plan, cosine: float) -> pa.RecordBatch | None:
    """Links of one task: per class the vectors linked, and edges."""
    first = rows[0]
    table, i, j = first["table"], first["i"], first["j"]
    keys = np.concatenate([r["key"] for r in rows])
    copies = np.concatenate([r["copies"] for r in rows])
    parts = np.concatenate([r["part"] for r in rows])
    unit = units(np.concatenate([r["vector"] for r in rows]))
    cells = np.concatenate([r["cells"] for r in rows])
    left = np.flatnonzero(parts == i)
    right = left if i == j else np.flatnonzero(parts == j)
    earlier = cells[:, :table]

    def skip(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (earlier[left[x]] == earlier[right[y]]).any(axis=1)

    links, root = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
    for x, y in links_between(unit[left], None if i == j else unit[right], plan, cosine, skip if table else None):
        x, y = left[x], right[y]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        _connect(root, x, y)
    use = np.flatnonzero(links)
    if not len(use):
        return None
    return pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array(links[use]), pa.array(keys[root[use]])], names=["key", "links", "other"])


def takes_part(vector: Column) -> Column:
    """Whether a vector has a direction: finite, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, cell: int = CELL
) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` (the least id reachable), ``kept``."""
    vector = named(vector_col)
    hashes = F.struct(F.xxhash64(vector).alias("x"), F.xxhash64(F.lit(SEED), vector).alias("y"))
    rows = vectors.select(
        named(id_col).alias("id"), vector.alias("vector"), F.when(takes_part(vector), hashes).alias("hash")
    )
    plan = Plan(vectors.count(), cosine, cell)
    kind = vectors.schema[vector_col].dataType.simpleString()
    id_kind = vectors.schema[id_col].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for width in np.unique(sizes):
                of_width = batch.filter(pa.array(sizes == width))
                cells = plan.cells(units(_rows_of(of_width.column("vector"), int(width))))
                bounds = np.arange(len(of_width) + 1, dtype=np.int32) * plan.tables
                own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*of_width.columns, own], names=[*of_width.schema.names, "cells"])

    schema = f"hash struct<x:bigint,y:bigint>, vector {kind}, copies bigint, least {id_kind}, cells array<bigint>"
    grouped = rows.where("hash is not null").groupBy("hash", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = materialize(grouped.mapInArrow(placed, schema).withColumn("key", F.monotonically_increasing_id()))

    most = LARGE * cell
    # Cells of one class have nothing to join; large ones are dealt in parts that meet in pairs.
    sizes = classes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = sizes.select("cell", F.when(F.col("rows") > most, F.ceil(2 * F.col("rows") / most)).otherwise(1).cast("int").alias("parts"))
    dealt = classes.select("key", "copies", "vector", "cells", F.posexplode("cells").alias("table", "cell")).join(sizes, "cell")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("*", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
    shuffles = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = ["cell", "i", "j"]
    tasks = dealt.select(*task, "table", "part", "key", "copies", "vector", "cells").repartition(shuffles, *task).sortWithinPartitions(*task)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []
        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in (*task, "table", "part", "key", "copies")}
            cells = _rows_of(batch.column("cells"), plan.tables)
            new = np.zeros(len(batch), dtype=bool)
            for c in task:
                new[1:] |= columns[c][1:] != columns[c][:-1]
            bounds = [0, *np.flatnonzero(new).tolist(), len(batch)] if len(batch) else []
            for a, b in zip(bounds[:-1], bounds[1:]):
                now = tuple(columns[c][a] for c in task)
                if now != here:
                    if rows and (out := _met(rows, plan, cosine)):
                        yield out
                    here, rows = now, []
                row = {c: int(columns[c][a]) for c in ("table", "i", "j")}
                row |= {c: columns[c][a:b] for c in ("key", "copies", "part")}
                own = batch.column("vector").slice(a, b - a)
                rows.append(row | {"cells": cells[a:b], "vector": _rows_of(own, len(own[0]))})
        if rows and (out := _met(rows, plan, cosine)):
            yield out

    links = materialize(tasks.mapInArrow(meet, "key bigint, links bigint, other bigint"))
    linked = links.groupBy("key").agg(F.sum("links").alias("links"))
    connected = components(links.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    known = classes.select("key", "hash", "copies", "least").join(linked, "key", "left").join(connected, "key", "left")
    known = known.withColumn("component", F.coalesce("component", "key"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = known.join(smallest, "component").select(
        "hash", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    narrow = rows.select("id", "hash")
    found = narrow.where("hash is not null").join(by_class, "hash").select("id", "n_links", "component_id")
    alone = narrow.where("hash is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
