"""Best-fit packing of documents into sequences, with conflicts.

A bin (a training sequence) holds ``CAPACITY`` words. It never holds two pieces of
one source, nor two documents of one duplicate cluster. Open bins are kept in the order of the room they have
left; a piece looks up the first bin with room enough and goes on to the next
roomier one until it finds one without a conflict: the tightest compatible bin.
Each bin carries a bitmap of the sources and one of the clusters in it, so that a
test is two bit operations. Pieces come largest first. A document longer than a
bin fills whole bins alone; what is left over is packed like any other piece.

Scale: documents are dealt at random to groups of about ``GROUP`` and each group is
packed by itself: a task holds a few thousand narrow rows whatever the corpus, and
a source or cluster with a third of all rows is spread over all groups. Clusters of
near copies are worked out over the whole corpus and meet narrow rows without texts.

Defined results: a document without words has one row without a bin; a null source
or cluster conflicts with nothing; repeated rows are documents of their own (and of
one cluster); ties go to the bin opened first; no rows give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.llm.jaccard_join import near_duplicates
from tracegrid.llm.words import word_count

CAPACITY = 2048
GROUP = 4096


def pack(
    sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, start: int = 0
) -> tuple[list[int], list[int], int]:
    """Bin and place in it of each piece, given largest first; sizes are from 1 to ``capacity``."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    open_bins: list[tuple[int, int]] = []  # (room left, bin), in order
    has_sources: dict[int, int] = {}
    has_clusters: dict[int, int] = {}
    bins, places = [], []
    opened = start
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (has_sources[open_bins[at][1]] & s or has_clusters[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            room, bin_no = open_bins.pop(at)
        else:
            room, bin_no = capacity, opened
            opened += 1
            has_sources[bin_no] = has_clusters[bin_no] = 0
        has_sources[bin_no] |= s
        has_clusters[bin_no] |= c
        bins.append(bin_no)
        places.append(capacity - room)
        if room > size:
            insort(open_bins, (room - size, bin_no))
    return bins, places, opened


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    """Pack the documents of one group: rows (group, id, source, cluster, size, drawn)."""
    rows = table.to_pydict()
    n = len(rows["size"])
    group = rows["group"][0] << 24
    sizes = np.array(rows["size"], dtype=np.int64)
    whole, rest = sizes // capacity, sizes % capacity
    out: list[tuple] = [(i, 0, 0, 0, None, None) for i in np.flatnonzero(sizes == 0).tolist()]
    opened = 0
    for i in np.flatnonzero(whole).tolist():
        for piece in range(int(whole[i])):
            out.append((i, piece, piece * capacity, capacity, group + opened, 0))
            opened += 1
    drawn = np.array(rows["drawn"], dtype=np.int64)
    order = [i for i in np.lexsort((drawn, -rest)).tolist() if rest[i]]
    pick = lambda name: [rows[name][i] for i in order]
    bins, places, _ = pack(rest[order].tolist(), pick("source"), pick("cluster"), capacity, opened)
    for i, b, p in zip(order, bins, places, strict=True):
        out.append((i, int(whole[i]), int(whole[i]) * capacity, int(rest[i]), group + b, p))
    columns = list(zip(*out, strict=True)) if n else [[]] * 6
    return pa.table(
        {
            "id": table.column("id").combine_chunks().take(pa.array(columns[0], pa.int64())),
            "piece": pa.array(columns[1], pa.int32()),
            "from_word": pa.array(columns[2], pa.int64()),
            "n_words": pa.array(columns[3], pa.int64()),
            "bin": pa.array(columns[4], pa.int64()),
            "place": pa.array(columns[5], pa.int64()),
        }
    )


def _text_key(id_col: str, text_col: str) -> Column:
    """A document's id and the hash of its text: the same in every scan, and equal for equal texts only."""
    return F.struct(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("text"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The cluster of near copies of each distinct ``key`` (id and text)."""
    keyed = docs.select(_text_key(id_col, text_col).alias("key"), named(text_col).alias("text"))
    found = near_duplicates(keyed, "key", "text")
    return found.groupBy("key").agg(F.min(F.xxhash64("component_id")).alias("cluster"))


def best_fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    copies: DataFrame | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: the document's id, ``piece``, ``from_word``, ``n_words``, ``bin``, ``place`` (words before it).

    ``cluster`` tells duplicates apart; by default equal texts form one. ``copies``
    (``near_copies``) gives the clusters instead.
    """
    cluster = F.xxhash64(named(text_col)) if cluster is None else cluster
    groups = max(1, -(-docs.count() // GROUP))
    drawn = F.xxhash64(named(id_col), F.monotonically_increasing_id())
    rows = docs.select(
        named(id_col).alias("id"),
        named(source_col).alias("source"),
        F.when(named(text_col).isNotNull(), cluster).alias("cluster"),
        word_count(named(text_col)).alias("size"),
        drawn.alias("drawn"),
        *([] if copies is None else [_text_key(id_col, text_col).alias("key")]),
    ).withColumn("group", F.pmod("drawn", F.lit(groups)).cast("long"))
    if copies is not None:
        rows = rows.drop("cluster").join(copies, "key", "left").select("id", "source", "cluster", "size", "drawn", "group")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, from_word bigint, n_words bigint, bin bigint, place bigint"
    packed = rows.groupBy("group").applyInArrow(lambda t: _pack_group(t, capacity), schema)
    return packed.withColumnRenamed("id", id_col)
