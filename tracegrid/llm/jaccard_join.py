"""N-gram Jaccard join over a whole corpus, by prefix trees.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with the same
   set form one class; only classes go on, so copies cost nothing further.
2. The tokens meet by hash. A token held by one class only cannot be shared, so
   each class gets back just the tokens it shares, with the number of classes
   that hold them; that number, then the token, is the global order. A class that
   shares too few tokens to reach the threshold is out.
3. Of a similar pair, the sets must share a token among the first of the global
   order, rarest first (prefix filter). Classes that share such a token fall in one
   cluster; every similar pair lies inside a cluster.
4. Each cluster is joined in a prefix tree (``trie_join``). A cluster too large for
   one task is dealt in parts: first each part with part 0, then, if that has not
   connected the cluster, every other pair of parts.
5. Links connect classes; a document's component is the smallest id in it.

What moves: every token once (6 bytes and its share of a pack), shared tokens
once more. A pack is all that goes from one run of texts to one task, so a class
is named once there, however many of its tokens go along. The sets of classes that stay candidates move once, or once per part
of an oversized cluster. Nothing is broadcast or collected.

Defined results: null, empty or blank texts have an empty set, link with nothing
and are their own component; a text of fewer than five words is one shingle of
all its words; equal texts and repeated rows share a component; a null id stands
for itself only where its whole component has no other id; no rows give no rows.
Texts count as equal sets when 64-bit hashes and set sizes agree, which may join
two different texts by chance once in some billions of distinct texts.
In an intersection two different shingles count as one where 48 bits and the pack
agree: for two texts of 300 words, by chance once in some 10**9 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracegrid.functions.text import named
from tracegrid.llm.graph import components
from tracegrid.llm.shingles import scramble, shingle_sets
from tracegrid.llm.trie_join import trie_links
from tracegrid.operators.storage import materialize

WIDTH = 5
# Threshold as a fraction, so that it is tested in whole numbers.
NUM, DEN = 3, 4
# A cluster up to this many sets is joined in one task; a larger one in parts of half as many.
CLUSTER = 4000

# A token keeps this many bits and the number of its pack.
TOKEN_BITS = np.uint64(48)
# Odd, so that the size changes every key.
BASE_OF_SIZE = 0xD1342543DE82EF95

# Rows are either texts (id, key, n) or packs of tokens: for the classes ``keys`` of ``sizes``, ``counts`` tokens each.
PACKED = ("keys", "sizes", "counts", "tokens", "held")
PACK = "pack int, id {id}, key bigint, n int, keys binary, sizes binary, counts binary, tokens binary"


def _shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _binary(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _planes(a: np.ndarray, kind: str) -> bytes:
    """The values byte by byte, the lowest bytes of all first: alike bytes stand together, so compression drops them."""
    values = np.ascontiguousarray(a, dtype=kind)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(columns: list[bytes], kind: str) -> np.ndarray:
    """The values of some ``_planes``, one after another."""
    width = np.dtype(kind).itemsize
    out = np.empty((sum(map(len, columns)) // width, width), dtype=np.uint8)
    at = 0
    for raw in columns:
        n = len(raw) // width
        out[at : at + n] = np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T
        at += n
    return out.view(kind).ravel()


def _packs(batches: Iterator[pa.RecordBatch], packs: int, width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per text, and the tokens of the classes seen, dealt to packs by hash."""
    seen: set[int] = set()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, bounds, tokens in shingle_sets(texts, width):
            n = len(bounds) - 1
            sizes = np.diff(bounds)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(tokens ^ np.uint64(0x5851F42D4C957F2D)))])
            keys = scramble(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64) * np.uint64(BASE_OF_SIZE))
            signed = keys.view(np.int64)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    # Dealt by place too, so that copies of one text spread.
                    pa.array(((keys + np.arange(n, dtype=np.uint64)) % np.uint64(packs)).astype(np.int32)),
                    ids.slice(first, n),
                    pa.array(signed),
                    pa.array(sizes.astype(np.int32)),
                    none, none, none, none,
                ],
                schema=schema,
            )
            fresh = np.zeros(n, dtype=bool)
            for i, k in enumerate(signed.tolist()):
                if sizes[i] and k not in seen:
                    seen.add(k)
                    fresh[i] = True
            owner = np.repeat(np.arange(n), sizes)
            use = fresh[owner]
            tokens, owner = tokens[use], owner[use]
            if not len(tokens):
                continue
            pack = ((tokens >> np.uint64(32)) * np.uint64(packs) >> np.uint64(32)).astype(np.int32)
            low = tokens & ((np.uint64(1) << TOKEN_BITS) - np.uint64(1))
            tokens = low | (pack.astype(np.uint64) << TOKEN_BITS)
            order = np.argsort(pack, kind="stable")  # within a pack still by text
            tokens, owner, pack = tokens[order], owner[order], pack[order]
            rows: list[list] = [[], [], [], [], []]
            for a, b in _runs(pack):
                texts_in, counts = np.unique(owner[a:b], return_counts=True)
                rows[0].append(int(pack[a]))
                rows[1].append(_binary(signed[texts_in], "<i8"))
                rows[2].append(_planes(sizes[texts_in], "<i4"))
                rows[3].append(_planes(counts, "<i4"))
                rows[4].append(_planes(tokens[a:b], "<u8"))
            m = len(rows[0])
            arrays = [pa.array(rows[0], pa.int32()), pa.nulls(m, schema.field(1).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(r, pa.binary()) for r in rows[1:]], schema=schema)


def _joined(columns: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(columns), dtype=kind)


def _shared(batches: Iterator[pa.RecordBatch], packs: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts as they came, and the tokens of this task that classes share, with their counts, in packs by class."""
    parts: dict[str, list[bytes]] = {name: [] for name in PACKED[:-1]}
    for batch in batches:
        texts = batch.filter(pc.is_valid(batch.column("key")))
        if len(texts):
            none = [pa.nulls(len(texts), pa.binary())] * len(PACKED)
            row = [pa.nulls(len(texts), pa.int32()), texts.column("id"), texts.column("key"), texts.column("n")]
            yield pa.RecordBatch.from_arrays(row + none, schema=schema)
        held_here = batch.filter(pc.is_null(batch.column("key")))
        for name, got in parts.items():
            got.extend(held_here.column(name).to_pylist())
    tokens = _values(parts.pop("tokens"), "<u8")
    if not len(tokens):
        return
    # Most tokens stand alone: only the others are given their classes.
    order = np.argsort(tokens)
    tokens = tokens[order]
    again = tokens[1:] == tokens[:-1]
    several = np.append(again, False) | np.append(False, again)
    tokens, order = tokens[several], order[several]
    counts = _values(parts["counts"], "<i4")
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
    keys, sizes = _joined(parts["keys"], "<i8")[owner], _values(parts["sizes"], "<i4")[owner]
    del parts, order, owner
    order = np.lexsort((keys, tokens))
    tokens, keys, sizes = tokens[order], keys[order], sizes[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    tokens, keys, sizes = tokens[new], keys[new], sizes[new]
    held = np.diff(np.append(_heads(tokens), len(tokens)))
    held = np.repeat(held, held)
    use = held > 1
    tokens, keys, sizes, held = tokens[use], keys[use], sizes[use], held[use]
    pack = (keys.view(np.uint64) % np.uint64(packs)).astype(np.int32)
    order = np.lexsort((keys, pack))
    tokens, keys, sizes, held, pack = tokens[order], keys[order], sizes[order], held[order], pack[order]
    for a, b in _runs(pack):
        heads = _heads(keys[a:b]) + a
        counts = np.diff(np.append(heads, b))
        arrays = [_binary(keys[heads], "<i8"), _planes(sizes[heads], "<i4"), _planes(counts, "<i4")]
        arrays += [_planes(tokens[a:b], "<u8"), _planes(held[a:b], "<u4")]
        row = [pa.array([int(pack[a])], pa.int32()), *(pa.nulls(1, schema.field(i).type) for i in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays(row + [pa.array([x], pa.binary()) for x in arrays], schema=schema)


def _heads(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    heads = _heads(values)
    return list(zip(heads.tolist(), np.append(heads, len(values))[1:].tolist(), strict=True))


def _unpacked(parts: dict[str, list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Key and size of each token of some packs."""
    counts = _values(parts["counts"], "<i4")
    return np.repeat(_joined(parts["keys"], "<i8"), counts), np.repeat(_values(parts["sizes"], "<i4"), counts)


def _sets(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The classes of this task that share enough tokens, with these in the global order, rarest first."""
    parts: dict[str, list[bytes]] = {name: [] for name in PACKED}
    for batch in batches:
        for name, got in parts.items():
            got.extend(batch.column(name).to_pylist())
    tokens, held = _values(parts.pop("tokens"), "<u8"), _values(parts.pop("held"), "<u4")
    keys, sizes = _unpacked(parts)
    del parts
    order = np.lexsort((tokens, held, keys))
    tokens, held, keys, sizes = tokens[order], held[order], keys[order], sizes[order]
    runs = [(a, b) for a, b in _runs(keys) if den * (b - a) >= num * int(sizes[a])]
    for i in range(0, len(runs), 1000):
        some = runs[i : i + 1000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(keys[a]) for a, _ in some], pa.int64()),
                pa.array([int(sizes[a]) for a, _ in some], pa.int32()),
                pa.array([_planes(tokens[a:b], "<u8") for a, b in some], pa.binary()),
                pa.array([_planes(held[a:b], "<u4") for a, b in some], pa.binary()),
            ],
            names=["key", "n", "tokens", "held"],
        )


def _prefix_packs(batches: Iterator[pa.RecordBatch], packs: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The prefix tokens of each class, dealt to packs by hash."""
    for batch in batches:
        firsts, keys = [], []
        for key, n, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "tokens")), strict=True):
            shared = _values([raw], "<u8")
            alone = n - len(shared)
            first = shared[: max(0, n - -(-num * n // den) + 1 - alone)]
            firsts.append(first)
            keys.append(np.full(len(first), key, dtype=np.int64))
        tokens = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        pack = ((tokens >> np.uint64(11)) % np.uint64(packs)).astype(np.int32)
        order = np.argsort(pack, kind="stable")
        tokens, keys, pack = tokens[order], keys[order], pack[order]
        spans = _runs(pack)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(pack[a]) for a, _ in spans], pa.int32()),
                pa.array([_binary(keys[a:b], "<i8") for a, b in spans], pa.binary()),
                pa.array([_binary(tokens[a:b], "<u8") for a, b in spans], pa.binary()),
            ],
            names=["pack", "keys", "tokens"],
        )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node of its component (by position, in rounds)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):
            np.minimum.at(root, side, low)
            np.minimum.at(root, before[side], low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class that shares a prefix token in this task, with the smallest class of its local component."""
    keys, tokens = [], []
    for batch in batches:
        keys += batch.column("keys").to_pylist()
        tokens += batch.column("tokens").to_pylist()
    k, t = _joined(keys, "<i8"), _joined(tokens, "<u8")
    if not len(k):
        return
    order = np.lexsort((k, t))
    k, t = k[order], t[order]
    same = t[1:] == t[:-1]
    nodes, roots = _forest(k[1:][same], k[:-1][same])
    use = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(roots[use])], names=["a", "b"])


def _join_cluster(rows: list[tuple], num: int, den: int, every: bool) -> list[tuple[int, int]]:
    """The links among the sets of one task: (key, n, tokens, held)."""
    keys = [r[0] for r in rows]
    flat = _values([r[2] for r in rows], "<u8")
    held = _values([r[3] for r in rows], "<u4").astype(np.int64)
    ids, first, at = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.lexsort((ids, -held[first]))] = np.arange(len(ids))
    ranks = np.split(rank[at], np.cumsum([len(r[2]) // 8 for r in rows])[:-1])
    sets = [np.sort(r) for r in ranks]
    sizes = np.array([r[1] for r in rows], dtype=np.int64)
    return [(keys[i], keys[j]) for i, j in trie_links(sets, sizes, num, den, every)]


def _cluster_links(batches: Iterator[pa.RecordBatch], num: int, den: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Links of the clusters of this task; rows come sorted by cluster and part."""
    here, rows = None, []

    def done() -> Iterator[pa.RecordBatch]:
        links = _join_cluster(rows, num, den, every) if len(rows) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"]
            )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("task", "key", "n", "tokens", "held"))
        for task, *row in zip(*columns, strict=True):
            if task != here:
                yield from done()
                here, rows = task, []
            rows.append(tuple(row))
    yield from done()


def _task_links(rows: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Join the sets of each ``task`` (a cluster, or two parts of one)."""
    dealt = rows.repartition(_shuffles(rows), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(lambda b: _cluster_links(b, num, den, every), "a bigint, b bigint")


def similar_links(sets: DataFrame, num: int = NUM, den: int = DEN, every: bool = False) -> DataFrame:
    """Links ``a`` - ``b`` between classes (``key``, ``n``, ``tokens``, ``held``), each verified on its whole set.

    By default as many as connect all that is connected; with ``every`` all of
    them, whose number grows with the square of a group of near copies.
    """
    packs = _shuffles(sets)
    prefixes = sets.mapInArrow(lambda b: _prefix_packs(b, packs, num, den), "pack int, keys binary, tokens binary")
    near = prefixes.repartitionById(packs, "pack").mapInArrow(_neighbours, "a bigint, b bigint")
    clusters = components(near)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    placed = sets.join(clusters.join(sizes, "component").withColumnRenamed("node", "key"), "key")
    placed = materialize(placed)
    one = placed.where(F.col("members") <= CLUSTER).withColumn("task", F.struct("component", F.lit(0).alias("i"), F.lit(0).alias("j")))
    large = placed.where(F.col("members") > CLUSTER).withColumn("parts", F.ceil(2 * F.col("members") / CLUSTER).cast("int"))
    large = large.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    i, j = F.col("i"), F.col("j")
    columns = ["key", "n", "tokens", "held", "task"]

    def in_parts(rows: DataFrame) -> DataFrame:
        """Every part meets every other; part i of the pair (i, j) with i < j, and part 0 itself."""
        other = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = other.select("*", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
        return pairs.where(i < j).withColumn("task", F.struct("component", "i", "j"))

    pairs = in_parts(large)
    first = one.select(*columns).unionByName(pairs.where(i == 0).select(*columns))
    links = materialize(_task_links(first, num, den, every))
    # Clusters in parts that the pairs with part 0 have not connected.
    found = components(links.join(large.select(F.col("key").alias("a")), "a", "left_semi")) if not every else None
    rest = pairs.where(i > 0)
    if found is not None:
        known = large.select("key", F.col("component").alias("cluster")).join(
            found.withColumnRenamed("node", "key"), "key", "left"
        )
        open_clusters = (
            known.groupBy("cluster")
            .agg(F.min(F.coalesce("component", "key")).alias("lo"), F.max(F.coalesce("component", "key")).alias("hi"))
            .where("lo < hi")
        )
        rest = rest.join(open_clusters, F.col("component") == F.col("cluster"), "left_semi")
    both = links.unionByName(materialize(_task_links(rest.select(*columns), num, den, every)))
    # Part 0 meets itself once per part.
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() if every else both


def shingle_classes(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """Texts and shared tokens in one written table: rows with a ``key``, and packs of tokens by class."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType.fromDDL(PACK.format(id=kind.simpleString()))
    packed = to_arrow_schema(schema)
    out = T.StructType.fromDDL(PACK.format(id=kind.simpleString()) + ", held binary")
    shared = to_arrow_schema(out)
    packs = _shuffles(docs)
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    dealt = texts.mapInArrow(lambda b: _packs(b, packs, width, packed), schema).repartitionById(packs, "pack")
    return materialize(dealt.mapInArrow(lambda b: _shared(b, packs, shared), out))


def candidate_sets(classes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The classes that share enough tokens to have a similar one: ``key``, ``n``, ``tokens``, ``held``."""
    packs = classes.where(F.col("key").isNull()).select("pack", *PACKED).repartitionById(_shuffles(classes), "pack")
    return materialize(packs.mapInArrow(lambda b: _sets(b, num, den), "key bigint, n int, tokens binary, held binary"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN
) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``."""
    both = shingle_classes(docs, id_col, text_col, width)
    texts = both.where(F.col("key").isNotNull()).select("id", "key", "n")
    linked = components(similar_links(candidate_sets(both, num, den), num, den)).select(F.col("node").alias("key"), "component")
    classes = texts.where("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    named_classes = classes.join(linked, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named_classes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named_classes.join(smallest, "component").select("key", "component_id")
    found = texts.where("n > 0").join(by_class, "key").select("id", "n", "component_id")
    alone = texts.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id"
    )
