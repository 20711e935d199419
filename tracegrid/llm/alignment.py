"""Alignment of the tokens of two tokenizers over a whole corpus.

Each text is cut by both tokenizers into tokens that end at byte offsets. The two
end lists are met by a galloping intersection: from the shorter list each end looks
for its place in the longer one, by doubling steps from the place of an earlier end
and then by halving. An end found there is common to both and closes a group. The
places also give the links: the tokens of the longer list that a token overlaps are
those from the place of its predecessor's end to the place of its own.

How often two ids are linked, in documents, is counted over the whole corpus:

1. Tasks tokenise and align runs of texts and gather them in chunks of bounded size.
   A chunk knows its distinct id pairs and in how many of its documents each stands;
   a document is a packed list of places in that list.
2. The chunks' counts are added up by pair (one narrow row per pair and chunk, however
   often a pair stands in the chunk), and each pair learns whether it is the best of its
   first id: ``best``.
3. Each chunk gets the counts of its own pairs back and sums them up by document.

So a pair that stands in every document has one row per chunk, and what a task holds
is a chunk and its distinct pairs. Texts are read once and never shuffled. Nothing is
broadcast or collected.

Defined results: a text that is null, empty, or that either tokenizer doesn't give back
byte for byte has no tokens, groups or links: zeros and an empty ``groups``. Repeated
rows, equal texts and null ids are documents of their own. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracegrid.functions.text import named
from tracegrid.llm.tokenizer_files import byte_bpe, piece_bpe
from tracegrid.operators.storage import materialize

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Bytes of text aligned in one go, and gathered in one chunk (a longer text is a run or chunk of its own).
RUN_BYTES = 1 << 20
CHUNK_BYTES = 12 << 20
# Every so many ends one is looked for first, and the others start from its place.
STRIDE = 8


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The place of each of ``short`` in ``long``: how many of ``long`` are smaller. Both are sorted."""
    n = len(short)
    low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[:n] if n > STRIDE else np.zeros(n, np.int64)
    high = np.full(n, len(long), dtype=np.int64)
    step, seeking = 1, np.arange(n)
    while len(seeking):  # exponential: all before ``low`` are smaller
        probe = low[seeking] + step - 1
        inside = probe < len(long)
        seeking, probe = seeking[inside], probe[inside]
        smaller = long[probe] < short[seeking]
        high[seeking[~smaller]] = probe[~smaller]
        seeking = seeking[smaller]
        low[seeking] = probe[smaller] + 1
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):  # binary
        middle = (low[open_] + high[open_]) >> 1
        smaller = long[middle] < short[open_]
        low[open_[smaller]] = middle[smaller] + 1
        high[open_[~smaller]] = middle[~smaller]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_and_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two end lists of the same bytes: which ends of each are common, and the overlapping pairs of tokens."""
    turned = len(b) < len(a)
    short, long = (b, a) if turned else (a, b)
    place = gallop(short, long)
    common = long[place] == short
    last = place
    first = np.zeros(len(short), dtype=np.int64)
    first[1:] = place[:-1] + common[:-1]
    width = last - first + 1
    of_short = np.repeat(np.arange(len(short)), width)
    of_long = np.arange(len(of_short)) + np.repeat(first - (np.cumsum(width) - width), width)
    in_long = np.zeros(len(long), dtype=bool)
    in_long[place[common]] = True
    return (in_long, common, of_long, of_short) if turned else (common, in_long, of_short, of_long)


class Vocabulary:
    """The bytes of every id, in one array."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.bytes[shift + np.arange(len(shift))]


def _given_back(ids: list[np.ndarray], raw: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Which texts are the joined bytes of their tokens (each of which has some)."""
    fit = np.array([int(vocabulary.lengths[i].sum()) == len(r) and bool(vocabulary.lengths[i].all()) for i, r in zip(ids, raw, strict=True)], dtype=bool)
    use = np.flatnonzero(fit)
    if len(use):
        bounds = np.cumsum([len(raw[i]) for i in use])
        want = np.frombuffer(b"".join(raw[i] for i in use), dtype=np.uint8)
        wrong = np.flatnonzero(vocabulary.joined(np.concatenate([ids[i] for i in use])) != want)
        fit[use[np.unique(np.searchsorted(bounds, wrong, side="right"))]] = False
    return fit


class Aligner:
    """Aligns runs of texts."""

    def __init__(self, first: str, second: str):
        (self.encode_a, a), (self.encode_b, b) = byte_bpe(first), piece_bpe(second)
        self.a, self.b = Vocabulary(a), Vocabulary(b)
        most = max(self.a.size, self.b.size)
        self.most = most
        self.said = [f"{i}{mark}" for mark in ",|;" for i in range(most)]

    def run(self, texts: list[str | None]) -> dict[str, np.ndarray | list[str]]:
        """Per text n_a, n_b, n_groups, n_links and ``groups``; and per text and linked id pair its ``times``."""
        n = len(texts)
        out: dict[str, np.ndarray | list[str]] = {c: np.zeros(n, dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"groups": [""] * n} | {c: np.zeros(0, dtype=np.int64) for c in ("doc", "pair", "times")}
        use = np.flatnonzero([bool(t) for t in texts])
        some = [texts[i] for i in use]
        raw = [b" " + t.encode() for t in some]
        ids_a, ids_b = self.encode_a([" " + t for t in some]), self.encode_b(some)
        fit = np.flatnonzero(_given_back(ids_a, raw, self.a) & _given_back(ids_b, raw, self.b))
        if not len(fit):
            return out
        use = use[fit]
        n_a, n_b = (np.array([len(ids[i]) for i in fit], dtype=np.int64) for ids in (ids_a, ids_b))
        a, b = (np.concatenate([ids[i] for i in fit]).astype(np.int64) for ids in (ids_a, ids_b))
        # The texts lie end to end, so that a text's end is common too.
        common_a, common_b, link_a, link_b = common_and_links(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        of_a = np.repeat(np.arange(len(use)), n_a)
        out["n_a"][use], out["n_b"][use] = n_a, n_b
        out["n_groups"][use] = np.bincount(of_a[common_a], minlength=len(use))
        of_link = of_a[link_a]
        out["n_links"][use] = np.bincount(of_link, minlength=len(use))
        pairs = self.a.size * self.b.size
        key = of_link * pairs + a[link_a] * self.b.size + b[link_b]
        key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out["doc"], out["pair"] = use[key[heads] // pairs], key[heads] % pairs
        out["times"] = np.diff(np.append(heads, len(key)))
        for i, said in zip(use.tolist(), self._say(a, b, common_a, common_b, n_a + n_b), strict=True):
            out["groups"][i] = said
        return out

    def _say(self, a: np.ndarray, b: np.ndarray, common_a: np.ndarray, common_b: np.ndarray, counts: np.ndarray) -> Iterator[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        upto_a, upto_b = np.flatnonzero(common_a) + 1, np.flatnonzero(common_b) + 1
        group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
        said = np.empty(len(a) + len(b), dtype=np.int64)
        before_b = np.concatenate([[0], upto_b])
        said[np.arange(len(a)) + before_b[group_a]] = a + self.most * common_a
        said[np.arange(len(b)) + upto_a[group_b]] = b + 2 * self.most * common_b
        at = 0
        for n in counts.tolist():
            yield "".join(map(self.said.__getitem__, said[at : at + n].tolist()))[:-1]
            at += n


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, lowest bytes first, then the next ones: most of these are zero."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack(sizes: np.ndarray, places: np.ndarray, times: np.ndarray) -> bytes:
    """Places (in order within a document) as steps, and times."""
    steps = np.diff(places, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = places[starts]
    return pa.compress(_planes(steps) + _planes(times - 1), codec="zstd", asbytes=True)


def _unpack(packed: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(sizes.sum())
    raw = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    steps, times = _from_planes(raw[: 4 * n]), _from_planes(raw[4 * n :]) + 1
    sums = np.cumsum(steps)
    starts = np.cumsum(sizes) - sizes
    before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], 0) if n else np.zeros(len(sizes), np.int64)
    return sums - np.repeat(before, sizes), times


DOC = "id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
CHUNK = "chunk bigint, docs array<struct<" + DOC.replace(" ", ":").replace(",:", ",") + ">>, sizes array<int>, packed binary, pairs array<bigint>, held array<int>"


class _Chunk:
    """Aligned documents until there are enough of them."""

    def __init__(self) -> None:
        self.bytes, self.n = 0, 0
        self.ids: list[pa.Array] = []
        self.found: list[dict] = []

    def add(self, ids: pa.Array, run: dict, size: int) -> None:
        run["doc"] = run["doc"] + self.n
        self.ids.append(ids)
        self.found.append(run)
        self.n, self.bytes = self.n + len(ids), self.bytes + size

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        every = lambda c: np.concatenate([f[c] for f in self.found])
        docs = schema.field("docs").type.value_type
        columns = [pa.concat_arrays(self.ids).cast(docs.field(0).type)]
        columns += [pa.array(every(c)) for c in ("n_a", "n_b", "n_groups", "n_links")]
        columns.append(pa.array([g for f in self.found for g in f["groups"]], pa.string()))
        rows = pa.StructArray.from_arrays(columns, fields=list(docs))
        pairs, at, held = np.unique(every("pair"), return_inverse=True, return_counts=True)
        # The most frequent pairs come first: small steps pack well.
        order = np.argsort(-held, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        doc, place, times = every("doc"), rank[at.ravel()], every("times")
        order = order.astype(np.int64)
        by_doc = np.lexsort((place, doc))
        sizes = np.bincount(doc, minlength=self.n)
        packed = _pack(sizes, place[by_doc], times[by_doc])
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        whole = pa.ListArray.from_arrays(pa.array([0, self.n], pa.int32()), rows, type=schema.field("docs").type)
        arrays = [pa.array([number], pa.int64()), whole, one(sizes, pa.int32()), pa.array([packed], pa.binary())]
        arrays += [one(pairs[order], pa.int64()), one(held[order], pa.int32())]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)


def aligned_chunks(
    docs: DataFrame, id_col: str, text_col: str, first: str, second: str, chunk_bytes: int, digest: bool
) -> DataFrame:
    """Chunks of aligned documents, with their linked id pairs, written once."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = T.StructType.fromDDL(CHUNK.format(id=kind))
    arrow = to_arrow_schema(schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        aligner, chunk = Aligner(first, second), _Chunk()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = _lengths(texts)
            at = 0
            while at < len(batch):
                upto = max(at + 1, int(np.searchsorted(sizes, sizes[at] + RUN_BYTES, side="right")) - 1)
                run = aligner.run(texts.slice(at, upto - at).to_pylist())
                if digest:
                    run["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in run["groups"]]
                chunk.add(ids.slice(at, upto - at), run, int(sizes[upto] - sizes[at]))
                at = upto
                if chunk.bytes >= chunk_bytes:
                    yield chunk.row(number, arrow)
                    number, chunk = number + 1, _Chunk()
        if chunk.n:
            yield chunk.row(number, arrow)

    return materialize(docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(chunks, schema))


def _lengths(texts: pa.Array) -> np.ndarray:
    """Running byte lengths of texts; a null one has none."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])


def pair_counts(chunks: DataFrame, second_ids: int) -> DataFrame:
    """Each linked id pair of the corpus: ``pair``, ``held`` (documents), ``best`` (the most of its first id)."""
    stands = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.pairs", "p.held")
    total = stands.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("held"))
    # An id has at most as many pairs as the other tokenizer has ids.
    own = Window.partitionBy(F.expr(f"pair div {second_ids}"))
    return total.select("pair", "held", (F.col("held") == F.max("held").over(own)).alias("best"))


def align_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first: str = BYTE_BPE,
    second: str = PIECE_BPE,
    digest: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    ``groups`` is the alignment itself, ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its hex sha256.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = aligned_chunks(docs, id_col, text_col, first, second, chunk_bytes, digest)
    counts = pair_counts(chunks, len(piece_bpe(second)[1]))
    asked = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select(F.col("chunk").alias("of"), "at", "held", "best")
    out_schema = DOC.format(id=kind) + ", n_best bigint, count_sum bigint"

    def sums(key: tuple, own: pa.Table, answered: pa.Table) -> pa.Table:
        order = np.argsort(answered.column("at").to_numpy())
        held = answered.column("held").to_numpy()[order]
        best = answered.column("best").to_numpy()[order]
        docs_here = own.column("docs").combine_chunks()
        docs_here = docs_here if isinstance(docs_here, pa.Array) else docs_here.chunk(0)
        sizes = own.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64)
        places, times = _unpack(own.column("packed")[0].as_py(), sizes)
        n_best = _sums(sizes, times * best[places])
        count_sum = _sums(sizes, times * held[places])
        columns = [*docs_here.flatten().flatten(), pa.array(n_best), pa.array(count_sum)]
        return pa.Table.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

    summed = chunks.select("chunk", "docs", "sizes", "packed").groupBy("chunk").cogroup(answers.groupBy("of"))
    found = summed.applyInArrow(sums, out_schema)
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def _sums(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return running[ends] - running[ends - sizes]
