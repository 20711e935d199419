"""Words and shingles of whole texts as 64-bit hashes, worked out on Arrow batches.

All steps run over the bytes of a batch at once: word bounds from a byte table,
word hashes from a running polynomial (arithmetic modulo 2**64), shingle hashes
from the word hashes inside them. Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Odd, so that its powers can be divided by modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
# Texts are worked on in runs of at most about this many bytes.
RUN_BYTES = 1 << 20


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: (first row, bytes, offsets). A null text is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + RUN_BYTES, side="right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[list(SPACE_BYTES)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text of every word; words don't cross texts."""
    space, _ = _byte_table()
    inside = ~space[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a word may start here
    edge[0] = True
    edge[1:-1] = ~inside[:-1]
    edge[offsets[offsets < len(raw)]] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    after = np.zeros(len(raw) + 1, dtype=bool)
    after[1:-1] = ~inside[1:]
    after[-1] = True
    after[offsets] = True
    ends = np.flatnonzero(after[1:] & inside) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of its lower-cased (A-Z) bytes if asked."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    values = (_byte_table()[1][raw] if lower else raw).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(BASE, len(raw)), out=sums[1:])
    shift = _powers(BASE_INVERSE, len(raw))
    return scramble((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as sets of shingles: (first row, bounds per text, sorted distinct hashes).

    A text of fewer words than ``width``, but at least one, is one shingle of all its words.
    """
    place = [np.uint64(pow(BASE, 3 * k + 7, 1 << 64)) for k in range(width)]
    for first, raw, offsets in text_runs(texts):
        starts, ends, owner = word_spans(raw, offsets)
        hashes = word_hashes(raw, starts, ends)
        n = len(offsets) - 1
        counts = np.bincount(owner, minlength=n)
        heads = np.concatenate([[0], np.cumsum(counts)])
        mixed = np.zeros(len(hashes), dtype=np.uint64)
        for k in range(width):
            mixed[: max(0, len(hashes) - k)] += scramble(hashes[k:] * place[k])
        position = np.arange(len(hashes)) - heads[owner]
        full = position + width <= counts[owner]
        short = (counts[owner] < width) & (position == 0)
        if short.any():
            for i in np.flatnonzero(short):  # a few words each
                own = hashes[i : i + counts[owner[i]]]
                mixed[i : i + 1] = scramble(own * np.array(place[: len(own)])).sum() ^ np.uint64(len(own))
        keep = full | short
        tokens, docs = scramble(mixed[keep]), owner[keep]
        order = np.lexsort((tokens, docs))
        tokens, docs = tokens[order], docs[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])
        tokens, docs = tokens[new], docs[new]
        yield first, np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))]), tokens
