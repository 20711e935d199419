"""Statistics of whole texts for the quality classifier, worked out on Arrow batches of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tracegrid.llm.shingles import scramble, text_runs, word_hashes, word_spans

# Each is a length or a share, moved so that ordinary texts lie roughly evenly around a middle.
FEATURES = (
    "log_words",
    "log_lines",
    "word_length",
    "word_length_spread",
    "upper_share",
    "digit_share",
    "symbol_share",
    "punctuation_share",
    "other_share",
    "distinct_words",
    "distinct_pairs",
    "distinct_lines",
    "top_word_share",
)

PRIOR_CHARS, PRIOR_WORDS = 100, 20


def _classes() -> np.ndarray:
    """Byte -> 0 space, 1 lower, 2 upper, 3 digit, 4 symbol, 5 punctuation, 6 above ASCII, 7 rest."""
    kind = np.full(256, 7, dtype=np.uint8)
    kind[128:] = 6
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[97:123] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    kind[[ord(c) for c in "#*$%&|<>@^~_=+\\{}[]"]] = 4
    kind[[ord(c) for c in ".,;:!?'\"()-/"]] = 5
    return kind


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def _longest_run(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how often the most frequent one stands, per owner."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([heads, [len(h)]]))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, o[heads], runs)
    return np.bincount(o[heads], minlength=n), most


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text. A null or blank text has zeros for shares and counts."""
    rows = [np.zeros((0, len(FEATURES)))]
    kind = _classes()
    for _, raw, offsets in text_runs(texts):
        n = len(offsets) - 1
        starts, ends, owner = word_spans(raw, offsets)
        hashes = word_hashes(raw, starts, ends)
        text_of = np.repeat(np.arange(n), np.diff(offsets))
        per_kind = np.bincount(text_of * 8 + kind[raw], minlength=n * 8).reshape(n, 8).astype(float)
        solid = per_kind[:, 1:].sum(axis=1)
        words = np.bincount(owner, minlength=n).astype(float)
        some = np.maximum(words, 1)
        lengths = (ends - starts).astype(float)
        mean = np.bincount(owner, lengths, n) / some
        spread = np.sqrt(np.maximum(np.bincount(owner, lengths**2, n) / some - mean**2, 0))
        distinct, top = _longest_run(hashes, owner, n)
        pair = owner[1:] == owner[:-1]
        pairs = scramble(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(7))[pair] if len(hashes) > 1 else np.zeros(0, np.uint64)
        pair_owner = owner[1:][pair] if len(hashes) > 1 else np.zeros(0, np.int64)
        n_pairs = np.bincount(pair_owner, minlength=n)
        distinct_pairs = _distinct(pairs, pair_owner, n)
        # A line is told by the sum of its words' hashes at their places.
        breaks = np.cumsum(raw == 10)
        line = breaks[starts] if len(starts) else np.zeros(0, np.int64)
        lines = text_line = np.zeros(0, np.int64)
        line_hash = np.zeros(0, np.uint64)
        if len(starts):
            heads = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]))
            place = np.arange(len(hashes)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(hashes)]])))
            line_hash = np.add.reduceat(scramble(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), heads)
            text_line = owner[heads]
        lines = np.bincount(text_line, minlength=n).astype(float)
        distinct_lines = _distinct(line_hash, text_line, n)
        # Shares of a few words say little: each starts from a usual text of so many characters and words.
        chars = lambda k, usual: np.sqrt((per_kind[:, k] + PRIOR_CHARS * usual) / (solid + PRIOR_CHARS))
        of = lambda a, n, usual: (a + PRIOR_WORDS * usual) / (n + PRIOR_WORDS)
        rows.append(
            np.column_stack(
                [
                    np.log1p(words),
                    np.log1p(lines) - 0.5 * np.log1p(words),
                    np.log(of(mean * words, words, 5.5)),
                    np.log(of(spread**2 * words, words, 9.0)),
                    chars(2, 0.03),
                    chars(3, 0.005),
                    chars(4, 0.001),
                    chars(5, 0.03),
                    chars(6, 0.03),
                    np.log(of(distinct, words, 1.0)) + 0.25 * np.log(words + PRIOR_WORDS),
                    of(distinct_pairs, n_pairs, 1.0),
                    (distinct_lines + 4) / (lines + 4),
                    np.sqrt(of(top, words, 0.1)),
                ]
            )
        )
    return np.concatenate(rows)
