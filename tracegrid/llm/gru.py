"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Input: windows of word numbers into a table of distinct words. A word's vector
is its own (for words known from training) beside the sum of those of its
character n-grams (prefixes and inner runs), over the square root of their number.
Output: a logit per window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from tracegrid.llm.shingles import BASE, BASE_INVERSE, _powers, scramble, text_runs

WINDOW, STRIDE = 32, 16
PREFIXES = (2, 3, 4, 5, 6, 7, 8)
RUNS = (4, 5)
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
# Windows worked on at once: their states stay in the processor's cache.
BATCH = 2048
# Steps of training at least, however few the texts.
LEAST_STEPS = 200


def letters() -> np.ndarray:
    """Bytes that make up words here: ASCII letters and everything above ASCII."""
    out = np.zeros(256, dtype=bool)
    out[65:91] = out[97:123] = out[128:] = True
    return out


def letter_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text of every run of letters."""
    inside = letters()[raw]
    edge = np.ones(len(raw) + 1, dtype=bool)
    edge[1:-1] = ~inside[:-1]
    edge[offsets] = True
    after = np.ones(len(raw) + 1, dtype=bool)
    after[1:-1] = ~inside[1:]
    after[offsets] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(after[1:] & inside) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


@dataclass
class Words:
    """The distinct words of a run of texts: hashes, and the hashes of their n-grams (bounds per word)."""

    hashes: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words (A-Z as a-z), and for each occurrence the place of its word."""
    low = raw.astype(np.uint64)
    low[(raw >= 65) & (raw <= 90)] += np.uint64(32)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((low + np.uint64(1)) * _powers(BASE, len(raw)), out=sums[1:])
    shift = _powers(BASE_INVERSE, len(raw) + 1)

    def piece(a: np.ndarray, b: np.ndarray, mark: int) -> np.ndarray:
        return scramble((sums[b] - sums[a]) * shift[a] + np.uint64(mark))

    hashes, first, at = np.unique(piece(starts, ends, 0), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    grams, owner = [], []
    for n in PREFIXES:
        own = np.flatnonzero(e - s >= n)
        grams.append(piece(s[own], s[own] + n, n))
        owner.append(own)
    for n in RUNS:
        many = np.maximum(e - s - n + 1, 0)
        own = np.repeat(np.arange(len(s)), many)
        begin = s[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        grams.append(piece(begin, begin + n, 100 + n))
        owner.append(own)
    flat, of = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(s)))])
    return Words(hashes, flat[order], bounds), at


@dataclass
class Known:
    """The same words as rows of the network's tables: each word's, and those of its known n-grams, in order."""

    word: np.ndarray
    gram: np.ndarray
    many: np.ndarray  # n-grams per word


class Lookup:
    """Numbers of known hashes, 0 for all others.

    A hash has a place in a table, by some of its bits. Where several known ones share a
    place one stays there; the others are in a table of their own, by other bits, which
    is asked about such places only.
    """

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray | None = None, depth: int = 0):
        numbers = np.arange(1, len(hashes) + 1) if numbers is None else numbers
        size = 1 << depth + max(8, int(4 * len(hashes) + 1).bit_length())
        self.mask, self.shift = np.uint64(size - 1), np.uint64(11 * depth % 44)
        self.held = np.zeros(size, dtype=np.uint64)
        self.number = np.zeros(size, dtype=np.int32)
        place = self._place(hashes)
        self.held[place], self.number[place] = hashes, numbers
        stays = self.number[place] == numbers
        self.shared = np.zeros(size, dtype=bool)
        self.shared[place[~stays]] = True
        self.others = None if stays.all() else Lookup(hashes[~stays], numbers[~stays], depth + 1)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> self.shift) & self.mask).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = self._place(hashes)
        found = np.where(self.held[place] == hashes, self.number[place], 0)
        if self.others is not None:
            open_ = np.flatnonzero((found == 0) & self.shared[place])
            if len(open_):
                found[open_] = self.others(hashes[open_])
        return found


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts of so many words: text, first word (within the run), length.

    Windows start every ``STRIDE`` words and the last one ends with the text. A text
    without words has none.
    """
    heads = np.cumsum(counts) - counts
    many = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return text, heads[text] + first, np.minimum(counts[text], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _parameters(words: int, grams: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    return {
        "word": normal(words + 1, WORD_DIM, s=0.02),
        "gram": normal(grams + 1, CHAR_DIM, s=0.02),
        "W": normal(WORD_DIM + CHAR_DIM, 6 * h, s=0.3),
        "b": np.zeros(6 * h, np.float32),
        "Uf": normal(h, 3 * h, s=0.3),
        "Ub": normal(h, 3 * h, s=0.3),
        "att": normal(2 * h, s=0.3),
        "out": normal(2 * h, s=0.3),
        "bias": np.full(1, -1.0, np.float32),
    }


@dataclass
class Network:
    p: dict[str, np.ndarray]
    known_words: Lookup
    known_grams: Lookup
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    steps: int = 0

    def known(self, words: Words) -> Known:
        w, g = self.known_words(words.hashes), self.known_grams(words.grams)
        owner = np.repeat(np.arange(len(words.hashes)), np.diff(words.bounds))
        use = g > 0
        return Known(w, g[use], np.bincount(owner[use], minlength=len(w)))

    def vectors(self, words: Known) -> np.ndarray:
        chars = np.zeros((len(words.word), CHAR_DIM), dtype=np.float32)
        if len(words.gram):
            some = np.flatnonzero(words.many)
            heads = (np.cumsum(words.many) - words.many)[some]
            chars[some] = np.add.reduceat(self.p["gram"][words.gram], heads) / np.sqrt(words.many[some, None], dtype=np.float32)
        return np.concatenate([self.p["word"][words.word], chars], axis=1)

    def _pass(self, x: np.ndarray, at: np.ndarray, live: np.ndarray | None, u: np.ndarray, back: bool, keep: list | None):
        """One direction over windows ``at`` (time x window) into projected inputs ``x``."""
        steps, many = at.shape
        h = np.zeros((many, HIDDEN), dtype=np.float32)
        states = np.empty((steps, many, HIDDEN), dtype=np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            a = x[at[t]]
            g = h @ u
            gates = a[:, : 2 * HIDDEN]
            gates += g[:, : 2 * HIDDEN]
            _sigmoid(gates)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = g[:, 2 * HIDDEN :] * r
            new += a[:, 2 * HIDDEN :]
            np.tanh(new, out=new)
            turn = h - new
            turn *= z
            turn += new
            if live is not None:
                turn = np.where(live[t][:, None], turn, h)
            if keep is not None:
                keep.append((t, h, z, r, new, g[:, 2 * HIDDEN :]))
            h = turn
            states[t] = h
        return states

    def _logits(self, x: np.ndarray, at: np.ndarray, live: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        h3 = 3 * HIDDEN
        xf, xb = np.ascontiguousarray(x[:, :h3]), np.ascontiguousarray(x[:, h3:])
        forth, back = ([], []) if keep is not None else (None, None)
        f = self._pass(xf, at, live, self.p["Uf"], False, forth)
        b = self._pass(xb, at, live, self.p["Ub"], True, back)
        weight = f @ self.p["att"][:HIDDEN] + b @ self.p["att"][HIDDEN:]
        value = f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:]
        if live is not None:
            weight = np.where(live, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        logit = (weight * value).sum(axis=0) + self.p["bias"][0]
        if keep is not None:
            keep.update(forth=forth, back=back, f=f, b=b, weight=weight, value=value, logit=logit)
        return logit

    def window_logits(self, words: Words, at: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The logit of every window; ``at`` numbers the words in order of occurrence."""
        x = self.vectors(self.known(words)) @ self.p["W"] + self.p["b"]
        out = np.empty(len(first), dtype=np.float32)
        full = lengths == WINDOW
        for group in (np.flatnonzero(full), np.flatnonzero(~full)):
            for i in range(0, len(group), BATCH):
                own = group[i : i + BATCH]
                place, live = window_places(at, first[own], lengths[own])
                out[own] = self._logits(x, place, None if full[own[0]] else live)
        return out

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        """The highest probability of any window of each text; a text without words scores as the bias alone says."""
        out = []
        for _, raw, offsets in text_runs(texts):
            n = len(offsets) - 1
            best = np.full(n, self.p["bias"][0], dtype=np.float64)
            starts, ends, owner = letter_words(raw, offsets)
            if len(starts):
                words, at = distinct_words(raw, starts, ends)
                text, first, lengths = windows(np.bincount(owner, minlength=n))
                logits = self.window_logits(words, at, first, lengths).astype(np.float64)
                heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                best[text[heads]] = np.maximum.reduceat(logits, heads)
            out.append(1 / (1 + np.exp(-np.clip(best, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, words: Known, at: np.ndarray, first: np.ndarray, lengths: np.ndarray, loss_of) -> tuple[float, dict]:
        """Loss and gradients over some windows; ``loss_of`` turns logits into (loss, gradient of the logits)."""
        p, h = self.p, HIDDEN
        vectors = self.vectors(words)
        x = vectors @ p["W"] + p["b"]
        place, live = window_places(at, first, lengths)
        k: dict = {}
        loss, dl = loss_of(self._logits(x, place, live, k))
        grad: dict = {"bias": np.array([dl.sum()], np.float32), "att": np.zeros_like(p["att"]), "out": np.zeros_like(p["out"])}
        dvalue = k["weight"] * dl
        dweight = k["weight"] * (k["value"] - (k["logit"] - p["bias"][0])) * dl
        dx = np.zeros_like(x)
        for name, u, states, half, off in (("forth", "Uf", k["f"], slice(0, h), 0), ("back", "Ub", k["b"], slice(h, 2 * h), 3 * h)):
            grad["att"][half] = np.einsum("tb,tbh->h", dweight, states)
            grad["out"][half] = np.einsum("tb,tbh->h", dvalue, states)
            dh = np.zeros((place.shape[1], h), dtype=np.float32)
            grad[u], steps = np.zeros_like(p[u]), np.empty((*place.shape, 3 * h), np.float32)
            for t, before, z, r, new, gn in reversed(k[name]):
                d = dh + dweight[t][:, None] * p["att"][half] + dvalue[t][:, None] * p["out"][half]
                on = live[t][:, None]
                d_live = np.where(on, d, 0)
                dnew = d_live * (1 - z) * (1 - new * new)
                dz = d_live * (before - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                steps[t] = np.concatenate([dz, dr, dnew], axis=1)
                dg = np.concatenate([dz, dr, dnew * r], axis=1)
                grad[u] += before.T @ dg
                dh = np.where(on, d_live * z + dg @ p[u].T, d)
            used, sums = _row_sums(place.ravel(), steps.reshape(-1, 3 * h))
            dx[used, off : off + 3 * h] = sums
        grad["W"] = vectors.T @ dx
        grad["b"] = dx.sum(axis=0)
        dv = dx @ p["W"].T
        grad["word"] = _row_sums(words.word, dv[:, :WORD_DIM])
        grad["gram"] = _row_sums(words.gram, np.repeat(dv[:, WORD_DIM:] / np.sqrt(np.maximum(words.many, 1))[:, None], words.many, axis=0))
        return loss, grad

    def step(self, grad: dict, rate: float) -> None:
        """One step of Adam; of the tables only the rows that took part move."""
        self.steps += 1
        scale = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for name, g in grad.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.moments.setdefault(name, (np.zeros_like(self.p[name]), np.zeros_like(self.p[name])))
            m[rows] += 0.1 * (g - m[rows])
            v[rows] += 0.001 * (g * g - v[rows])
            self.p[name][rows] -= rate * scale * m[rows] / (np.sqrt(v[rows]) + 1e-8)


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct row numbers and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    return rows[heads], np.add.reduceat(values[order], heads) if len(heads) else values[:0]


def window_places(at: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (time x window), and which of them are in the window."""
    t = np.arange(WINDOW)[:, None]
    live = t < lengths
    return at[np.minimum(first + t, len(at) - 1)], live


def train(
    texts: Sequence[str], labels: Sequence[int], seed: int = 7, epochs: int = 6, rate: float = 0.02, min_count: int = 3
) -> Network:
    """Learn window scores from labels of whole texts.

    A text's logit is the mean of its windows', weighted towards the highest, so
    what is learned from a toxic text comes from the windows that stand out.
    """
    rng = np.random.default_rng(seed)
    y_all = np.asarray(labels, dtype=np.float32)
    found = list(_prepared(texts))
    known = [
        _frequent([p[0].hashes for p in found], min_count),
        _frequent([np.unique(p[0].grams) for p in found], min_count),
    ]
    net = Network(_parameters(len(known[0]), len(known[1]), rng), Lookup(known[0]), Lookup(known[1]))
    prepared = [(net.known(words), *rest) for words, *rest in found]
    del found
    weight = np.where(y_all > 0, 0.5 / max(y_all.mean(), 1e-6), 0.5 / max(1 - y_all.mean(), 1e-6)) if len(y_all) else y_all
    usable = [i for i, p in enumerate(prepared) if len(p[0].word)]
    epochs = max(epochs, LEAST_STEPS // max(1, -(-len(usable) // 32)))
    total = epochs * -(-len(usable) // 32)
    for _ in range(epochs):
        rng.shuffle(usable)
        for i in range(0, len(usable), 32):
            batch = usable[i : i + 32]
            words, at, first, lengths, text = _joined([prepared[j] for j in batch])
            y, c = y_all[batch], weight[batch]

            def loss_of(logits: np.ndarray, y=y, c=c, text=text) -> tuple[float, np.ndarray]:
                share = np.exp(2 * np.minimum(logits, 15))
                share /= np.bincount(text, share, len(y))[text]
                whole = np.bincount(text, share * logits, len(y))
                prob = 1 / (1 + np.exp(-np.clip(whole, -30, 30)))
                loss = -(c * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean()
                return float(loss), ((c * (prob - y) / len(y))[text] * share).astype(np.float32)

            _, grad = net.gradients(words, at, first, lengths, loss_of)
            net.step(grad, rate * (1 - net.steps / (total + 1)))
    net.moments = {}
    return net


def _frequent(sets: list[np.ndarray], least: int) -> np.ndarray:
    """Values that are in at least so many of the sets."""
    values, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    return values[n >= least]


def _prepared(texts: Sequence[str]) -> Iterator[tuple]:
    for text in texts:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        starts, ends, _ = letter_words(raw, np.array([0, len(raw)]))
        words, at = distinct_words(raw, starts, ends)
        _, first, lengths = windows(np.array([len(starts)]))
        yield words, at, first, lengths


def _joined(parts: list[tuple]) -> tuple:
    """Several texts as one: their words side by side."""
    sizes = np.cumsum([0] + [len(p[0].word) for p in parts])
    places = np.cumsum([0] + [len(p[1]) for p in parts])
    words = Known(*(np.concatenate([getattr(p[0], name) for p in parts]) for name in ("word", "gram", "many")))
    at = np.concatenate([p[1] + s for p, s in zip(parts, sizes, strict=False)])
    first = np.concatenate([p[2] + s for p, s in zip(parts, places, strict=False)])
    lengths = np.concatenate([p[3] for p in parts])
    text = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
    return words, at, first, lengths, text
