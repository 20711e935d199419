import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, messy, messy_rows, messy_texts
from tracegrid.llm import gru
from tracegrid.llm.gru import Lookup, Network, letter_words, train, windows
from tracegrid.llm.quality_classifier import held_out
from tracegrid.llm.toxicity import toxicity_scores, training_sample


def test_windows_cover_texts():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 200])
    text, first, lengths = windows(counts)
    heads = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        own = [(f - heads[i], k) for t, f, k in zip(text, first, lengths, strict=True) if t == i]
        covered = set()
        for f, k in own:
            covered |= set(range(f, f + k))
            assert k == min(n, gru.WINDOW) and f + k <= n
        assert covered == set(range(n))


def small_network(seed=0):
    words = np.array([3, 5, 9], np.uint64)
    p = {k: v.astype(np.float64) for k, v in gru._parameters(3, 2, np.random.default_rng(seed)).items()}
    return Network(p, Lookup(words), Lookup(np.array([11, 12], np.uint64)))


def test_lookup_loses_nothing():
    """Also of hashes that agree in many bits, and of as many as a corpus brings."""
    rng = np.random.default_rng(2)
    for hashes in (
        rng.integers(0, 1 << 63, 90_000, dtype=np.uint64),
        np.arange(500, dtype=np.uint64) << np.uint64(44),
        np.array([0, 1 << 63, 1, (1 << 63) | 1], dtype=np.uint64),
        np.zeros(0, np.uint64),
    ):
        hashes = np.unique(hashes)
        lookup = Lookup(hashes)
        assert (lookup(hashes) == np.arange(1, len(hashes) + 1)).all()
        others = np.setdiff1d(rng.integers(0, 1 << 63, 10_000, dtype=np.uint64), hashes)
        assert not lookup(others).any()


def plain_logit(p, inputs):
    """One window, step by step: gated units in both directions, attention over the steps, one weighted sum."""
    h = gru.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    sides = []
    for side, order in (("f", inputs), ("b", inputs[::-1])):
        columns = slice(0, 3 * h) if side == "f" else slice(3 * h, 6 * h)
        state, states = np.zeros(h), []
        for x in order:
            a, g = (x @ p["W"] + p["b"])[columns], state @ p["U" + side]
            z, r = sigmoid(a[:h] + g[:h]), sigmoid(a[h : 2 * h] + g[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * g[2 * h :])
            state = z * state + (1 - z) * new
            states.append(state)
        sides.append(states if side == "f" else states[::-1])
    both = [np.concatenate(s) for s in zip(*sides)]
    weight = np.exp([s @ p["att"] for s in both])
    return float((weight / weight.sum()) @ [s @ p["out"] for s in both] + p["bias"][0])


def test_scores_equal_a_plain_forward_pass():
    """Whole texts: words and n-grams looked up, every window scored one by one, the highest taken."""
    texts = [t or "" for t in messy_texts(4)][:60] + ["one", "two three"]
    net = train(texts, [i % 3 == 0 for i in range(len(texts))], epochs=1)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for text, score in zip(texts, net.score_texts(pa.array(texts))):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends, _ = letter_words(raw, np.array([0, len(raw)]))
        best = p["bias"][0]
        if len(starts):
            words, at = gru.distinct_words(raw, starts, ends)
            rows = []
            for i in range(len(words.hashes)):
                grams = [n for n in net.known_grams(words.grams[words.bounds[i] : words.bounds[i + 1]]) if n]
                chars = sum((p["gram"][n] for n in grams), np.zeros(gru.CHAR_DIM)) / np.sqrt(max(1, len(grams)))
                rows.append(np.concatenate([p["word"][net.known_words(words.hashes[i : i + 1])[0]], chars]))
            many = len(starts)
            firsts = sorted({min(k, max(0, many - gru.WINDOW)) for k in range(0, max(1, many - gru.WINDOW + gru.STRIDE), gru.STRIDE)})
            best = max(plain_logit(p, [rows[at[j]] for j in range(f, min(many, f + gru.WINDOW))]) for f in firsts)
        assert score == pytest.approx(1 / (1 + np.exp(-best)), abs=2e-4), text[:50]


def test_gradients_are_right():
    """Against finite differences of the loss, also with windows shorter than full ones."""
    net = small_network()
    words = net.known(gru.Words(np.array([3, 5, 9, 77], np.uint64), np.array([11, 12, 11, 99], np.uint64), np.array([0, 2, 3, 3, 4])))
    at = np.array([0, 1, 2, 3, 2, 1, 0] * 6)
    first, lengths = np.array([0, 5, 20]), np.array([gru.WINDOW, 3, 9])
    target = np.array([1.0, -0.5, 0.3])
    loss_of = lambda z: (float(((z - target) ** 2).sum()), 2 * (z - target))
    _, grad = net.gradients(words, at, first, lengths, loss_of)
    rng = np.random.default_rng(1)
    for name, value in net.p.items():
        g = grad[name]
        if isinstance(g, tuple):
            full = np.zeros_like(value)
            full[g[0]] = g[1]
            g = full
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in value.shape)
            old = value[i]
            losses = []
            for step in (1e-3, -1e-3):
                value[i] = old + step
                place, live = gru.window_places(at, first, lengths)
                losses.append(loss_of(net._logits(net.vectors(words) @ net.p["W"] + net.p["b"], place, live))[0])
            value[i] = old
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[i], rel=0.05, abs=2e-3), name


def test_scores_do_not_depend_on_neighbours():
    texts = messy_texts(3)
    net = train([t or "" for t in texts[:40]], [i % 2 for i in range(40)], epochs=1)
    together = net.score_texts(pa.array(texts))
    alone = np.concatenate([net.score_texts(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert len(letter_words(np.frombuffer("a1é..b".encode(), np.uint8), np.array([0, 7]))[0]) == 3


def test_one_window_is_enough():
    """A bad passage anywhere in a long text is found."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "klmn" for b in "aeiou" for c in ("ra", "to", "sin")]
    plain = lambda n: list(rng.choice(vocabulary, n))
    texts, labels = [], []
    for i in range(160):
        w = plain(int(rng.integers(20, 150)))
        if i % 2:
            for _ in range(3):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(["vileword", "nastyone"]))
        texts.append(" ".join(w))
        labels.append(i % 2)
    net = train(texts, labels)
    long = plain(3000)
    bad = long[:2100] + ["vileword", "kara", "Nastyone"] + long[2100:]
    scores = net.score_texts(pa.array([" ".join(long), " ".join(bad), "", None, "..."]))
    assert scores[0] < 0.5 < 0.7 <= scores[1]
    assert (scores[2:] < 0.7).all()


def test_edges(spark):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "doc_id bigint, toxic int")
    learn = ~held_out(F.col("doc_id"), 3, 1)
    rows = toxicity_scores(messy(spark), labels, learn).collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity_scores(empty(spark), labels, learn).count() == 0
    assert {r.score for r in toxicity_scores(messy(spark), labels.where("toxic = 0"), learn).collect()} == {0.0}
    assert toxicity_scores(clashing(spark), labels, learn).count() == len(messy_rows(1, 60))
    texts, known = training_sample(messy(spark), labels, learn, "doc_id", "text", "toxic", 5)
    assert sorted(known) == [0] * 5 + [1] * 5 and all(isinstance(t, str) for t in texts)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(F.col("doc_id"), 3, 1)
    # Only labelled documents are scored here, to keep the test short.
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity_scores(known, labels, ~out).join(labels, "doc_id").where(out)
    n = {(r.toxic, r.bad): r["count"] for r in scored.groupBy("toxic", (F.col("score") >= 0.7).alias("bad")).count().collect()}
    assert n[(1, True)] >= 0.85 * (n[(1, True)] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.02 * n[(0, False)]
