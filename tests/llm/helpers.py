"""Small inputs with everything that may go wrong, and plain forms of what the operators work out."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = DOCS + ", size int, kept string, score string, `n.words` int, id string, target int, ends int, tokens string, component_id int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def messy_texts(seed=1, n=120):
    """Ordinary, near and exact copies, repeated lines, short, long, blank, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "Ça", "日本", "a b", "THE", "x*#"]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = []
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.5 or not texts:
            texts.append("\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 8))))
        elif kind < 0.7:
            base = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
        elif kind < 0.8:
            texts.append(rng.choice(texts))
        elif kind < 0.9:
            texts.append(rng.choice(texts) + "\n" + line(5) + "\n" + line(5).upper())
        else:
            again = line(rng.randint(2, 9))
            texts.append("\n".join([again] * rng.randint(2, 30)))
    return texts + ["", None, " \t\n", "one", "one two three four", "one two three four five", "One Two THREE four", line(6000)]


def messy_rows(seed=1, n=120):
    """Rows of DOCS: some ids, languages and sources are null, some rows come twice."""
    rng = random.Random(seed + 100)
    rows = []
    for i, text in enumerate(messy_texts(seed, n)):
        source = None if i % 17 == 0 else ("big" if rng.random() < 0.4 else f"s{rng.randrange(6)}")
        rows.append((i, text, None if i % 13 == 0 else rng.choice(["en", "fr"]), source, len(text or "")))
    return rows + rows[3:6] + [(None, "no id here at all", "en", "s1", 17), (None, None, None, None, None)]


def messy(spark, seed=1, n=120):
    return spark.createDataFrame(messy_rows(seed, n), DOCS)


def clashing(spark, seed=1, n=60):
    """The same with columns named like the operators' results."""
    rows = [(*r, 7, "kept?", "score?", 9, "id?", 11, 12, "tok", 13) for r in messy_rows(seed, n)]
    return spark.createDataFrame(rows, CLASHING)


def empty(spark):
    return spark.createDataFrame([], DOCS)
