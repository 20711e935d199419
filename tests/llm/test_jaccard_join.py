from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, empty, messy, messy_rows, messy_texts, words
from tracegrid.llm import jaccard_join
from tracegrid.llm.graph import components
from tracegrid.llm.jaccard_join import near_duplicates
from tracegrid.llm.shingles import shingle_sets
from tracegrid.llm.trie_join import trie_links

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_set(text):
    w = [x.translate(UPPER) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def plain_components(rows):
    """Smallest id reachable, by row."""
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if similar(sets[i], sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    got = sorted(map(tuple, near_duplicates(messy(spark, seed)).collect()), key=str)
    assert got == plain_components(messy_rows(seed))


def test_clusters_in_parts(spark, monkeypatch):
    """Clusters far above the size joined at once are dealt in parts and lose nothing."""
    monkeypatch.setattr(jaccard_join, "CLUSTER", 4)
    got = sorted(map(tuple, near_duplicates(messy(spark, 3)).collect()), key=str)
    assert got == plain_components(messy_rows(3))


@pytest.mark.parametrize("cluster", [4, 4000])
def test_every_link(spark, monkeypatch, cluster):
    """All links between different sets, each once."""
    monkeypatch.setattr(jaccard_join, "CLUSTER", cluster)
    classes = jaccard_join.shingle_classes(messy(spark, 6), "doc_id", "text")
    links = jaccard_join.similar_links(jaccard_join.candidate_sets(classes), every=True).collect()
    sets = list({frozenset(plain_set(r[1])) for r in messy_rows(6)})
    assert len(links) == len(set(links)) == sum(similar(a, b) for a, b in combinations(sets, 2)) > 10


def test_every_link_in_a_trie():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 60, 25)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.92], rng.integers(0, 60, 2)])) for b in base for _ in range(12)]
    extra = rng.integers(0, 3, len(sets))  # tokens no other set has
    sizes = np.array([len(s) for s in sets]) + extra
    want = set()
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 4 * both >= 3 * (sizes[i] + sizes[j] - both):
            want.add((i, j))
    got = {tuple(sorted(x)) for x in trie_links(sets, sizes, 3, 4, every=True)}
    assert got == want and len(want) > 20
    few = list(trie_links(sets, sizes, 3, 4))
    assert {tuple(sorted(x)) for x in few} <= want and len(few) < len(want)


def test_shingle_hashes():
    texts = messy_texts(4)
    sets = []
    for _, bounds, tokens in shingle_sets(pa.array(texts)):
        sets += [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    plain = [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i, j in combinations(range(len(texts)), 2):
        assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_components_of_a_graph(spark):
    chain = [(i, i + 1) for i in range(200, 260)] + [(5, 900), (900, 7), (3, 3), (7, 5)] + [(1000, x) for x in range(1001, 1100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {found[i] for i in range(200, 261)} == {200}
    assert found[900] == found[7] == found[5] == 5
    assert {found[i] for i in range(1000, 1100)} == {1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edges(spark):
    assert near_duplicates(empty(spark)).count() == 0
    out = near_duplicates(clashing(spark))
    assert sorted(map(tuple, out.collect()), key=str) == plain_components(messy_rows(1, 60))


@pytest.mark.parametrize("kind", ["<u8", "<i8", "<i4", "<u4"])
def test_byte_planes(kind):
    """Several runs of values, empty ones too, come back in order."""
    rng = np.random.default_rng(4)
    info = np.iinfo(kind)
    runs = [rng.integers(info.min, info.max, n, dtype=kind, endpoint=True) for n in (5, 0, 1, 300)]
    got = jaccard_join._values([jaccard_join._planes(r, kind) for r in runs], kind)
    assert got.dtype == np.dtype(kind) and got.tolist() == np.concatenate(runs).tolist()
    assert len(jaccard_join._values([], kind)) == 0
