import random

from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, clashing, empty, messy, messy_rows, words
from tests.llm.test_jaccard_join import plain_set, similar
from tracegrid.llm import queries
from tracegrid.llm.packing import best_fit, pack


def plain_pack(pieces, capacity):
    """For each piece the compatible bin with the least room that is enough; ties to the older bin."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [
            (b["room"], i) for i, b in enumerate(bins)
            if b["room"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])
        ]
        if not fits:
            bins.append({"room": capacity, "s": set(), "c": set()})
        i = min(fits)[1] if fits else len(bins) - 1
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= size
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(30):
        pieces = [(rng.randint(1, 50), rng.choice([None, *range(6)]), rng.choice([None, *range(20)])) for _ in range(80)]
        pieces.sort(key=lambda p: -p[0])
        bins, places, opened = pack(*map(list, zip(*pieces, strict=True)), capacity=50)
        assert list(zip(bins, places, strict=True)) == plain_pack(pieces, 50)
        assert opened == max(bins) + 1


def check(pieces, rows, capacity):
    """Whole documents, bins that hold what they hold without overlap or conflict."""
    got = {}
    for p in pieces:
        got.setdefault(str(p.doc_id), []).append(p)
    sizes = {}
    for r in rows:
        sizes.setdefault(str(r[0]), []).append(len(words(r[1])))
    assert {k: sum(p.n_words for p in v) for k, v in got.items()} == {k: sum(v) for k, v in sizes.items()}
    by_id = {r[0]: r for r in rows}
    bins = {}
    for p in pieces:
        assert (p.bin is None) == (p.n_words == 0)
        if p.bin is not None:
            bins.setdefault(p.bin, []).append(p)
    for own in bins.values():
        at = 0
        for p in sorted(own, key=lambda p: p.place):
            assert p.place == at
            at += p.n_words
        assert at <= capacity
        ids = [p.doc_id for p in own]
        sources = [by_id[i][3] for i in ids if by_id[i][3] is not None]
        texts = [by_id[i][1] for i in ids if by_id[i][1] is not None]
        assert len(sources) == len(set(sources)) and len(texts) == len(set(texts))


def test_best_fit(spark):
    rows = [r for r in messy_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, DOCS)
    check(best_fit(docs, capacity=100).collect(), rows, 100)
    check(best_fit(docs).collect(), rows, 2048)
    assert best_fit(docs, capacity=100).where("from_word <> piece * 100").count() == 0


def test_copies_never_share_a_bin(spark):
    rows = [(i, "the same words again and again", "en", None, 1) for i in range(300)] + [(i, f"w {i}", "en", None, 1) for i in range(300, 400)]
    pieces = best_fit(spark.createDataFrame(rows, DOCS)).collect()
    check(pieces, rows, 2048)
    assert len({p.bin for p in pieces}) == 300


def test_edges(spark):
    assert best_fit(empty(spark)).count() == 0
    assert best_fit(clashing(spark)).select("doc_id").distinct().count() == len({r[0] for r in messy_rows(1, 60)})
    none = best_fit(messy(spark).where("text is null or trim(text) = ''")).where(F.col("bin").isNotNull())
    assert none.where("n_words = 0").count() == 0


def test_near_copies_never_share_a_bin(spark, tmp_path):
    rng = random.Random(11)
    rows, base = [], []
    for i in range(160):
        if i % 4 == 0:
            base = [f"w{rng.randrange(500)}" for _ in range(60)]
        text = [*base[:-1], f"last{i}"]  # near copies, no equal ones
        rows.append((i, " ".join(text), "en", [None, f"s{i}"][i % 2], 1))
    rows += rows[8:12] + [(8, "another text of the same id", "en", None, 1), (None, rows[0][1], "en", None, 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = queries.QUERIES["op9_best_fit_packing"](spark, str(tmp_path)).collect()
    assert len(pieces) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault((r[0], len(words(r[1]))), plain_set(r[1]))
    bins = {}
    for p in pieces:
        bins.setdefault(p.bin, []).append(texts[p.doc_id, p.n_words])
    assert not any(similar(a, b) for own in bins.values() for i, a in enumerate(own) for b in own[:i])
    assert max(map(len, bins.values())) > 1
