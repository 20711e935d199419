import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, empty, messy, messy_rows
from tracegrid.llm.alignment import BYTE_BPE, PIECE_BPE, align_tokens, common_and_links, gallop
from tracegrid.llm.queries import QUERIES
from tracegrid.llm.tokenizer_files import by_words, byte_bpe, piece_bpe

ODD = ["a▁b", "<|endoftext|> x <s> y </s> <unk> <0x41>", "  two  spaces \n\n tab\t", "日本語 Ünïcödé 🦆🦆", " ", "\n", "'s 've I'll", "\x00\x1f​", "क्षि ١٢٣"]


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), token by token."""
    a_model = Tokenizer.from_file(BYTE_BPE)
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=PIECE_BPE)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in printable}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found, held = [], Counter()
    for text in texts:
        links, groups = [], []
        ids_a = ids_b = []
        if text:
            ids_a = a_model.encode(" " + text, add_special_tokens=False).ids
            ids_b = b_model.encode(text)
            bytes_a = [bytes(letter[c] for c in a_model.id_to_token(i)) for i in ids_a]
            names = [b_model.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(n[3:5], 16)]) if b_model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
            raw = (" " + text).encode()
            if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
                ids_a = ids_b = []
        if ids_a:
            spans = []
            for pieces in (bytes_a, bytes_b):
                at, own = 0, []
                for p in pieces:
                    own.append((at, at + len(p)))
                    at += len(p)
                spans.append(own)
            ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            parts = [defaultdict(list), defaultdict(list)]
            for side, ids in ((0, ids_a), (1, ids_b)):
                for i, (_, e) in zip(ids, spans[side]):
                    parts[side][bisect.bisect_left(ends, e)].append(str(i))
            groups = [",".join(parts[0][g]) + "|" + ",".join(parts[1][g]) for g in range(len(ends))]
            at = 0
            for i, (s, e) in zip(ids_a, spans[0]):
                while spans[1][at][1] <= s:
                    at += 1
                k = at
                while k < len(ids_b) and spans[1][k][0] < e:
                    links.append((i, ids_b[k]))
                    k += 1
            held.update(set(links))
        found.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(n_a, n_b, g, len(ls), sum(held[x] == best[x[0]] for x in ls), sum(held[x] for x in ls), said) for n_a, n_b, g, ls, said in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("chunk_bytes", [1, 3000, 1 << 24])
def test_equals_brute_force(spark, chunk_bytes):
    rows = [*messy_rows(), *((1000 + i, t, "en", "s", 1) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame(rows, messy(spark).schema)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))), key=repr)
    got = align_tokens(docs, chunk_bytes=chunk_bytes).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert want[0][1] and any(r[1] == 0 and r[0] == 1000 for r in want)


def test_digest_names_and_no_rows(spark):
    rows = messy_rows(1, 60)
    want = sorted(((r[0], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for r, w in zip(rows, brute([r[1] for r in rows]))), key=repr)
    got = align_tokens(clashing(spark), digest=True).select("doc_id", "groups").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert align_tokens(empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows]))}
    got = QUERIES["op11_align_tokens"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        *numbers, said = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(said.encode()).hexdigest() if said else "")


@pytest.mark.parametrize("seed", range(20))
def test_gallop(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    total = n * int(rng.integers(1, 30)) + 1
    a, b = (np.unique(np.append(rng.integers(1, total, k), total)) for k in (n, int(rng.integers(1, 3000))))
    assert (gallop(a, b) == np.searchsorted(b, a)).all()
    common_a, common_b, x, y = common_and_links(a, b)
    assert set(a[common_a]) == set(b[common_b]) == set(a) & set(b)
    start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    assert (np.maximum(start_a[x], start_b[y]) < np.minimum(a[x], b[y])).all()
    assert len(set(zip(x.tolist(), y.tolist()))) == len(x)
    # Two cuts of one stretch overlap in as many pairs as the cut by all ends has pieces.
    assert len(x) == len(np.union1d(a, b))


def test_ids_equal_those_of_the_tokenizers():
    model = Tokenizer.from_file(BYTE_BPE)
    model.encode_special_tokens = True
    pieces_model = SentencePieceProcessor(model_file=PIECE_BPE)
    encode, pieces = byte_bpe(BYTE_BPE)
    rng = random.Random(3)
    letters = [" ", " ", "\n", "\t", "\r\n", "a", "bc", "Über", "日本", "▁", "\x1c", "\x85", "\u3000", "'s", "12", "<s>", "!", "🦆", "<0x0A>"]
    texts = [r[1] or "" for r in messy_rows(5)] + ODD + [" " * 5000, "x" * 5000, "é" * 3000 + "  "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    for lead in ("", " "):
        some = [lead + t for t in texts]
        for text, ids, want in zip(some, encode(some), model.encode_batch(some, add_special_tokens=False)):
            assert ids.tolist() == want.ids, text
            assert b"".join(pieces[i] for i in ids) == text.encode()
    for text, ids, want in zip(texts, piece_bpe(PIECE_BPE)[0](texts), pieces_model.encode(texts)):
        assert ids.tolist() == want, text
    assert piece_bpe(PIECE_BPE)[1][3:5] == [b"\x00", b"\x01"]


def test_words_are_looked_up_and_forgotten():
    asked = []

    def spaced(texts):
        asked.append(list(texts))
        return [list(t.encode()) for t in texts]

    encode = by_words(spaced, most=4)
    assert [len(x) for x in encode(["ab cd", "ab\n cd", "cd  ab", ""])] == [4, 5, 6, 0]
    assert sorted(asked[0]) == ["ab", "ab\n", "cd"] and asked[1] == ["cd  ab", ""]
    encode(["ab x y z"])
    assert sorted(asked[2]) == ["ab", "x", "y", "z"]
    assert [x.tolist() for x in by_words(spaced, apart=False)(["a b", "a b"])] == [[97, 32, 98]] * 2
