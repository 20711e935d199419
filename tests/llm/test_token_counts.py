import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, empty, messy, messy_rows
from tracegrid.llm.token_counts import TOKENIZER, read_token_files, separator_scan, token_counts, write_token_stream

END = 50256


def plain_counts(rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return sorted(((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)


def test_counts(spark):
    rows = [*messy_rows(), (900, "a <|endoftext|> b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, messy(spark).schema)
    assert sorted(map(tuple, token_counts(docs).collect()), key=str) == plain_counts(rows)
    assert sorted(map(tuple, token_counts(clashing(spark)).collect()), key=str) == plain_counts(messy_rows(1, 60))
    assert token_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("block_tokens", [1, 3, 7, 64])
def test_documents_across_blocks(spark, block_tokens):
    rows = messy_rows(2, 12)[:18]
    docs = spark.createDataFrame(rows, messy(spark).schema)
    blocks, order = write_token_stream(docs, block_tokens=block_tokens)
    found = order.join(separator_scan(blocks), ["file", "doc"]).select("doc_id", "n_tokens")
    assert sorted(map(tuple, found.collect()), key=str) == plain_counts(rows)


@pytest.mark.parametrize("block_tokens", [2, 5, 1000])
def test_flat_files(spark, tmp_path, monkeypatch, block_tokens):
    """Files as other programs write them, with an open end, without separators, empty."""
    monkeypatch.setattr("tracegrid.llm.token_counts.STRETCH", 3)
    rng = np.random.default_rng(4)
    want = []
    for name, lengths, tail in (("a", rng.integers(0, 30, 40), 0), ("b", [0, 0, 3], 9), ("c", [], 50), ("d", [], 0), ("e", [90, 0, 1], 0)):
        stream = np.concatenate([np.append(rng.integers(0, END, n), END) for n in lengths] + [rng.integers(0, END, tail)])
        (tmp_path / f"{name}.bin").write_bytes(stream.astype("<u2").tobytes())
        want += [(name, i, int(n), True) for i, n in enumerate(lengths)] + ([(name, len(lengths), tail, False)] if tail else [])
    blocks = read_token_files(spark, str(tmp_path), block_tokens=block_tokens)
    got = [(r.file[-5], r.doc, r.n_tokens, r.closed) for r in separator_scan(blocks).collect()]
    assert sorted(got) == sorted(want)
