"""Tokenizers from files: ids of whole texts, and the bytes of every id.

A byte-level BPE file is run by ``tiktoken``, which wants merges in the order of
their ids; a file with another order, another splitting rule or a normalizer is run
by ``tokenizers`` itself. Both give the same ids. Special tokens' strings inside
texts are ordinary text.

Word pieces that come again are looked up. A text may be cut before a space that
follows a character other than a space where no piece holds the mark of a word's
beginning after another character, for then no merge reaches across; the ids of the
whole are those of the parts. A text with several spaces in a row, or with that mark
in it, is not cut. (For the byte-level BPE the lookup takes longer than the merges.)
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Sequence

import numpy as np

Encode = Callable[[Sequence[str]], list[np.ndarray]]
# Words kept at a time by an encoder: some 50 MB.
MOST_WORDS = 300_000

# Fixed value: how a byte-level BPE splits texts before it merges.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def by_words(spaced: Callable[[list[str]], list[list[int]]], most: int = MOST_WORDS, apart: bool = True) -> Encode:
    """An encoder of texts with a space before each that looks up words that come again."""
    known: dict[str, bytes] = {}

    def ids_of(texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in spaced(texts)] if texts else []

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        parts = [[] if not apart or "  " in t or "▁" in t or t[:1] in ("", " ") or t[-1] == " " else t.split(" ") for t in texts]
        words = set().union(*parts)
        new = list(words.difference(known))
        if len(known) + len(new) > most:
            known.clear()
            new = list(words)
        known.update(zip(new, ids_of(new), strict=True))
        whole = iter(ids_of([t for t, own in zip(texts, parts, strict=True) if not own]))
        raw = (b"".join(map(known.__getitem__, own)) if own else next(whole) for own in parts)
        return [np.frombuffer(r, dtype=np.uint32) for r in raw]

    return encode


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves; the others, in order, are the letters from U+0100.
    """
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _in_id_order(model: dict) -> bool:
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:]))


def _by_tokenizers(path: str) -> Encode:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, dtype=np.uint32) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def byte_bpe(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder of a byte-level BPE file and the bytes of each id (none for special ones)."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, before, letters = said["model"], said["pre_tokenizer"] or {}, _byte_letters()
    pieces = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in said["added_tokens"])]))
    for piece, i in model["vocab"].items():
        pieces[i] = bytes(letters[c] for c in piece)
    splits = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if said["normalizer"] or not splits or not _in_id_order(model):
        return _by_tokenizers(path), pieces
    import tiktoken

    ranks = {piece: i for i, piece in enumerate(pieces) if piece}
    fast = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [fast.encode_to_numpy(t, disallowed_special=()) for t in texts], pieces


def piece_bpe(path: str) -> tuple[Encode, list[bytes]]:
    """The same of a sentence-piece model, which puts a space before each text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(len(model))]
    pieces = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    spaced = lambda texts: model.encode(texts, num_threads=1)
    apart = not any("▁" in n.lstrip("▁") for n in names)
    return by_words(spaced, apart=apart), pieces
