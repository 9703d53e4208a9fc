"""Tokenising whole texts with a public vocabulary, a word or a piece of a word at a time.

word_bpe_49k drops white space and splits at it, so a text's ids are its words' ids in a row. It cuts words into pieces, runs of
letters, digits or marks, by a rule that a plain text (white space, printable ASCII and the letters of Latin-1) needs no library for;
a new piece of such a text goes to the library's model directly, other texts are looked up by words, and only new words
that are not plain reach the tokenizers library. Each Python worker keeps the packed ids of the pieces and words it has met lately (two generations of MAX_WORDS at most).
"""

from __future__ import annotations

import array
import os
import re
import struct
import sys
import types

END_ID = 1
MAX_WORDS = 300_000
#: A plain text. Its letters are letters to any version of Unicode, and each is its own normal form.
_PLAIN = re.compile(rb"(?:[\x09-\x0d\x20-\x7e]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*+").fullmatch
#: The pieces of a plain text in small letters, as the vocabulary's own pattern cuts it. Letters come first as most pieces are of them.
_PIECES = re.compile(rb"[a-z\xc3\x80-\xbf]+|'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@\[-`{-~]+").findall
#: What the model reads instead of a byte: printable Latin-1 as it is, the others from U+0100 on.
_SHOWN = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_SHOWN |= {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def worker_store() -> types.ModuleType:
    """A module that lives as long as the Python worker does."""
    return sys.modules.setdefault("_sparquill_worker", types.ModuleType("_sparquill_worker"))


class _Ids(dict):
    """Piece of a plain text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokens = tokenizer, tokenizer.model.tokenize
        self.limit, self.older = MAX_WORDS, {}

    def made(self, piece: bytes) -> bytes:
        if piece.isascii():
            shown = piece.decode("ascii")
        else:
            shown = piece.decode("utf-8").lower().encode("utf-8").decode("latin-1").translate(_SHOWN)
        return array.array("I", [t.id for t in self.tokens(shown)]).tobytes()

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if (ids := self.older.get(key)) is None:
            ids = self.made(key)
        self[key] = ids
        return ids


class _WordIds(_Ids):
    """Word of any text -> its ids."""

    def __init__(self, tokenizer, pieces: _Ids):
        super().__init__(tokenizer)
        self.pieces = pieces

    def made(self, word: bytes) -> bytes:
        if (pieces := plain_pieces(word)) is not None:
            return b"".join(map(self.pieces.__getitem__, pieces))
        return array.array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()


def plain_pieces(text: bytes) -> list[bytes] | None:
    """The pieces of a plain text; None for another one, and where a special token may stand, which goes before all pieces."""
    return None if b"<|" in text or not _PLAIN(text) else _PIECES(text.lower())


def slices(batch, step: int = 1000):
    """The columns of an Arrow batch as lists, `step` rows at a time: a batch of long texts is never copied whole."""
    for at in range(0, batch.num_rows, step):
        yield [c.slice(at, step).to_pylist() for c in batch.columns]


def encoder(path: str, limit: int = MAX_WORDS):
    """text bytes (or None) -> packed ids with the end id. limit: pieces per generation that a worker keeps."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    store = worker_store()
    if getattr(store, "ids_path", None) != path:
        tokenizer = Tokenizer.from_file(path)
        store.ids = _Ids(tokenizer)
        store.word_ids, store.ids_path = _WordIds(tokenizer, store.ids), path
    ids, word_ids, end = store.ids, store.word_ids, struct.pack("<I", END_ID)
    ids.limit, word_ids.limit = limit, min(limit, MAX_WORDS)

    def encode(text: bytes | None) -> bytes:
        if not text:
            return end
        if (pieces := plain_pieces(text)) is not None:
            return b"".join(map(ids.__getitem__, pieces)) + end
        # the vocabulary lower-cases; a special token's string keeps its case
        words = text.split() if b"<|" in text else text.lower().split()
        return b"".join(map(word_ids.__getitem__, words)) + end

    return encode
