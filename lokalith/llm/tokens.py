"""Cached encoding of whole texts with a public tokenizer file.

Byte-pair encoding does not look past a pre-token. So texts are cut into pieces of one or more whole pre-tokens,
the pieces of many texts are numbered by Arrow, only distinct pieces are looked up, and only those not seen
before go to the tokenizers library. Texts with control separators, which count as white space in one place and
not in another, take the library's own path. Ids are exactly those of
``Tokenizer.encode(text, add_special_tokens=False)`` with special strings taken as ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_CONTROL = re.compile(r"[\x1c-\x1f]")
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe, which may start a pre-token of its own
_PIECES = re.compile(rf" ?[{_LETTERS}]+(?=[{_MARKS}]*(?:\s|$))|[{_MARKS}]+(?=\s|$)| ?\S+|\s+(?!\S)|\s")
_WORDS = re.compile(rf"[{_LETTERS}]+(?=[{_MARKS}]*(?:\s|$))|[{_MARKS}]+(?=\s|$)|\S+")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+|[{_MARKS}]+")
#: Pieces that the cache may hold; a full one starts anew, so memory stays bounded and results do not depend on it.
PIECE_ENTRIES = 500_000
#: Characters of text, about, whose pieces are numbered at once; longer texts are taken alone.
BLOCK_CHARS = 2 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    return table | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in table)}


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Knows the two byte-level pre-tokenizers of the public files."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        config = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.folds = config["normalizer"] is not None
        self.letters = _byte_letters()
        self.widths: np.ndarray | None = None
        self.pieces = _Cache(self._piece, PIECE_ENTRIES)
        self.cut = (_WORDS if self.folds else _PIECES).findall

    def _piece(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self.whole(piece)
        if self.folds:
            piece = piece.lower()
        if piece.isascii():
            return _little([t.id for t in self.model.tokenize(piece.replace(" ", self.letters[32]))])
        raw = piece.encode()
        return _little([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))])

    def whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, block by block."""
        out, at, size = [], 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= BLOCK_CHARS or k == len(texts):
                out += self._block(texts[at:k])
                at, size = k, 0
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        alone = {k: self.whole(t) for k, t in enumerate(texts) if _CONTROL.search(t)}
        pieces, ends = [], [0]
        for k, text in enumerate(texts):
            if k not in alone:
                pieces += self.cut(text)
            ends.append(len(pieces))
        numbered = pa.array(pieces, pa.string()).dictionary_encode()
        found = list(map(self.pieces.__getitem__, numbered.dictionary.to_numpy(zero_copy_only=False).tolist()))
        data, sizes = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = numbered.indices.to_numpy()
        n = sizes[number]
        until = np.concatenate([[0], np.cumsum(n)])
        ids = data[np.repeat((np.cumsum(sizes) - sizes)[number] - until[:-1], n) + np.arange(until[-1])]
        cuts = until[ends].tolist()
        return [alone[k] if k in alone else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def spans(self, text: str) -> np.ndarray:
        """Character spans ``(start, end)`` of the ids of ``text``, as the library's offsets."""
        return next(self.spans_many([text]))

    def spans_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The spans of each text.

        Without a normalizer the tokens' bytes are the text's bytes, so ends follow from their lengths; a token
        that holds part of a character spans that character.
        """
        if self.folds:
            for text in texts:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
            return
        if self.widths is None:
            vocabulary = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        for text, ids in zip(texts, self.encode_many(texts), strict=True):
            width = self.widths[np.frombuffer(ids, dtype="<u4")]
            ends = np.cumsum(width)
            place = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
            yield np.stack([place[ends - width], place[ends - 1] + 1], axis=1) if len(ends) else np.zeros((0, 2), dtype=np.int64)


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process; its caches serve all tasks of the process."""
    return Encoder(path)
