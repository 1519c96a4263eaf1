"""Whole-text encoding with a public tokenizer file; equal word pieces are encoded once per worker."""

from __future__ import annotations

import gc
import os
import re
import string
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs one task per core

#: What a tokenizer does with a space before a word: part of the token, or dropped.
LEADING, DROPPED = "leading", "dropped"

#: Letters (unchanged by NFC, of simple case), signs, and perhaps a line feed with letters and signs after it.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;<=>?@^_~-]{1,9})?(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;<=>?@^_~-]{1,9})?)?")
#: Byte-level vocabularies write bytes that do not print as the letters from U+0100 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in _PRINTED)}

_SPACE_LETTER = chr(_BYTE_LETTERS[32])
#: Bytes of the memo of a worker process: more of it takes less time.
MEMO_BYTES = 256 << 20
_PUNCTUATION = frozenset(string.punctuation)
_ENTRY_BYTES = 160
_encoders: dict[tuple, "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    The tokenizers in use split a text by a pattern before merging, and no piece of that pattern reaches
    over a single space before a visible character. Cutting a text at such spaces and joining the ids of
    the pieces therefore gives the ids of the whole text; ``tests/llm`` compares both on random texts.
    Texts that may hold a string of an added token go to the tokenizer whole, which then does what it does by default.
    The memo holds about ``memo_bytes``: when half of that is full it becomes the old generation, from which pieces that
    occur again are taken over.
    """

    def __init__(self, path: str, spaces: str | None, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces, self.memo_bytes = spaces, memo_bytes
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.prefix = os.path.commonprefix(self.added)
        self.signs: dict[str, bytes] = {}
        self.feed = self._word("\n") if spaces == LEADING else b""
        self.memo, self.held = _Memo(self), 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that stand alone."""
        out: list[bytes] = []
        for i in range(0, len(texts), 4096):
            found = self.tokenizer.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)
            out += [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]
        return out

    def _word(self, word: str) -> bytes:
        """Ids of one unit of the split pattern, straight from the library's merge model."""
        if not word.isascii() or word[0] <= " ":
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [x.id for x in self.tokenizer.model.tokenize(word)]).tobytes()

    def _spaced(self, word: str, found: dict[str, bytes]) -> bytes:
        """Ids of a word after a space; the word becomes a piece of its own."""
        if self.spaces == DROPPED:
            word = word.lower()
        ids = found.get(word) or self.memo.get(word)
        if not ids:
            if self.spaces == DROPPED:
                ids = self._word(word)
            elif word.isascii():
                ids = array("I", [x.id for x in self.tokenizer.model.tokenize(_SPACE_LETTER + word)]).tobytes()
            else:
                ids = self._word(" " + word)
            found[word] = ids
        return ids

    def _holds_added(self, text: str) -> bool:
        """Whether a text may hold an added token; their common beginning rules most texts out."""
        if not self.added or self.prefix and self.prefix == self.prefix.upper() and self.prefix not in text:
            return False
        low = text.lower()
        return any(x in low for x in self.added)

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        odd = []
        for piece in pieces:
            if piece.isascii() and piece.isalpha():
                found[piece] = self._spaced(piece, found)
                continue
            match = _SIMPLE.fullmatch(piece)
            if not match:
                odd.append(piece)
                continue
            word, sign, feed, second, last = match.groups()
            ids = self._spaced(word, found)
            for unit in (sign, last):
                if unit and unit not in self.signs:
                    self.signs[unit] = self._word(unit)
            if sign:
                ids = ids + self.signs[sign]
            if feed:
                ids += self.feed + (self._word(second) if self.spaces == LEADING else self._spaced(second, found))
            if last:
                ids += self.signs[last]
            found[piece] = ids
        lead = " " if self.spaces == LEADING else ""
        found.update(zip(odd, self._encode([lead + x for x in odd])))
        return found

    def _starts_piece(self, piece: str) -> bool:
        """Whether the space before ``piece`` is surely a boundary; else it stays with the text before it."""
        return self.spaces == DROPPED or bool(piece) and (piece[0].isalnum() or piece[0] in _PUNCTUATION)

    def _unusual(self, head: str, tails: list[str]) -> bytes:
        """A text with runs of spaces or unusual characters after a space."""
        parts, now = [], head
        for tail in tails:
            if self._starts_piece(tail):
                parts.append(now)
                now = " " + tail
            else:
                now += " " + tail
        return b"".join(self._encode([*parts, now]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        # nothing here is in a cycle, so the collector would only walk the lists in vain
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_all(self, texts: list[str | None]) -> list[bytes]:
        if self.spaces is None:
            return self._encode([x or "" for x in texts])
        if self.held > self.memo_bytes // 2:
            self.memo.old = {}
            self.memo, self.held, self.signs = _Memo(self, self.memo), 0, {}
        memo, held = self.memo, []
        for x in texts:
            head, *tails = [x] if x and self._holds_added(x) else (x or "").split(" ")
            held.append((head, tails, list(map(memo.__getitem__, tails))))
        found = self._encode_pieces(list(memo.new))
        for piece, cell in memo.new.items():
            cell += found[piece]
        memo.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + _ENTRY_BYTES * len(found)
        memo.new = {}
        heads = self._encode([x[0] for x in held])
        out = []
        for first, (head, tails, cells) in zip(heads, held):
            try:
                out.append(first + b"".join(cells))
            except TypeError:  # a piece without ids of its own
                out.append(self._unusual(head, tails))
        return out


class _Memo(dict):
    """Ids by piece. A piece that is missing gets an empty cell, which is filled once the texts are split."""

    def __init__(self, coder: PieceEncoder, old: dict[str, bytes | None] | None = None):
        super().__init__()
        self.coder, self.old, self.new = coder, old or {}, {}

    def __missing__(self, piece: str) -> bytes | bytearray | None:
        if self.old and piece in self.old:
            value = self.old[piece]
            self.coder.held += len(piece) + len(value or b"") + _ENTRY_BYTES
        elif piece.isalpha() or self.coder._starts_piece(piece):
            value = self.new[piece] = bytearray()
        else:
            value = None
            self.coder.held += len(piece) + _ENTRY_BYTES
        self[piece] = value
        return value


def encoder(path: str, spaces: str | None, memo_bytes: int = MEMO_BYTES) -> PieceEncoder:
    """One encoder per worker process, kept between tasks."""
    key = path, spaces, memo_bytes
    if key not in _encoders:
        release()
        _encoders[key] = PieceEncoder(path, spaces, memo_bytes)
    return _encoders[key]


def release() -> None:
    """Drop the encoders of this worker process; other work in it needs their memory."""
    _encoders.clear()
