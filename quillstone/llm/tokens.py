"""Token ids of whole texts by the tokenizers library, with a bounded memo of words in each Python worker.

A byte-level BPE splits a text before it merges, and it always splits where white space follows something
else. So a text is cut before such spaces and line feeds, and a worker encodes each distinct part once. A part of Latin letters alone is one piece to the splitter, so it goes to the BPE model without it; letters with a
stop, comma or the like at the end, or a line feed before them, are two pieces that are looked up apart. The library encodes the
other parts. Parts of over 48 characters are never kept. The memo is bounded in bytes and has two generations: a part that is used moves to the young one, and when that is
full it becomes the old one, so that parts that are rare go and common ones stay.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
LONG = 48
MARKS = ".,;:!?"
#: bytes that an entry of the memo takes besides its two strings: their headers, and a dictionary's row
ENTRY = 180


def _alphabet() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself where it can be seen, or else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _latin(part: str) -> bool:
    """Letters alone, of the part of Unicode on which all versions agree."""
    return part.isalpha() and (part.isascii() or max(part) < "\u0250")


class Memo(dict):
    """The ids, as bytes, of parts that `prefix` stands before; what is not there is encoded when it is asked for. `odd` is set when a part can't be looked up by itself."""

    def __init__(self, encoder: Encoder, prefix: str):
        self.encoder, self.prefix, self.old, self.held, self.odd = encoder, prefix, {}, 0, False

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if self.prefix and (not part or part[-1].isspace()):
                self.odd = True  # more white space follows: the splitter would look at both together
                return b""
            ids = self.encoder.encoded(part, self)
            if len(part) > LONG:
                return ids
        self[part] = ids
        self.held += ENTRY + len(part) + len(ids)
        return ids

    def turn(self, most: int) -> None:
        """A new young generation if this one is full."""
        if self.held > most:
            self.old = dict(self)
            self.clear()
            self.held = 0


class Encoder:
    """Special tokens' strings are ordinary text. `dtype`: the smaller of 2 and 4 bytes that holds every id."""

    def __init__(self, path: str, memo_bytes: int = 192 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.kind = "H" if largest < 1 << 16 else "I"
        self.model, self.alphabet = self.tokenizer.model, _alphabet()
        self.memo_bytes, self.plain, self.spaced = memo_bytes, Memo(self, ""), Memo(self, " ")
        self.marks = {m: self._library(m) for m in MARKS}
        self.feed = self._library("\n")

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _library(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encoded(self, part: str, memo: Memo) -> bytes:
        """A part that the memo does not have."""
        if _latin(part):
            mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            return self._bytes([t.id for t in self.model.tokenize(self.alphabet[32] + mapped if memo.prefix else mapped)])
        first, last = part[:1], part[-1:]
        if last in self.marks and _latin(part[:-1]):
            return memo[part[:-1]] + self.marks[last]
        if first == "\n" and _latin(part[1:].rstrip(MARKS) or "\n") and len(part) - len(part.rstrip(MARKS)) < 2:
            return self.feed + self.plain[part[1:]]
        if first == " " and not memo.prefix and _latin(part[1:]):
            return self.spaced[part[1:]]
        return self._library(part if first == "\n" else memo.prefix + part)

    def raws(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes of `dtype`."""
        out, plain, spaced = [], self.plain, self.spaced
        after, alone, join = spaced.__getitem__, plain.__getitem__, b"".join
        for x in texts:
            # of both memos there are two generations
            spaced.turn(self.memo_bytes * 3 // 8)
            plain.turn(self.memo_bytes // 8)
            first, *rest = x.replace("\n", " \n").split(" ")
            odd = bool(first) and bool(rest) and first[-1].isspace()
            if not odd:
                spaced.odd = False
                ids = join(map(after, rest))
                odd = spaced.odd
            if odd:
                out.append(join(map(alone, _CUT.split(x))))
            else:
                out.append(alone(first) + ids if first else ids)
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo_bytes: int = 192 << 20) -> Encoder:
    """This worker's encoder for a vocabulary file; `memo_bytes`: what its memo may take, in each worker of an executor. A larger memo encodes fewer parts anew."""
    if (path, memo_bytes) not in _encoders:
        _encoders[path, memo_bytes] = Encoder(path, memo_bytes)
    return _encoders[path, memo_bytes]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
