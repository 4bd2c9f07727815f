"""Texts to token ids with a public tokenizer, exactly and once per word.

Both tokenizers cut text at white space before anything else. So where the only
white space is single spaces and line feeds, a text is its parts between spaces,
each encoded with the space before it, and a part seen before need not be encoded
again. Texts with other white space, or runs with a space, go through whole.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

PARTS = 1 << 19  # parts a worker remembers for sure, and as many of the ones before
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_TAIL = re.compile(r"(.+?)([.,;:!?%&*#$]+|\n.*)", re.DOTALL)


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable
    Latin-1 characters stand for themselves, the rest for those from 256 on."""
    plain_bytes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain_bytes]
    return {b: chr(b) for b in plain_bytes} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers, with an end id: those of the
    library's plain call. A text that holds the string of an added token, in any case, goes
    to it whole."""

    def __init__(self, file: str, end: int):
        self.tokenizer, self.end, self.before = Tokenizer.from_file(file), array("I", [end]).tobytes(), {}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.tokenize, self.space = self.model.tokenize, self.letters[32]
        self.folds = self.tokenizer.normalizer is not None

    def __missing__(self, part: str) -> bytes:
        """Part after a space. Punctuation at its end, or what follows a line feed in
        it, is a word of its own to both tokenizers; it is kept under a leading space."""
        got = self.before.get(part)
        if got is None:
            if part.isalpha() and (part.isascii() or max(part) <= "\xff"):
                got = self.word(part)
            elif part[:1] == " ":
                got = self.whole(part[1:])
            else:
                cut = _TAIL.fullmatch(part)
                if cut and (cut[1][-1].isalpha() or cut[2][0] == "\n"):
                    got = self[cut[1]] + self[" " + cut[2]]
                else:
                    got = self.whole(" " + part)
        if len(self) >= PARTS:
            self.before = dict(self)
            self.clear()
        self[part] = got
        return got

    def word(self, word: str) -> bytes:
        """A word of Latin-1 letters after a space: to both tokenizers one piece, so it
        can go to the library's merge model at once. The vocabulary that folds case
        drops the space, the other keeps it."""
        raw = word.lower() if self.folds else " " + word
        if not raw.isascii():
            raw = raw.encode().decode("latin-1").translate(self.letters)
        elif not self.folds:
            raw = self.space + word  # ASCII letters stand for themselves
        return array("I", [t.id for t in self.tokenize(raw)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not plain(text) or any(map(text.lower().__contains__, self.added)):
            return self.whole(text) + self.end
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest)) + self.end


@cache
def encoder(file: str, end: int) -> Encoder:
    """One per worker process, so that tasks share what it remembers."""
    return Encoder(file, end)


def plain(text: str) -> bool:
    """Whether all white space is line feeds and single spaces between others."""
    return (
        not any(map(text.__contains__, _OTHER_SPACE))
        and "  " not in text
        and "\n " not in text
        and " \n" not in text
        and text[0] != " "
        and text[-1] != " "
    )


def texts(batch: pa.RecordBatch, text: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(text)).to_pylist()


def lists(rows: list[bytes]) -> pa.Array:
    """Rows of ids as an Arrow list column, without a copy for each id."""
    ends = np.cumsum([0] + [len(x) // 4 for x in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))
