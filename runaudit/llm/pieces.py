"""SentencePiece encoding with spans of the original bytes, and decoding.

A model's compiled character map is a double-array trie of source strings, each
with the string that takes its place. A text is normalised from left to right by
the longest source string that is a prefix of what is left, or else by one
character as it is; every byte written remembers where in the text it comes from.
White space becomes a visible sign, and the text is cut into parts that no piece
of the vocabulary can reach over. The library merges each part as it is, and a part seen
before is not merged again; characters without a piece are bytes. The ends of the pieces in the normalised text lead through the
alignment to the bytes of the text they stand for.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runaudit.llm.common import slices, table, utf8
from runaudit.llm.tokens import lists

SIGN = "▁"  # stands for a space
PARTS = 1 << 17  # parts a worker remembers for sure, and as many of the ones before
BATCH = 1 << 13  # parts that the library gets at once
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("one_sign_a_byte", lambda e: ("�" * (e.end - e.start), e.end))


class CharMap:
    """The compiled character map: longest source prefix and what replaces it."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.targets = blob[4 + size :]
        self.known: dict[str, tuple[bytes, int]] = {}

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, raw: bytes, at: int) -> tuple[int, int, int]:
        """(bytes of the longest source string at `at`, offset of its target, bytes
        looked at); no bytes without one."""
        units, node, found, target = self.units, 0, 0, 0
        node ^= self.step(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                return found, target, i + 1 - at
            node ^= self.step(unit)
            if unit >> 8 & 1:  # a source string ends here
                found, target = i + 1 - at, units[node] & 0x7FFFFFFF
        return found, target, len(raw) + 1 - at

    @staticmethod
    def step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def prefixes(self, text: str) -> Iterator[tuple[bytes, int]]:
        """What replaces each prefix, and the bytes of the text it takes. Where the
        walk ends within two characters, they alone decide, and are remembered."""
        raw, at, i = text.encode(), 0, 0
        while i < len(text):
            two = text[i : i + 2]
            got = self.known.get(two)
            if got is None:
                found, target, seen = self.longest(raw, at)
                if found:
                    got = self.targets[target : self.targets.index(b"\0", target)], found
                else:
                    got = text[i].encode(), len(text[i].encode())
                if seen <= len(two.encode()) and len(two) == 2:
                    self.known[two] = got
            yield got
            end = at + got[1]
            while at < end:
                at += len(text[i].encode())
                i += 1


class Model(dict):
    """A BPE model file: its vocabulary and its normaliser. As a mapping it
    holds the ids of the parts seen lately."""

    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(raw)
        kinds = [p.type for p in spec.pieces]
        if spec.trainer_spec.model_type != 2 or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces")
        if not spec.normalizer_spec.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that write a space as a sign before a word")
        self.chars = CharMap(spec.normalizer_spec.precompiled_charsmap)
        self.prefix, self.trim = spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.other = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.packed = {p: array("I", [i, len(p.encode())]).tobytes() for p, i in self.ids.items()}
        self.unknown, self.by_bytes = kinds.index(UNKNOWN), spec.trainer_spec.byte_fallback
        self.surface = [p.piece.replace(SIGN, " ").encode() if p.type == NORMAL else b"" for p in spec.pieces]
        self.surface[self.unknown] = (spec.trainer_spec.unk_surface or " ⁇ ").encode()
        for piece, i in self.other.items():
            self.surface[i] = bytes([int(piece[3:5], 16)])
        self.is_byte, self.is_control = (np.array([k == kind for k in kinds]) for kind in (BYTE, CONTROL))
        self.part = re.compile(self.parts_pattern(), re.DOTALL)
        spec.normalizer_spec.precompiled_charsmap = b""
        spec.normalizer_spec.add_dummy_prefix = spec.normalizer_spec.remove_extra_whitespaces = False
        self.merge = SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.before: dict[str, bytes] = {}

    def parts_pattern(self) -> str:
        """Parts: signs and the characters after them that occur in longer pieces;
        any other character alone. If some piece holds a sign after another
        character, a text is one part."""
        longer = [p for p in self.ids if len(p) > 1]
        if any(SIGN in p.lstrip(SIGN) for p in longer):
            return ".+"
        joined = "".join(sorted(set("".join(longer)) - {SIGN})) or SIGN
        letters = re.sub(r"([\\\]\[^-])", r"\\\1", joined)
        return f"{SIGN}*[{letters}]+|{SIGN}+|."

    def spelled(self, pieces: list[str]) -> bytes:
        """For each of a part's pieces its id and the bytes of the part that it takes, as
        unsigned 32-bit integers. Bytes of one character but the last take none."""
        known = list(map(self.packed.get, pieces))
        if None not in known:
            return b"".join(known)
        out, begun, size = array("I"), 0, 0
        for piece in pieces:
            if piece in self.ids or piece not in self.other:
                out.extend((self.ids.get(piece, self.unknown), len(piece.encode())))
                continue
            if not begun:
                size = begun = max(1, len(format(int(piece[3:5], 16), "08b").split("0")[0]))
            begun -= 1
            out.extend((self.other[piece], 0 if begun else size))
        return out.tobytes()

    def learn(self, parts: list[str]) -> None:
        """Have the library merge parts not seen before; it gets them normalised."""
        for a in range(0, len(parts), BATCH):
            some = parts[a : a + BATCH]
            if len(self) + len(some) > PARTS:
                self.before = dict(self)
                self.clear()
            for part, pieces in zip(some, self.merge.encode(some, out_type=str, num_threads=1), strict=True):
                self[part] = self.spelled(pieces)

    def __missing__(self, part: str) -> bytes:
        got = self.before.get(part)
        if got is None:
            got = self.spelled(self.merge.encode(part, out_type=str))
        self[part] = got
        return got

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text as the pieces see it, and for each of its bytes, and for its
        end, the byte of the original where what it stands for begins."""
        if not self.chars and not self.trim:
            body = text.replace(" ", SIGN)
            raw = np.frombuffer(text.encode(), np.uint8)
            align = np.append(np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1)), len(raw))
        else:
            body, align = self.mapped(text)
        if not body:
            return "", align
        return (SIGN + body, np.concatenate([np.repeat(align[:1], 3), align])) if self.prefix else (body, align)

    def mapped(self, text: str) -> tuple[str, np.ndarray]:
        parts: list[bytes] = []
        sizes, origins, at, spaced = [], [], 0, self.trim
        for new, taken in self.chars.prefixes(text) if self.chars else ((c.encode(), len(c.encode())) for c in text):
            if spaced:
                new = new.lstrip(b" ")
            if new:
                spaced = self.trim and new.endswith(b" ")
                parts.append(new.replace(b" ", SIGN.encode()))
                sizes.append(len(parts[-1]))
                origins.append(at)
            at += taken
        body = b"".join(parts)
        align = np.repeat(np.array(origins, np.int64), np.array(sizes, np.int64))
        while self.trim and body.endswith(SIGN.encode()):
            at = int(align[-3])
            body, align = body[:-3], align[:-3]
        return body.decode(), np.append(align, at)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and a row (begin, end) of original bytes for each id."""
        seen = [self.normalised(t) for t in texts]
        parts = [self.part.findall(norm) for norm, _ in seen]
        self.learn([p for p in {p for each in parts for p in each} if p not in self and p not in self.before])
        for each, (_, align) in zip(parts, seen, strict=True):
            got = np.frombuffer(b"".join(map(self.__getitem__, each)), "<u4").reshape(-1, 2)
            ids, taken = got[:, 0], got[:, 1].astype(np.int64)
            if not self.by_bytes and len(ids):  # neighbouring unknown characters are one piece
                last = (ids != self.unknown) | (np.append(ids[1:], self.unknown + 1) != self.unknown)
                ids, taken = ids[last], np.diff(np.cumsum(taken)[last], prepend=0)
            ends = np.cumsum(taken)
            yield ids, np.stack([align[ends - taken], align[ends]], axis=1)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: signs are spaces again, the one put before the text goes, and
        bytes that make no character are U+FFFD each."""
        lead = 0
        for i in ids.tolist():
            if i == self.unknown or self.is_byte[i] or self.surface[i][:1] not in (b"", b" "):
                break
            lead += self.surface[i][:1] == b" "
            if len(self.surface[i]) > 1 or lead and not self.trim:
                break
        cuts = np.flatnonzero(self.is_control[ids])  # bytes do not combine over one
        parts = np.split(ids, cuts) if len(cuts) else [ids]
        texts = [b"".join(map(self.surface.__getitem__, p.tolist())).decode("utf-8", "one_sign_a_byte") for p in parts]
        return "".join(texts)[lead if self.prefix or self.trim else 0 :]


@cache
def model(file: str) -> Model:
    """One per worker process, so that tasks share what it remembers."""
    with open(file, "rb") as f:
        return Model(f.read())


SPAN = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, file: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, n_tokens, n_bytes, ids, begins, ends) for every row of `docs`: the ids of
    each whole text without begin or end ids, and the bytes begins[i]..ends[i] of
    the UTF-8 text that piece i stands for. The pieces of a byte each share a
    character: it is the last one's. With `decoded`, the text of the ids comes along, as
    `decode` gives it.

    A null text is empty and has no ids. Every row stands for itself, repeated keys and
    null keys too. Other columns are not read. An empty table gives no rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(file)
        for batch in slices(batches, text):
            raw = utf8(batch, text)
            ids, begins, ends, back = [], [], [], []
            for got, span in pieces.encode([x.decode() for x in raw]):
                ids.append(got.tobytes())
                begins.append(span[:, 0].astype("<i4").tobytes())
                ends.append(span[:, 1].astype("<i4").tobytes())
                if decoded:
                    back.append(pieces.decode(got))
            n = np.array([len(x) // 4 for x in ids], np.int64)
            size = np.array([len(x) for x in raw], np.int64)
            yield table(**{key: batch.column(0)}, n_tokens=n, n_bytes=size, ids=lists(ids), begins=lists(begins), ends=lists(ends), **({"decoded": pa.array(back, pa.string())} if decoded else {}))

    schema = docs.select(key).schema.add("n_tokens", "long").add("n_bytes", "long")
    for c in ("ids", "begins", "ends"):
        schema = schema.add(c, SPAN)
    return docs.select(key, text).mapInArrow(encoded, schema.add("decoded", "string") if decoded else schema)


def decode(rows: DataFrame, file: str, keep: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`keep` columns of `rows` and the text of each list of ids; null is an empty list."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(file)
        for batch in batches:
            column = batch.column(len(keep))
            made = [pieces.decode(x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(0, np.int64)) for x in column]
            yield table(**{c: batch.column(i) for i, c in enumerate(keep)}, **{out: pa.array(made, pa.string())})

    return rows.select(*keep, ids).mapInArrow(decoded, rows.select(*keep).schema.add(out, "string"))
