"""Canonical record text, chain hashes and keyed digests as Column expressions.

A record is its class name and its fields in schema order. Each field is
name, type tag, payload length in bytes and payload. Floats are fixed to six
decimals and bytes are lower-case hex. The signing text leaves the MAC out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.functions import scalars as S

# Fixed values of the record format: separators and domain suffixes.
FIELD_SEP = "\x1f"
RECORD_SEP = "\x1e"
SIGNING = "-chain-signing-v1\0"
RECORD = "-chain-record-v1\0"
LINK = "-chain-link-v1\0"
COMMITMENT = "-commitment-v1\0"

# Field order of each record kind; prev_hash and mac close every record.
SCHEMAS = {
    "Declaration": (
        ("declaration_id", "s"), ("seq", "i"), ("t_issued", "f"), ("horizon", "f"),
        ("action_class", "s"), ("declared_envelope", "x"),
    ),
    "Verdict": (
        ("verdict_id", "s"), ("declaration_id", "s"), ("seq", "i"), ("t", "f"),
        ("outcome", "s"), ("fault", "s"), ("clamped_envelope", "x"),
    ),
    "Acknowledgment": (
        ("ack_id", "s"), ("t", "f"), ("fault", "s"), ("verdict_id", "s"), ("reason", "s"),
    ),
}


@dataclass(frozen=True)
class Format:
    """The domain prefix a record writer hashed under. Set it to the writer's
    own prefix to check records another program sealed."""

    prefix: str = "runaudit"

    def domain(self, suffix: str) -> bytes:
        return (self.prefix + suffix).encode()


def field(name: str, tag: str, value: Column) -> Column:
    text = {
        "s": lambda: value,
        "i": lambda: value.cast("string"),
        "f": lambda: S.fixed_text(value),
        "x": lambda: F.lower(F.hex(value)),
        "b": lambda: value.cast("string"),
    }[tag]()
    # a value without text (NaN, an infinity) leaves the whole record unreadable
    payload = F.when(value.isNull(), F.lit("")).otherwise(text)
    return F.concat(
        F.lit(name + FIELD_SEP),
        F.when(value.isNull(), F.lit("n")).otherwise(F.lit(tag)),
        F.lit(FIELD_SEP),
        F.octet_length(payload).cast("string"),
        F.lit(FIELD_SEP),
        payload,
        F.lit(RECORD_SEP),
    )


def head(kind: str) -> Column:
    """Everything before prev_hash."""
    return F.concat(
        F.lit(kind + RECORD_SEP), *[field(n, t, F.col(n)) for n, t in SCHEMAS[kind]]
    )


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def binary(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def signing_bytes(fmt: Format, head_text: Column, prev_hash: Column) -> Column:
    body = F.concat(head_text, field("prev_hash", "s", prev_hash))
    return F.concat(binary(fmt.domain(SIGNING)), utf8(body))


def canonical_text(head_text: Column, prev_hash: Column, mac: Column) -> Column:
    return F.concat(head_text, field("prev_hash", "s", prev_hash), field("mac", "s", mac))


def chain_hash(fmt: Format, head_text: Column, prev_hash: Column, mac: Column) -> Column:
    """Hash of a record under its own stored prev_hash; NULL if that is malformed."""
    return F.sha2(
        F.concat(
            binary(fmt.domain(LINK)),
            S.from_hash(prev_hash),
            binary(fmt.domain(RECORD)),
            utf8(canonical_text(head_text, prev_hash, mac)),
        ),
        256,
    )


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    inner, outer = _pads(key)
    return F.sha2(
        F.concat(binary(outer), F.unhex(F.sha2(F.concat(binary(inner), message), 256))), 256
    )


def mac_state(
    fmt: Format, key: bytes | None, head_text: Column, prev_hash: Column, mac: Column
) -> Column:
    """valid / invalid / could-not-evaluate: no key, unsigned and malformed
    are never 'invalid'."""
    if key is None:
        return F.lit(V.MAC_CNE)
    want = hmac_sha256(key, signing_bytes(fmt, head_text, prev_hash))
    return (
        F.when(~S.is_hash(mac) | want.isNull(), F.lit(V.MAC_CNE))
        .when(want == mac, F.lit(V.MAC_VALID))
        .otherwise(F.lit(V.MAC_INVALID))
    )


def commitment_bytes(
    fmt: Format, scheme: Column, witness: Column, declaration_head: Column, verdict_head: Column
) -> Column:
    def part(name, value):
        return F.concat(
            F.lit(name + FIELD_SEP), F.octet_length(value).cast("string"), F.lit(FIELD_SEP), value,
            F.lit(RECORD_SEP),
        )

    return F.concat(
        binary(fmt.domain(COMMITMENT)),
        utf8(
            F.concat(
                part("scheme", scheme), part("witness_id", witness),
                part("declaration_head", declaration_head), part("verdict_head", verdict_head),
            )
        ),
    )
