"""Quantization, instants, identifiers and fixed-point text.

Everything here is a Column expression, so it stays inside code generation.
Values the audit rules refuse (negative distance, non-finite number) become
NULL, which every question reports as could-not-evaluate.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runaudit import vocab as V


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def distance_bucket(d: Column, quantum: float = V.DISTANCE_TOL_M) -> Column:
    """Half-even bucket number; F.round would round ties up."""
    return F.when(finite(d) & (d >= 0), F.rint(d / F.lit(quantum)).cast("long"))


def quantize_distance(d: Column, quantum: float = V.DISTANCE_TOL_M) -> Column:
    return distance_bucket(d, quantum) * F.lit(quantum)


def time_bucket(t: Column, quantum: float = V.TIME_TOL_S) -> Column:
    return F.when(finite(t), F.rint(t / F.lit(quantum)).cast("long"))


def quantize_time(t: Column, quantum: float = V.TIME_TOL_S) -> Column:
    return time_bucket(t, quantum) * F.lit(quantum)


def quantize_area(a: Column, sigfigs: int = V.AREA_SIGFIGS) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(sigfigs - 1) - F.floor(F.log10(a)))
    return (
        F.when(~finite(a) | (a < 0), F.lit(None).cast("double"))
        .when(a == 0, F.lit(0.0))
        .otherwise(F.rint(a * scale) / scale)
    )


def frames_in(t_start: Column, t_end: Column, period: Column) -> Column:
    """Frames a span covers, from its length; never a row count."""
    return (F.rint((t_end - t_start) / period) + 1).cast("long")


def fixed_text(v: Column, decimals: int = V.FLOAT_DECIMALS) -> Column:
    """Fixed-point text, exact ties to even, no negative zero.

    `format_string` rounds the shortest decimal text, not the stored binary
    value, so its ties differ. Here the product v*10^d is split into a rounded
    part and its exact error (Veltkamp/Dekker splitting), and the error decides
    a tie. From |v| * 10^d >= 2^52 on the fraction has so few bits that it is scaled
    exactly by itself (for 9 decimals at most), and from 2^63 on there is none: the whole
    number is expanded in limbs. NULL for NaN and infinities alone.
    """
    if not 0 <= decimals <= 9:
        raise ValueError(f"decimals must be 0 to 9, got {decimals}")
    m = F.lit(float(10**decimals))
    split = F.lit(134217729.0)
    p = v * m

    def halves(x):
        c = split * x
        hi = c - (c - x)
        return hi, x - hi

    vh, vl = halves(v)
    mh, ml = halves(m)
    err = ((vh * mh - p) + vh * ml + vl * mh) + vl * ml
    base = F.floor(p).cast("long")
    up = F.when(err > 0, F.lit(1)).when(err < 0, F.lit(0)).otherwise(F.abs(base % 2))
    n = F.when((p - F.floor(p)) == 0.5, base + up).otherwise(F.rint(p).cast("long"))
    scaled = n.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-decimals))
    # outside ANSI mode a decimal zero prints with an exponent
    text = F.replace(scaled.cast("string"), F.lit(f"0E-{decimals}"), F.lit(f"{0:.{decimals}f}"))
    size = F.abs(v)
    whole = F.floor(size)
    part = F.rint((size - whole) * m)
    carried = part >= m
    large = F.concat(
        F.when(v < 0, F.lit("-")).otherwise(F.lit("")),
        F.when(carried, whole + 1).otherwise(whole).cast("decimal(20,0)").cast("string"),
        F.lit("."),
        F.lpad(F.when(carried, F.lit(0)).otherwise(part.cast("long")).cast("string"), decimals, "0"),
    )
    huge = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), whole_text(size), F.lit(f"{0:.{decimals}f}"[1:]))
    return (
        F.when(finite(v) & (F.abs(p) < float(2**52)), text)
        .when(finite(v) & (size < float(2**63)), large)
        .when(finite(v), huge)
    )


LIMB = 10**9
SHIFT = 29  # a limb times 2^29 and a carry stay far below 2^63


def whole_text(size: Column) -> Column:
    """Decimal digits of a double of 2^63 or more, which is m * 2^e for whole m: the limbs of
    m are doubled e times, 29 at once, with their carries."""
    e = F.greatest(F.floor(F.log2(size)).cast("int") - 53, F.lit(0))
    m = (size / F.pow(F.lit(2.0), e)).cast("long")
    limb, zero = F.lit(LIMB).cast("long"), F.lit(0).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    limbs = F.array(m % limb, div(m, limb) % limb, div(div(m, limb), limb))
    factors = F.concat(
        F.array_repeat(F.lit(1 << SHIFT).cast("long"), F.floor(e / SHIFT).cast("int")),
        F.array(F.pow(F.lit(2.0), e % SHIFT).cast("long")),
    )

    def times(held: Column, factor: Column) -> Column:
        def carry(s: Column, x: Column) -> Column:
            t = x * factor + s["over"]
            return F.struct(div(t, limb).alias("over"), F.array_append(s["out"], t % limb).alias("out"))

        start = F.struct(zero.alias("over"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(held, start, carry, lambda s: F.array_append(s["out"], s["over"]))

    found = F.reverse(F.aggregate(factors, limbs, times))
    digits = F.array_join(F.transform(found, lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(digits, "^0+", "")


def digest(*parts: Column, length: int = 16) -> Column:
    """Leading hex of SHA-256 over NUL-joined parts; NULL counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    joined = reduce(lambda a, b: F.concat(a, F.lit("\0"), b), texts)
    return F.substring(F.sha2(joined, 256), 1, length)


def software_stamp(name: str, horizon: Column, samples: Column, seed: Column, substep: Column) -> Column:
    """A version that names the settings its regions were computed with."""
    tag = digest(fixed_text(horizon, 9), samples, seed, fixed_text(substep, 9), length=8)
    return F.concat(F.lit(f"{name}+env-"), tag)


INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def parse_instant(text: Column) -> Column:
    """RFC 3339 text to TIMESTAMP; an instant without an offset is NULL."""
    return F.when(text.rlike(INSTANT_PATTERN), F.try_to_timestamp(text))


def instant_at(run_start: Column, t: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(run_start) + F.rint(t * 1e6).cast("long"))


def _utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def format_instant(ts: Column) -> Column:
    return F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def instant_date(ts: Column) -> Column:
    return F.date_format(_utc(ts), "yyyy/MM/dd")


def valid_identifier(x: Column) -> Column:
    return x.isNotNull() & (F.trim(x) != "") & ~x.rlike(r"[\n\r\t\x00]")


def valid_record_id(x: Column) -> Column:
    return x.isNotNull() & (x != "") & ~x.rlike(r"\s")


def is_hash(x: Column) -> Column:
    return F.coalesce(x.rlike(V.HASH_PATTERN), F.lit(False))


def to_hash(binary: Column) -> Column:
    return F.when(F.octet_length(binary) == 32, F.lower(F.hex(binary)))


def from_hash(text: Column) -> Column:
    return F.when(is_hash(text), F.unhex(text))


def edge_layer(edge_type: Column, limits_source: Column | None = None) -> Column:
    table = F.create_map(
        *[F.lit(x) for k, v in V.EDGE_TYPES.items() if v[0] for x in (k, v[0])]
    )
    own = F.lit(V.LAYER_A)
    if limits_source is not None:
        own = F.when(limits_source == "proprioceptive", own).otherwise(F.lit(V.LAYER_B))
    return F.when(edge_type == "HAS_ENVELOPE", own).otherwise(F.try_element_at(table, edge_type))


def occurrence_layer(kind: Column) -> Column:
    table = F.create_map(
        *[F.lit(x) for k, v in V.OCCURRENCE_TYPES.items() for x in (k, v[0])]
    )
    return F.try_element_at(table, kind)


def agreement(answer: Column, truth: Column, tolerance: float) -> Column:
    return (
        F.when(answer.isNull() | truth.isNull(), F.lit(V.CNE))
        .when(F.abs(answer - truth) <= tolerance, F.lit(V.AGREE))
        .otherwise(F.lit(V.DISAGREE))
    )


# severity roll-ups: the worst member decides, and nothing checked decides nothing
def worst_state(state: Column, bad: str, good: str) -> Column:
    sev = F.max(F.when(state == bad, 2).when(state == V.CNE, 1).otherwise(0))
    return F.when(sev == 2, F.lit(bad)).when(sev == 0, F.lit(good)).otherwise(F.lit(V.CNE))


# measurement arithmetic; impossible inputs are NULL
def compression_ratio(baseline: Column, artifact: Column) -> Column:
    return F.when((baseline > 0) & (artifact > 0), baseline / artifact)


def sensor_projection_bytes(raw: Column, multiplier: Column) -> Column:
    return F.when((raw > 0) & (multiplier >= 1), F.rint(raw * multiplier).cast("long"))


def bytes_per_hour(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size * 3600.0 / seconds)


def frames_at_rate(seconds: Column, rate_hz: Column) -> Column:
    return (F.rint(seconds * rate_hz) + 1).cast("long")
