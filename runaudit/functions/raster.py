"""Cells of bodies and regions, a batch of rows at a time.

A row has hundreds of grid points to test, which as Column lambdas are interpreted one by one.
Here they are Arrow functions over whole batches; they are pure per row, so Spark partitions
them as any expression. Angles go through the C library's cos and sin, one call each: those
of array libraries differ in the last bit, which decides where a centre lies on an edge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 20
HALF = SPAN // 2
AT_ONCE = 1 << 20  # grid points tested at once
_BITS = 40  # of a cell id


def _each(f, a: np.ndarray) -> np.ndarray:
    return np.fromiter(map(f, a.tolist()), float, len(a))


def _square(x: float) -> float:
    return math.pow(x, 2.0)


def _inside_link(rows, x, y, c, s, length, radius, size):
    """(row, cell) of every cell whose centre lies in the row's link."""
    x1, y1 = x + length * c, y + length * s
    lo_x, hi_x = (np.floor((f(x, x1) + p) / size).astype(np.int64) for f, p in ((np.minimum, -radius), (np.maximum, radius)))
    lo_y, hi_y = (np.floor((f(y, y1) + p) / size).astype(np.int64) for f, p in ((np.minimum, -radius), (np.maximum, radius)))
    wide, high = np.arange((hi_x - lo_x).max() + 1), np.arange((hi_y - lo_y).max() + 1)
    step = max(1, AT_ONCE // (len(wide) * len(high)))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        ix, iy = lo_x[part, None] + wide, lo_y[part, None] + high
        dx, dy = (ix + 0.5) * size - x[part, None], (iy + 0.5) * size - y[part, None]
        cos, sin = c[part, None], s[part, None]
        u = (dx * cos)[:, :, None] + (dy * sin)[:, None, :]
        v = (dy * cos)[:, None, :] - (dx * sin)[:, :, None]
        held = (u >= 0.0) & (u <= length) & (np.abs(v) <= radius)
        held &= (ix <= hi_x[part, None])[:, :, None] & (iy <= hi_y[part, None])[:, None, :]
        r, i, j = np.nonzero(held)
        yield rows[part][r], (ix[r, i] + HALF) * SPAN + (iy[r, j] + HALF)


def cells_of_poses(rows: np.ndarray, q: np.ndarray, lengths, radius: float, size: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, of n rows as list offsets and values; pose k (q[:, k]) is of rows[k]."""
    found = [np.empty(0, np.int64)]
    x, y, angle = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
    for qi, length in zip(q, lengths) if len(rows) else ():
        angle = angle + qi
        c, s = _each(math.cos, angle), _each(math.sin, angle)
        found += [(r << _BITS) | cell for r, cell in _inside_link(rows, x, y, c, s, length, radius, size)]
        x, y = x + length * c, y + length * s
    keys = np.unique(np.concatenate(found))
    counts = np.bincount(keys >> _BITS, minlength=n)
    return np.concatenate([[0], np.cumsum(counts)]), keys & ((1 << _BITS) - 1)


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array, known: np.ndarray) -> pa.Array:
    """A list array; rows not known are NULL (and hold nothing)."""
    held = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), held, mask=None if known.all() else pa.array(~known)
    )


def _floats(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)


def _bounds(a: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row offsets into the values of a list column; a NULL row is empty."""
    sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), a.flatten()


def integrated(q: list[Column], qd: list[Column], us: Column, dts: list[float], q_min, q_max, qd_max) -> Column:
    """Poses at the start and after each step under each of the accelerations `us`; NULL where the state is not known."""
    joints = len(q)

    def poses(*cols: pa.Array) -> pa.Array:
        state = np.stack([_floats(c) for c in cols[:-1]])
        known = np.isfinite(state).all(axis=0) & cols[-1].is_valid().to_numpy(zero_copy_only=False)
        on, flat = _bounds(cols[-1])
        rows = np.repeat(np.arange(state.shape[1]), np.diff(on))
        u = _floats(flat.flatten()).reshape(len(rows), joints).T
        rows, u = rows[known[rows]], u[:, known[rows]]
        p, v = state[:joints, rows], state[joints:, rows]
        low, high, most = (np.array(a)[:, None] for a in (q_min, q_max, qd_max))
        seen = [p]
        for dt in dts:
            p = np.clip(p + np.clip(v + 0.5 * u * dt, -most, most) * dt, low, high)
            v = np.clip(v + u * dt, -most, most)
            seen.append(p)
        held = np.stack(seen).transpose(2, 0, 1)  # by row and control, then time, then joint
        each = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, joints, dtype=np.int32)), pa.array(held.reshape(-1)))
        n = np.bincount(rows, minlength=state.shape[1]) * (len(dts) + 1)
        return _lists(np.concatenate([[0], np.cumsum(n)]), each, known)

    return F.arrow_udf(poses, "array<array<double>>", F.ArrowUDFType.SCALAR)(*[c.cast("double") for c in (*q, *qd)], us)


def body_cells(q: list[Column], lengths, radius: float, size: float) -> Column:
    def cells(*angles: pa.Array) -> pa.Array:
        a = np.stack([_floats(x) for x in angles])
        known = np.isfinite(a).all(axis=0)
        rows = np.flatnonzero(known)
        return _lists(*cells_of_poses(rows, a[:, rows], lengths, radius, size, a.shape[1]), known)

    return F.arrow_udf(cells, "array<bigint>", F.ArrowUDFType.SCALAR)(*[c.cast("double") for c in q])


def tip_reach(q: list[Column], lengths) -> Column:
    """Distance of the tip from the base, its squares by the C library as well; NULL where the pose is not known."""

    def reach(*angles: pa.Array) -> pa.Array:
        a = np.stack([_floats(x) for x in angles])
        known = np.isfinite(a).all(axis=0)
        a = np.where(known, a, 0.0)
        x, y, angle = np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1])
        for qi, length in zip(a, lengths):
            angle = angle + qi
            x, y = x + length * _each(math.cos, angle), y + length * _each(math.sin, angle)
        far = np.sqrt(_each(_square, x) + _each(_square, y))
        return pa.array(far, pa.float64(), mask=~known)

    return F.arrow_udf(reach, "double", F.ArrowUDFType.SCALAR)(*[c.cast("double") for c in q])


def region_cells(poses: Column, lengths, radius: float, size: float) -> Column:
    def cells(p: pa.Array) -> pa.Array:
        offsets, flat = _bounds(p)
        rows = np.repeat(np.arange(len(p)), np.diff(offsets))
        a = _floats(flat.flatten()).reshape(len(rows), len(lengths)).T
        if not np.isfinite(a).all():
            raise ValueError("a pose holds an angle that is not a finite number")
        return _lists(*cells_of_poses(rows, a, lengths, radius, size, len(p)), p.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(cells, "array<bigint>", F.ArrowUDFType.SCALAR)(poses)


def centres(cell: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    return (cell // SPAN - HALF + 0.5) * size, (cell % SPAN - HALF + 0.5) * size


def cells_in_discs(cells: Column, size: float, discs: Column) -> Column:
    """How many of a region's cells have their centre in each disc (cx, cy, r) of an array."""

    def count(c: pa.Array, d: pa.Array) -> pa.Array:
        at, values = _bounds(c)
        on, flat = _bounds(d)
        x, y = centres(values.to_numpy(zero_copy_only=False), size)
        cx, cy, r = (_floats(flat.field(f)) for f in ("cx", "cy", "r"))
        rows = np.repeat(np.arange(len(d)), np.diff(on))
        held = np.diff(at)[rows]
        inside = np.zeros(len(rows), np.int64)
        ends = np.cumsum(held)
        first = 0
        while first < len(rows):  # blocks of discs, some AT_ONCE cells each
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + AT_ONCE)))
            n = held[first:last]
            disc = np.repeat(np.arange(first, min(last, len(rows))), n)
            cell = np.arange(n.sum()) + np.repeat(at[rows[first:last]] - (np.cumsum(n) - n), n)
            dx, dy = x[cell] - cx[disc], y[cell] - cy[disc]
            inside[first:last] = np.bincount(disc[np.sqrt(dx * dx + dy * dy) <= r[disc]] - first, minlength=len(n))
            first = last
        return _lists(on, inside, c.is_valid().to_numpy(zero_copy_only=False) & d.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(count, "array<bigint>", F.ArrowUDFType.SCALAR)(cells, discs)


def furthest_corner(cells: Column, size: float) -> Column:
    """Distance of a region's furthest cell corner from the base; NULL for no cells."""

    def far(c: pa.Array) -> pa.Array:
        at, values = _bounds(c)
        x, y = (np.abs(v) + size / 2 for v in centres(values.to_numpy(zero_copy_only=False), size))
        some = np.diff(at) > 0
        out = np.zeros(len(c))
        if some.any():
            out[some] = np.maximum.reduceat(np.sqrt(x * x + y * y), at[:-1][some])
        return pa.array(out, pa.float64(), mask=~some)

    return F.arrow_udf(far, "double", F.ArrowUDFType.SCALAR)(cells)
