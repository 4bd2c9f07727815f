"""Planar arm geometry as Column expressions, unrolled over the joints.

Links are flat-ended rectangles of half-width link_radius, entities are
discs. Regions are sets of square cells, kept per row as arrays of cell ids:
a region lies inside the arm's workspace, so an array has at most
(2 * reach / cell + 2)^2 members and no shuffle is needed to build it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from runaudit.functions import raster

@dataclass(frozen=True)
class Limits:
    link_lengths: tuple[float, ...]
    link_radius: float
    q_min: tuple[float, ...]
    q_max: tuple[float, ...]
    qd_max: tuple[float, ...]
    qdd_max: tuple[float, ...]
    source: str = "proprioceptive"

    @property
    def bound(self) -> float:
        """M7: no point of the body is ever further out than this."""
        return sum(self.link_lengths) + self.link_radius


def forward_kinematics(q: list[Column], limits: Limits) -> list[tuple[Column, ...]]:
    """M3: (x0, y0, angle, length) of each link."""
    x, y, angle = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    out = []
    for qi, length in zip(q, limits.link_lengths):
        angle = angle + qi
        out.append((x, y, angle, length))
        x, y = x + length * F.cos(angle), y + length * F.sin(angle)
    return out


def tip_reach(q: list[Column], limits: Limits) -> Column:
    """Distance of the tip from the base, as a plain root of squares: ends of equal reach are told apart by its
    last bit, which `hypot` rounds otherwise."""
    x, y, angle, length = forward_kinematics(q, limits)[-1]
    tx, ty = x + length * F.cos(angle), y + length * F.sin(angle)
    return F.sqrt(tx * tx + ty * ty)


def tip_reach_of_rows(q: list[Column], limits: Limits) -> Column:
    """`tip_reach` to the last bit of the C library, for comparing reaches that are equal but for rounding.
    It cannot stand inside a lambda."""
    return raster.tip_reach(q, limits.link_lengths)


def _to_link(link, cx: Column, cy: Column) -> tuple[Column, Column]:
    x, y, angle, _ = link
    dx, dy = cx - x, cy - y
    return dx * F.cos(angle) + dy * F.sin(angle), dy * F.cos(angle) - dx * F.sin(angle)


def body_disc_distance(q: list[Column], limits: Limits, cx: Column, cy: Column, r: Column) -> Column:
    """M4: distance between the body and a disc; 0 is contact."""
    gaps = []
    for link in forward_kinematics(q, limits):
        u, v = _to_link(link, cx, cy)
        half = link[3] / 2
        out_u = F.greatest(F.abs(u - half) - half, F.lit(0.0))
        out_v = F.greatest(F.abs(v) - limits.link_radius, F.lit(0.0))
        gaps.append(F.hypot(out_u, out_v))
    near = gaps[0] if len(gaps) == 1 else F.least(*gaps)
    return F.greatest(near - r, F.lit(0.0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """M5."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def within_limits(q: list[Column], qd: list[Column], limits: Limits) -> Column:
    tests = [
        a.between(lo, hi) & (F.abs(b) <= m)
        for a, b, lo, hi, m in zip(q, qd, limits.q_min, limits.q_max, limits.qd_max)
    ]
    return reduce(lambda a, b: a & b, tests)


def reachable_joint_box(
    q: list[Column], qd: list[Column], limits: Limits, horizon: Column, substep: float
) -> list[tuple[Column, Column]]:
    """M6: each joint's interval over the horizon, in closed form."""
    box = []
    for j, (a, b) in enumerate(zip(q, qd)):
        vmax, acc = limits.qd_max[j], limits.qdd_max[j]
        speed = F.least(F.abs(b) + 0.5 * acc * substep, F.lit(vmax))
        t = F.least(F.greatest((F.lit(vmax) - speed) / acc, F.lit(0.0)), horizon) if acc > 0 else horizon
        delta = speed * t + 0.5 * acc * t * t + vmax * (horizon - t)
        box.append(
            (F.greatest(a - delta, F.lit(limits.q_min[j])), F.least(a + delta, F.lit(limits.q_max[j])))
        )
    return box


def _grow(lo: Column, width: Column, steps: Column, length: float):
    """Poses one joint further: every grid angle of that joint."""

    def grow(p):
        def at(i):
            a = p.a + lo + width * i / F.greatest(steps - 1, F.lit(1))
            return F.struct(
                a.alias("a"), (p.x + length * F.cos(a)).alias("x"), (p.y + length * F.sin(a)).alias("y")
            )

        return F.transform(F.sequence(F.lit(0), steps - 1), at)

    return grow


def _furthest(lo: Column, hi: Column, length: float):
    """Distance from the base to the furthest point of a swept sector."""

    def furthest(p):
        base = F.hypot(p.x, p.y)
        turn = F.atan2(p.y, p.x) - (p.a + lo)
        turn = turn - 2 * math.pi * F.floor(turn / (2 * math.pi))
        ends = [
            F.hypot(p.x + length * F.cos(p.a + e), p.y + length * F.sin(p.a + e)) for e in (lo, hi)
        ]
        return F.when(turn <= hi - lo, base + length).otherwise(F.greatest(base, *ends))

    return furthest


def outer_radius(
    q: list[Column], qd: list[Column], limits: Limits, horizon: Column, substep: float
) -> Column:
    """A radius the body cannot leave within the horizon.

    Each link sweeps a sector about every ancestor pose of a grid fine enough
    that half a grid step moves a link less than its radius; the sweep's
    furthest point, plus that slack and the radius, bounds the link. NULL for
    a state outside its limits.
    """
    box = reachable_joint_box(q, qd, limits, horizon, substep)
    n, radius = len(q), limits.link_radius
    reach = [sum(limits.link_lengths[j:]) for j in range(n)]
    best = []
    for k in range(n):
        poses = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
        slack = F.lit(0.0)
        for j in range(k):
            lo, hi = box[j]
            width = hi - lo
            steps = F.when(width == 0, F.lit(1)).otherwise(
                (F.ceil(width * reach[j] / radius) + 1).cast("int")
            )
            slack = slack + F.when(
                steps > 1, 0.5 * width / F.greatest(steps - 1, F.lit(1)) * reach[j]
            ).otherwise(0.0)
            length = limits.link_lengths[j]

            poses = F.flatten(F.transform(poses, _grow(lo, width, steps, length)))
        lo, hi = box[k]
        far = F.transform(poses, _furthest(lo, hi, limits.link_lengths[k]))
        best.append(F.array_max(far) + slack + radius)
    worst = best[0] if n == 1 else F.greatest(*best)
    return F.when(within_limits(q, qd, limits), F.least(worst, F.lit(limits.bound)))


def controls(limits: Limits, interior: int = 0, seed: int = 0) -> Column:
    """Array of joint accelerations: full ones in every pattern of signs, and `interior` others
    inside the box, drawn by hash from their number. The order has no meaning."""
    most = limits.qdd_max
    grid = 2.0**52

    def inside(i: int) -> Column:
        unit = lambda j: F.pmod(F.xxhash64(F.lit(i).cast("long"), F.lit(j), F.lit(seed)), F.lit(1 << 52)) / F.lit(grid)
        return F.array(*[(unit(j) * 2 - 1) * a for j, a in enumerate(most)])

    corners = [F.array(*[F.lit(s * a) for s, a in zip(signs, most)]) for signs in product((-1.0, 1.0), repeat=len(most))]
    return F.array(*corners, *map(inside, range(1, interior + 1)))


def substep_times(horizon: float, substep: float) -> list[float]:
    """Multiples of the substep below the horizon, and the horizon itself."""
    whole = math.ceil(horizon / substep * (1 - 1e-12))
    return [i * substep for i in range(whole)] + [horizon]


def reachable_poses(
    q: list[Column], qd: list[Column], limits: Limits, horizon: float, substep: float, us: Column,
) -> Column:
    """Array of poses (joint angles) that the controls `us` reach."""
    times = substep_times(horizon, substep)
    dts = [b - a for a, b in zip(times, times[1:])]
    return F.array_distinct(raster.integrated(q, qd, us, dts, limits.q_min, limits.q_max, limits.qd_max))


def body_cells(q: list[Column], limits: Limits, size: float) -> Column:
    """Cells whose centre lies in a link, each link rasterised in its own box."""
    return raster.body_cells(q, limits.link_lengths, limits.link_radius, size)


def region_cells(poses: Column, limits: Limits, size: float) -> Column:
    return raster.region_cells(poses, limits.link_lengths, limits.link_radius, size)


def disc_overlaps(cells: Column, size: float, discs: Column) -> Column:
    """R2: of each disc (cx, cy, r), how many of the region's cells have their centre in it."""
    return raster.cells_in_discs(cells, size, discs)


def region_area(cells: Column, size: float) -> Column:
    return F.size(cells) * F.lit(size * size)


def region_reach(cells: Column, size: float) -> Column:
    """Distance of a region's furthest cell corner from the base."""
    return raster.furthest_corner(cells, size)


def region_digest(cells: Column) -> Column:
    """Equal regions, equal digest."""
    return F.sha2(F.array_join(F.sort_array(cells).cast("array<string>"), ","), 256)
