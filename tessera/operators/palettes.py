"""Palette generation: farthest-point seeds and constrained k-means over a histogram.

The histogram is a bounded relation (2**18 bins at six bits a channel, 2**15 at
five), whatever the size of the picture, so the inherently sequential rounds run
on the driver over those bins; pixels are only ever aggregated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import color as C

#: A bound on what reaches the driver: bins of a six-bit histogram.
MOST_BINS = 1 << 18


def histogram(px: DataFrame, half: str = "app") -> DataFrame:
    """key, l, a, b, weight: bin centres for the app half, means of members for the engine half."""
    if half == "app":
        bins = px.groupBy(*(F.shiftright(c, 2).alias(c) for c in "rgb")).agg(F.count("*").alias("weight"))
        l, a, b = C.oklab(*(F.col(c) / F.lit(63.0) for c in "rgb"))
        packed = [(F.col(c) / F.lit(63.0) * 255).cast("long") for c in "rgb"]
        return bins.select((packed[0] * 65536 + packed[1] * 256 + packed[2]).alias("key"), l.alias("l"), a.alias("a"), b.alias("b"), "weight")
    l, a, b = C.oklab(*(C.unit(c) for c in "rgb"), "engine")
    five = [F.round(F.col(c) * 31 / 255.0).cast("long") for c in "rgb"]
    px = px.select((five[0] * 1024 + five[1] * 32 + five[2]).alias("key"), l.alias("l"), a.alias("a"), b.alias("b"))
    return px.groupBy("key").agg(F.avg("l").alias("l"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.count("*").alias("weight"))


def bins(px: DataFrame, half: str = "app") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, points, weights) in key order."""
    rows = histogram(px, half).orderBy("key").limit(MOST_BINS).collect()
    return np.array([r.key for r in rows], np.int64), np.array([(r.l, r.a, r.b) for r in rows]).reshape(-1, 3), np.array([r.weight for r in rows], float)


def gaps(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((points - centre) ** 2).sum(axis=1)


def seeds(keys: np.ndarray, points: np.ndarray, weights: np.ndarray, count: int, apart: float = 0.0, fixed: np.ndarray | None = None) -> list[np.ndarray]:
    """Heaviest bin first, then whichever has the most weight times squared distance to what
    is chosen, at least `apart` away; ties (within 1e-9) to the lowest key."""
    near = np.full(len(keys), np.inf)
    for c in fixed if fixed is not None else ():
        near = np.minimum(near, gaps(points, c))
    out: list[np.ndarray] = []
    free = np.ones(len(keys), bool)
    while len(out) < count and free.any():
        if not out and not np.isfinite(near).any():
            pick = int(np.lexsort((keys, -weights))[0])
        else:
            ok = np.flatnonzero(free & (near >= apart * apart))
            if not len(ok):
                break
            value = near[ok] * weights[ok]
            tied = ok[value >= value.max() - max(1e-9, abs(value.max()) * 1e-9)]
            pick = int(tied[keys[tied].argmin()])
        free[pick] = False
        out.append(points[pick])
        near = np.minimum(near, gaps(points, points[pick]))
    return out


def nearest_centre(points: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    """First minimum, one centre at a time: no points-by-centres matrix."""
    best, owner = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    for k, c in enumerate(centres):
        d = gaps(points, c)
        owner[d < best], best = k, np.minimum(best, d)
    return owner


def kmeans(px: DataFrame, count: int, apart: float = 0.02, rounds: int = 50, still: float = 1e-5) -> list[tuple[float, float, float, int]]:
    """(l, a, b, pixels) of each automatic colour. A centre whose mean would come nearer than
    `apart` to another keeps its place for that round."""
    keys, points, weights = bins(px)
    centres = seeds(keys, points, weights, min(count, len(keys)), apart)
    for _ in range(rounds if centres else 0):
        owner = nearest_centre(points, centres)
        total = np.bincount(owner, weights, len(centres))
        sums = np.stack([np.bincount(owner, weights * points[:, d], len(centres)) for d in range(3)], 1)
        moved, fresh = 0.0, []
        for k, old in enumerate(centres):
            new = sums[k] / total[k] if total[k] > 0 else old
            if any(((new - other) ** 2).sum() < apart * apart for other in [*fresh, *centres[k + 1 :]]):
                new = old
            moved = max(moved, float(np.sqrt(((new - old) ** 2).sum())))
            fresh.append(new)
        centres = fresh
        if moved < still:
            break
    held = np.bincount(nearest_centre(points, centres), weights, len(centres)) if centres else []
    return [(*map(float, c), int(n)) for c, n in zip(centres, held, strict=True)]


def engine_palette(px: DataFrame, count: int, pinned: np.ndarray | None = None, rounds: int = 24, still: float = 1e-3) -> list[tuple[float, float, float, int]]:
    """(l, a, b, pixels): pinned anchors push the seeds away but take no part in the rounds;
    an empty cluster restarts at the bin farthest from all centres; ordered by rounded colour."""
    keys, points, weights = bins(px, "engine")
    centres = seeds(keys, points, weights, min(count, len(keys)), 0.0, pinned)
    for _ in range(rounds if centres else 0):
        owner = nearest_centre(points, centres)
        total = np.bincount(owner, weights, len(centres))
        moved, fresh = 0.0, []
        for k, old in enumerate(centres):
            if total[k] > 0:
                mine = owner == k
                new = (points[mine] * weights[mine, None]).sum(axis=0) / total[k]
            else:
                away = np.min([gaps(points, c) for c in centres], axis=0) * weights
                new = points[int(np.flatnonzero(away == away.max())[0])]
            moved = max(moved, float(np.sqrt(((new - old) ** 2).sum())))
            fresh.append(new)
        centres = fresh
        if moved <= still:
            break
    held = np.bincount(nearest_centre(points, centres), weights, len(centres)) if centres else []
    return sorted(((*map(float, c), int(n)) for c, n in zip(centres, held, strict=True)), key=lambda r: tuple(round(v * 1e9) for v in r[:3]))
