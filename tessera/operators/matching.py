"""Palettes against pixels: reach claims, nearest centres, best matches."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import color as C

#: A later entry takes a pixel over only if it scores better by more than this.
CLAIM_EPSILON = 1e-6
# Reach, hue (degrees), chroma, lightness.
REACH = ((0, 0.5, 0.002, 0.002), (25, 10.0, 0.035, 0.060), (50, 25.0, 0.080, 0.160), (75, 60.0, 0.160, 0.350), (100, 180.0, 0.400, 1.000))


def reach_tolerance(reach: Column, k: int) -> Column:
    """Tolerance k (1 hue, 2 chroma, 3 lightness) for a reach, linear between anchors, clamped."""
    r = F.least(F.greatest(reach.cast("int"), F.lit(0)), F.lit(100))
    out = F.when(F.lit(False), F.lit(0.0))
    for low, high in zip(REACH, REACH[1:], strict=False):
        t = (r - low[0]) / F.lit(float(high[0] - low[0]))
        out = out.when(r <= high[0], F.lit(low[k]) + t * F.lit(high[k] - low[k]))
    return out


def tolerances(reach: int) -> tuple[float, float, float]:
    r = min(100, max(0, int(reach)))
    low, high = next((a, b) for a, b in zip(REACH, REACH[1:], strict=False) if r <= b[0])
    t = (r - low[0]) / (high[0] - low[0])
    return tuple(low[k] + t * (high[k] - low[k]) for k in (1, 2, 3))


def _oklab(hex_: str, half: str) -> tuple[float, float, float]:
    v = [int(hex_[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    lin = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in v]
    lms = [math.cbrt(sum(w * x for w, x in zip(row, lin, strict=True))) for row in C.TO_LMS]
    rows = (*C.TO_LAB[:2], (*C.TO_LAB[2][:2], -C.B_LAST[half]))
    return tuple(sum(w * x for w, x in zip(row, lms, strict=True)) for row in rows)


@dataclass(frozen=True)
class Entry:
    """A palette entry: pinned ones reserve what lies within their reach, automatic ones take the rest."""

    id: str
    hex: str
    pinned: bool = True
    reach: int = 25
    priority: int = 0
    tol: tuple[float, float, float] | None = None  # hue, chroma, lightness; linked to reach if None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def lab(self, half: str = "app") -> tuple[float, float, float]:
        return _oklab(self.hex, half)

    def lch(self) -> tuple[float, float, float]:
        l, a, b = self.lab()
        return l, math.hypot(a, b), math.degrees(math.atan2(b, a)) % 360

    def tolerances(self) -> tuple[float, float, float]:
        return self.tol or tolerances(self.reach)


def claim_score(l: Column, c: Column, h: Column, entry: Entry) -> Column:
    """Score of a pixel within the entry's reach; null outside it."""
    al, ac, ah = entry.lch()
    hue_tol, chroma_tol, light_tol = (max(1e-6, t) for t in entry.tolerances())
    hw, cw, lw = entry.weights
    dl, dc = F.abs(l - al), F.abs(c - ac)
    total = (dl / light_tol) * (dl / light_tol) * lw + (dc / chroma_tol) * (dc / chroma_tol) * cw
    weight, inside = F.lit(lw + cw), (dl <= light_tol) & (dc <= chroma_tol)
    if ac >= 0.02:  # the hue of a neutral anchor says nothing
        effective = C.hue_confidence(c) * hw
        used, dh = effective > 1e-4, C.hue_distance(h, F.lit(ah))
        inside = inside & (~used | (dh <= hue_tol))
        total = total + F.when(used, effective * (dh / hue_tol) * (dh / hue_tol)).otherwise(0.0)
        weight = weight + F.when(used, effective).otherwise(0.0)
    return F.when(inside, F.when(weight <= 1e-6, 0.0).otherwise(total / weight))


def claim_winner(scores: list[Column]) -> Column:
    """Position of the entry that claims, -1 if none: a fold in palette order, for the margin makes the choice order-dependent."""
    start = F.struct(F.lit(-1).alias("i"), F.lit(float("inf")).alias("s"))
    items = F.array(*[F.struct(F.lit(k).alias("i"), F.coalesce(s, F.lit(float("inf"))).alias("s")) for k, s in enumerate(scores)])
    return F.aggregate(items, start, lambda acc, e: F.when(e["s"] < acc["s"] - CLAIM_EPSILON, e).otherwise(acc))["i"]


def nearest(lab: tuple[Column, Column, Column], centres: list[tuple[float, float, float]]) -> Column:
    """Index of the nearest centre, the lowest on ties: row by row, with no join."""
    scored = [F.struct(C.distance_sq(lab, tuple(F.lit(v) for v in centre)).alias("d"), F.lit(k).alias("i")) for k, centre in enumerate(centres)]
    return F.least(*scored)["i"] if len(scored) > 1 else F.lit(0)


def with_lch(px: DataFrame) -> DataFrame:
    """OKLab and OKLCH columns, computed once for each distinct colour of a row's expression tree."""
    l, a, b = C.oklab(C.unit("r"), C.unit("g"), C.unit("b"))
    out = px.withColumns({"l": l, "ok_a": a, "ok_b": b})
    return out.withColumns({"c": C.chroma(F.col("ok_a"), F.col("ok_b")), "h": C.hue_degrees(F.col("ok_a"), F.col("ok_b"))})


def let(value: Column, body) -> Column:
    """body of a value that is worked out once: a filter on the result, pushed below it,
    would otherwise repeat the value's expression wherever the body mentions it."""
    return F.transform(F.array(value), body)[0]


def by_distinct_colour(px: DataFrame, columns: list[str], work) -> DataFrame:
    """work on the distinct colours only, then join back: a picture has far fewer colours than pixels."""
    colours = work(px.select(*columns).distinct())
    return px.join(colours, columns)


def claims(px: DataFrame, palette: list[Entry]) -> DataFrame:
    """winner: position among the pinned entries, or -1."""
    pinned = [e for e in palette if e.pinned]

    def match(colours: DataFrame) -> DataFrame:
        lch = with_lch(colours)
        return lch.withColumn("winner", let(F.struct("l", "c", "h"), lambda v: claim_winner([claim_score(v["l"], v["c"], v["h"], e) for e in pinned])) if pinned else F.lit(-1))

    return by_distinct_colour(px, ["r", "g", "b"], match)


def ownership(px: DataFrame, palette: list[Entry], ignore_below: float = 0.05, unclaimed: str = "nearest") -> DataFrame:
    """owner: id of the entry that owns a pixel, null for none. Claims come first; opaque
    unclaimed pixels go to the nearest automatic entry, or pinned one if there is no automatic one."""
    pinned = [e for e in palette if e.pinned]
    targets = [e for e in palette if not e.pinned] or ([] if unclaimed == "drop" else pinned)
    claimed = claims(px, palette)
    near = nearest((F.col("l"), F.col("ok_a"), F.col("ok_b")), [e.lab() for e in targets]) if targets else F.lit(None).cast("int")
    name = lambda entries, col: F.element_at(F.array(*[F.lit(e.id) for e in entries]), col + 1) if entries else F.lit(None).cast("string")
    opaque = F.col("a") / 255.0 >= ignore_below
    return claimed.withColumn("owner", F.when(F.col("winner") >= 0, name(pinned, F.greatest(F.col("winner"), F.lit(0)))).when(opaque, name(targets, near)))


# ------------------------------------------------------------- engine ----
def hue_weight(sample: Column, anchor: Column, threshold: float) -> Column:
    if threshold <= 0:
        return F.lit(1.0)
    t = F.least(F.greatest(F.least(sample, anchor) / threshold, F.lit(0.0)), F.lit(1.0))
    return t * t * (F.lit(3.0) - t * 2)


def reach_score(l: Column, c: Column, h: Column, entry: Entry, threshold: float = 0.02) -> Column:
    """Anisotropic distance in units of reach; hue in radians."""
    al, a, b = entry.lab("engine")
    ac, ah = math.hypot(a, b), math.atan2(b, a)
    hue_tol, chroma_tol, light_tol = entry.tolerances()
    chord = F.sqrt(F.greatest(c * ac, F.lit(0.0))) * 2 * F.sin(C.hue_difference(h, F.lit(ah)) / 2)
    tl, tc, th = (l - al) / light_tol, (c - ac) / chroma_tol, chord / hue_tol
    return tl * tl + tc * tc + hue_weight(c, F.lit(ac), threshold) * th * th


def best_match(scores: list[Column], palette: list[Entry]) -> Column:
    """struct(key, order, label): lowest cost key, then highest priority, then lowest id."""
    return F.least(*[F.struct(C.quant_key(s).alias("key"), F.lit(-e.priority).alias("order"), F.lit(k).alias("label")) for k, (s, e) in enumerate(zip(scores, palette, strict=True))])
