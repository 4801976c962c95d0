"""Regions: edge costs, adjacency, summaries, merge costs, planar counts; and the
inherently ordered steps (spanning forest, best-first merging) once per image.

Every relation carries image_id; pixel ids are unique over all images, region ids within one.
The ordered steps hold one image in a task, which the pixel limit of the sources bounds.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.operators.lineage import written
from tessera.operators.masks import frames

TOP = 65535
# Weights of colour, gradient, alpha and claim, and the scales of the merge cost.
WEIGHTS = (1.0, 0.5, 1.0, 0.25)
CLAIM_PENALTY, EDGE_SCALE, PROTECTION_SCALE = 0.02, 0.04, 0.25
SCALE_K = 12_000.0
#: direction: (dx, dy), and where the coarse response looks; the last looks at the pixel itself.
DIRECTIONS = (("right", 1, 0, 2, 0), ("down", 0, 1, 0, 2), ("down_right", 1, 1, 2, 2), ("down_left", -1, 1, 0, 0))


def evidence(px: DataFrame) -> DataFrame:
    """pixel_id, x, y, alpha, claim and OKLab of the engine half; no colour where alpha is zero."""
    l, a, b = C.oklab(C.unit("r"), C.unit("g"), C.unit("b"), "engine")
    seen = lambda v: F.when(F.col("a") > 0, v).otherwise(0.0)
    return px.select("image_id", "pixel_id", "x", "y", (F.col("a") / 255.0).alias("alpha"), F.col("zone").alias("claim"), seen(l).alias("l"), seen(a).alias("ok_a"), seen(b).alias("ok_b"))


def round_away(v: Column) -> Column:
    return F.floor(v + 0.5)


#: The line of pixels that a direction runs along, and by what it is ordered.
LINES = {(1, 0): ("y", "x"), (0, 1): ("x", "y"), (1, 1): ("x - y", "y"), (-1, 1): ("x + y", "y")}


def coarse_gradient(ev: DataFrame, dx: int, dy: int) -> DataFrame:
    """For every pixel with a neighbour at (dx, dy): ev's columns, q (the neighbour), fine (the robust difference of colour) and
    coarse (the same two pixels apart, where there is such a pixel). One window along the line of pixels, so no join."""
    line, order = LINES[dx, dy]
    along = Window.partitionBy("image_id", F.expr(line)).orderBy(order)
    cell = F.struct("pixel_id", "x", "y", "alpha", "claim", "l", "ok_a", "ok_b")
    there = lambda n, k: (F.col(f"{n}.x") == F.col("x") + k * dx) & (F.col(f"{n}.y") == F.col("y") + k * dy)
    gap = lambda n: C.robust(F.sqrt(C.distance_sq(tuple(F.col(c) for c in ("l", "ok_a", "ok_b")), tuple(F.col(f"{n}.{c}") for c in ("l", "ok_a", "ok_b")))) / 1.5)
    near = ev.withColumns({"q": F.lead(cell, 1).over(along), "f": F.lead(cell, 2).over(along)}).where(there("q", 1))
    return near.withColumns({"fine": gap("q"), "coarse": F.when(there("f", 2), gap("f"))}).drop("f")


def edges(ev: DataFrame) -> DataFrame:
    """image_id, a, b, dir, weight (0..65535): each pixel with its right, lower and two diagonal neighbours."""
    out = None
    for k, (_, dx, dy, cx, cy) in enumerate(DIRECTIONS):
        pair = coarse_gradient(ev, dx, dy)
        # the direction that looks at the pixel itself finds no difference there
        gradient = F.least("fine", F.coalesce("coarse", "fine")) if cx or cy else F.lit(0.0)
        total = F.col("fine") * WEIGHTS[0] + gradient * WEIGHTS[1] + F.abs(F.col("alpha") - F.col("q.alpha")) * WEIGHTS[2] + F.when(F.col("claim") == F.col("q.claim"), 0.0).otherwise(1.0) * WEIGHTS[3]
        weight = round_away(F.least(F.greatest(total / sum(WEIGHTS), F.lit(0.0)), F.lit(1.0)) * TOP)
        if dx and dy:
            weight = F.least(F.lit(TOP), round_away(weight * math.sqrt(2)))
        part = pair.select("image_id", F.col("pixel_id").alias("a"), F.col("q.pixel_id").alias("b"), F.lit(k).alias("dir"), weight.cast("long").alias("weight"))
        out = part if out is None else out.union(part)
    return out


def adjacency(labels: DataFrame, cost: DataFrame) -> DataFrame:
    """image_id, low, high, boundary_length, weight_sum over right and lower interfaces of labels (pixel_id, region)."""
    side = cost.where("dir < 2").join(labels.select(F.col("pixel_id").alias("a"), F.col("region").alias("ra")), "a").join(labels.select(F.col("pixel_id").alias("b"), F.col("region").alias("rb")), "b").where("ra <> rb")
    return side.groupBy("image_id", F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high")).agg(F.count("*").alias("boundary_length"), F.sum("weight").alias("weight_sum"))


def summaries(ev: DataFrame, labels: DataFrame, sides: DataFrame) -> DataFrame:
    """One row per region: area, box, sums of colour, mean alpha, commonest claim (lowest on ties), perimeter."""
    px = ev.join(labels, "pixel_id").join(frames(ev), "image_id")
    square = C.distance_sq((F.col("l"), F.col("ok_a"), F.col("ok_b")), (F.lit(0.0),) * 3)
    rim = sum(((c).cast("int") for c in (F.col("y") == 0, F.col("x") == F.col("width") - 1, F.col("y") == F.col("height") - 1)), (F.col("x") == 0).cast("int"))
    base = px.groupBy("image_id", "region").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("l").alias("sl"), F.sum("ok_a").alias("sa"), F.sum("ok_b").alias("sb"), F.sum(square).alias("sq"), F.avg("alpha").alias("alpha"), F.sum(rim).alias("rim"))
    claim = px.groupBy("image_id", "region", "claim").agg(F.count("*").alias("n")).groupBy("image_id", "region").agg(F.max_by("claim", F.struct("n", -F.col("claim"))).alias("claim"))
    walls = sides.select("image_id", F.explode(F.array("low", "high")).alias("region"), "boundary_length").groupBy("image_id", "region").agg(F.sum("boundary_length").alias("walls"))
    return base.join(claim, ["image_id", "region"]).join(walls, ["image_id", "region"], "left").withColumn("perimeter", F.col("rim") + F.coalesce("walls", F.lit(0))).drop("rim", "walls")


def protection(area: Column, perimeter: Column) -> Column:
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    thin = clamp(F.lit(2.0) - area * 2.0 / perimeter)
    long = clamp((perimeter * perimeter / (area * 16.0) - 1.0) / 3.0)
    return F.when((area == 0) | (perimeter == 0), 0.0).otherwise(thin * long)


def ward(prefix_a: str, prefix_b: str) -> Column:
    """Growth of the squared error if two regions become one: n m / (n + m) times the squared gap of their means."""
    n, m = F.col(prefix_a + "area"), F.col(prefix_b + "area")
    gap = [F.col(prefix_a + c) / n - F.col(prefix_b + c) / m for c in ("sl", "sa", "sb")]
    return n * m / (n + m) * (gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])


def paired(regions: DataFrame, sides: DataFrame, *more: str) -> DataFrame:
    """sides with the sums of both regions, prefixed a_ and b_."""
    named = lambda p, side: regions.select("image_id", F.col("region").alias(side), *(F.col(c).alias(p + c) for c in ("area", "sl", "sa", "sb", *more)))
    return sides.join(named("a_", "low"), ["image_id", "low"]).join(named("b_", "high"), ["image_id", "high"])


def merge_costs(regions: DataFrame, sides: DataFrame) -> DataFrame:
    """image_id, low, high, cost of merging each adjacent pair."""
    pair = paired(regions, sides, "claim", "perimeter")
    n, m, length = F.col("a_area"), F.col("b_area"), F.col("boundary_length")
    claim = F.when(F.col("a_claim") == F.col("b_claim"), 0.0).otherwise(CLAIM_PENALTY * WEIGHTS[3])
    edge = F.col("weight_sum") / TOP / length * length * EDGE_SCALE
    guard = F.when(n <= m, protection(n, F.col("a_perimeter"))).otherwise(protection(m, F.col("b_perimeter"))) * PROTECTION_SCALE
    return pair.select("image_id", "low", "high", ((ward("a_", "b_") + claim + edge + guard) / (length * F.greatest(n, m) / (n + m))).alias("cost"))


def spanning_forest(cost: DataFrame, k: float = SCALE_K) -> DataFrame:
    """image_id, pixel_id, region: for each image Kruskal with the size-dependent predicate.
    Edges are taken by weight, then in raster order; an image is one task, as the order is the algorithm."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["weight", "a", "dir"], kind="stable")
        ids = np.unique(np.concatenate([part["a"], part["b"]]))
        a, b = np.searchsorted(ids, part["a"]).tolist(), np.searchsorted(ids, part["b"]).tolist()
        up, size, inner = list(range(len(ids))), [1] * len(ids), [0] * len(ids)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for p, q, w in zip(a, b, part["weight"].tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q and w <= min(inner[p] + k / size[p], inner[q] + k / size[q]):
                keep, drop = (p, q) if (size[p], -p) > (size[q], -q) else (q, p)
                up[drop] = keep
                size[keep] += size[drop]
                inner[keep] = max(inner[keep], inner[drop], w)
        roots = np.array([root(i) for i in range(len(ids))])
        first = np.full(len(ids), len(ids))
        np.minimum.at(first, roots, np.arange(len(ids)))
        _, region = np.unique(first[roots], return_inverse=True)  # dense, by first pixel
        return pd.DataFrame({"image_id": part["image_id"].iloc[0], "pixel_id": ids, "region": region.astype(np.int64)})

    return cost.groupBy("image_id").applyInPandas(solve, f"image_id {dict(cost.dtypes)['image_id']}, pixel_id long, region long")


def merge_regions(regions: DataFrame, sides: DataFrame, threshold: float = 0.02) -> DataFrame:
    """image_id, region, root after best-first merging of pairs whose cost stays within the threshold.

    Each image is one task. The larger region survives, the lower id on ties. Pinned regions of different
    claims never merge; a pinned claim outlives a merge with an unpinned region. The heap keeps stale
    entries: one whose regions have changed since is priced again when it is taken.
    """

    def solve(regions: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        if regions.empty:
            return pd.DataFrame({"image_id": [], "region": [], "root": []})
        regions = regions.sort_values("region")
        root = best_first(regions, sides, threshold)
        return pd.DataFrame({"image_id": regions["image_id"].iloc[0], "region": regions["region"].to_numpy(), "root": root})

    return regions.groupBy("image_id").cogroup(sides.groupBy("image_id")).applyInPandas(solve, f"image_id {dict(regions.dtypes)['image_id']}, region long, root long")


class Merging:
    """Regions of one image while they merge."""

    def __init__(self, regions: pd.DataFrame, sides: pd.DataFrame) -> None:
        self.names = regions["region"].tolist()
        at = {r: k for k, r in enumerate(self.names)}
        self.stat = regions[["area", "sl", "sa", "sb", "perimeter"]].to_numpy(dtype=float)
        self.claim, self.pinned = regions["claim"].tolist(), regions["pinned"].tolist()
        self.generation, self.up = [0] * len(at), list(range(len(at)))
        self.near: list[dict[int, tuple[float, float]]] = [{} for _ in at]
        for a, b, n, w in sides[["low", "high", "boundary_length", "weight_sum"]].itertuples(index=False):
            self.near[at[a]][at[b]] = self.near[at[b]][at[a]] = (n, w)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def guard(self, k: int) -> float:
        area, rim = self.stat[k, 0], self.stat[k, 4]
        return min(max(2 - 2 * area / rim, 0), 1) * min(max((rim * rim / (16 * area) - 1) / 3, 0), 1) if area and rim else 0.0

    def cost(self, a: int, b: int) -> float | None:
        """What merging two regions costs; None if they may not merge or do not touch."""
        if b not in self.near[a] or (self.pinned[a] and self.pinned[b] and self.claim[a] != self.claim[b]):
            return None
        length, weight = self.near[a][b]
        n, m = self.stat[a, 0], self.stat[b, 0]
        gap = self.stat[a, 1:4] / n - self.stat[b, 1:4] / m
        extra = (0.0 if self.claim[a] == self.claim[b] else CLAIM_PENALTY * WEIGHTS[3]) + EDGE_SCALE * weight / TOP + PROTECTION_SCALE * self.guard(a if n <= m else b)
        return (n * m / (n + m) * float(gap @ gap) + extra) / (length * max(n, m) / (n + m))

    def merge(self, a: int, b: int) -> int:
        """Merge two roots; the one that is left."""
        keep, drop = (a, b) if (self.stat[a, 0], -a) > (self.stat[b, 0], -b) else (b, a)
        shared = self.near[keep].pop(drop)
        self.near[drop].pop(keep)
        for c, (n, w) in self.near[drop].items():
            self.near[c].pop(drop)
            old = self.near[keep].get(c, (0, 0))
            self.near[keep][c] = self.near[c][keep] = (old[0] + n, old[1] + w)
        self.near[drop] = {}
        self.stat[keep, :4] += self.stat[drop, :4]
        self.stat[keep, 4] += self.stat[drop, 4] - 2 * shared[0]
        if self.pinned[drop] and not self.pinned[keep]:
            self.pinned[keep], self.claim[keep] = True, self.claim[drop]
        self.up[drop] = keep
        self.generation[keep] += 1
        self.generation[drop] += 1
        return keep


def best_first(regions: pd.DataFrame, sides: pd.DataFrame, threshold: float) -> list[int]:
    """The surviving region of each region."""
    state, heap = Merging(regions, sides), []

    def push(a: int, b: int) -> None:
        a, b = min(a, b), max(a, b)
        price = state.cost(a, b)
        if price is not None and price <= threshold:
            heapq.heappush(heap, (math.floor(price * 1e9 + 0.5), a, b, state.generation[a], state.generation[b]))

    if threshold > 0:
        for a, near in enumerate(state.near):
            for b in near:
                if a < b:
                    push(a, b)
    while heap:
        _, low, high, one, two = heapq.heappop(heap)
        a, b = state.root(low), state.root(high)
        if a == b:
            continue
        if (a, b) != (low, high) or (one, two) != (state.generation[a], state.generation[b]):
            push(a, b)
            continue
        keep = state.merge(a, b)
        for c in state.near[keep]:
            push(keep, c)
    return [state.names[state.root(k)] for k in range(len(state.names))]


def relabel(labels: DataFrame) -> DataFrame:
    """image_id, pixel_id, label of (image_id, pixel_id, root): dense within an image, by first appearance in raster order."""
    first = labels.groupBy("image_id", "root").agg(F.min("pixel_id").alias("first"))
    dense = first.select("image_id", "root", (F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1).cast("long").alias("label"))
    return labels.join(dense, ["image_id", "root"]).select("image_id", "pixel_id", "label")


def segment(px: DataFrame, pinned: Column, threshold: float = 0.02) -> DataFrame:
    """image_id, pixel_id, label: spanning forest, best-first merging and dense labels of each image.
    pinned: whether a region's claim is pinned."""
    ev = evidence(px)
    cost = written(edges(ev), "edges")
    forest = written(spanning_forest(cost), "forest")
    labels = forest.select("pixel_id", "region")
    sides = written(adjacency(labels, cost), "sides")
    regions = summaries(ev, labels, sides).withColumn("pinned", pinned)
    roots = merge_regions(regions, sides, threshold)
    return relabel(forest.join(roots, ["image_id", "region"]).select("image_id", "pixel_id", "root"))


def ownership(px: DataFrame, owners: DataFrame) -> DataFrame:
    """image_id, pixels, unowned, owned_twice: whether every pixel has exactly one owner of (image_id, pixel_id, ...)."""
    n = owners.groupBy("image_id", "pixel_id").agg(F.count("*").alias("n"))
    return px.select("image_id", "pixel_id").join(n, ["image_id", "pixel_id"], "left").groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_if(F.col("n").isNull()).alias("unowned"), F.count_if(F.col("n") > 1).alias("owned_twice"))
