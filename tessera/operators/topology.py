"""The planar graph of a label plane: darts, vertices, chains, cycles, faces; and its checks.

labels is (image_id, x, y, label): every pixel of every image, labels from 0. A dart is a unit step along a
border between two labels, named by where it starts (x, y: a corner of the pixel grid, y down) and its
direction (0 north, 1 east, 2 south, 3 west), with one label on its left. Outside the image stands EXTERIOR.

The successor of a dart is found by one join with the vertex at its end; chains and cycles are components
over successors. Nothing walks the plane, so images of any size and number go through the same plan. For the corners
of chains in order, what lies in one tile of the plane is strung together at once; only chains that cross tiles need components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.operators.graphs import connected_components
from tessera.operators.lineage import written
from tessera.operators.masks import AT, shifted

EXTERIOR = -1
#: For each side of a pixel: where the neighbour is, where the dart that has the pixel on its left starts, its direction.
SIDES = (((0, -1), (1, 0), 3), ((-1, 0), (0, 0), 2), ((0, 1), (0, 1), 1), ((1, 0), (1, 1), 0))
STEP_X, STEP_Y = (0, 1, 0, -1), (-1, 0, 1, 0)
# Weights of the terms that decide an ambiguous cell, the least squared separation of two colours, the residual that ends a mixture.
WEIGHTS = {"data": 1.0, "continuity": 2.0, "mixture": 1.0, "density": 1.0}
SEPARATION, MAX_RESIDUAL = 1e-5, 0.05


def by_direction(values: tuple, direction: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), direction + 1)


def darts(labels: DataFrame) -> DataFrame:
    """image_id, x, y, dir, lft, rgt: all darts, both ways along every border."""
    labels = labels.select(*AT, F.col("label").cast("long").alias("label"))
    side = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(sx).alias("sx"), F.lit(sy).alias("sy"), F.lit(d).alias("dir")) for (dx, dy), (sx, sy), d in SIDES])
    asked = labels.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), "label", F.explode(side).alias("s")).select("image_id", "px", "py", F.col("label").alias("lft"), "s.*", (F.col("px") + F.col("s.dx")).alias("x"), (F.col("py") + F.col("s.dy")).alias("y"))
    met = asked.join(labels.withColumnRenamed("label", "rgt"), AT, "left").where("rgt IS NULL OR lft <> rgt")
    inner = met.select("image_id", (F.col("px") + F.col("sx")).alias("x"), (F.col("py") + F.col("sy")).alias("y"), "dir", "lft", F.coalesce("rgt", F.lit(EXTERIOR)).alias("rgt"))
    back = F.struct((F.col("x") + by_direction(STEP_X, F.col("dir"))).alias("x"), (F.col("y") + by_direction(STEP_Y, F.col("dir"))).alias("y"), ((F.col("dir") + 2) % 4).alias("dir"), F.col("rgt").alias("lft"), F.col("lft").alias("rgt"))
    outer = inner.where(F.col("rgt") == EXTERIOR).select("image_id", back.alias("b")).select("image_id", "b.*")
    return inner.union(outer).withColumn("dir", F.col("dir").cast("int"))


def vertices(found: DataFrame) -> DataFrame:
    """image_id, x, y, degree, out (bit d is set if a dart leaves in direction d)."""
    return found.groupBy(*AT).agg(F.count("*").alias("degree"), F.bit_or(F.expr("shiftleft(1, dir)")).alias("out"))


# ------------------------------------------------------------- ambiguity ----
def ambiguous(labels: DataFrame) -> DataFrame:
    """image_id, x, y (the corner), nw, ne of the cells whose diagonals each hold one label and differ."""
    at = lambda dx, dy, n: labels.select("image_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("label").cast("long").alias(n))
    four = at(1, 1, "nw").join(at(0, 1, "ne"), AT).join(at(1, 0, "sw"), AT).join(at(0, 0, "se"), AT)
    return four.where("nw = se AND ne = sw AND nw <> ne").select(*AT, "nw", "ne")


def connected(grid: np.ndarray, label: np.ndarray, first: tuple[int, int], second: tuple[int, int]) -> np.ndarray:
    """Whether two pixels of each 6 x 6 grid are joined by a four-connected path of a label inside it."""
    same = grid == label[:, None, None]
    seen = np.zeros(same.shape, bool)
    seen[:, first[0], first[1]] = same[:, first[0], first[1]]
    for _ in range(36):
        grown = seen.copy()
        grown[:, 1:] |= seen[:, :-1]
        grown[:, :-1] |= seen[:, 1:]
        grown[:, :, 1:] |= seen[:, :, :-1]
        grown[:, :, :-1] |= seen[:, :, 1:]
        grown &= same
        if (grown == seen).all():
            break
        seen = grown
    return seen[:, second[0], second[1]]


def residual(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far c is from every mix of a and b; infinite where those two are too close to tell."""
    axis = a - b
    size = (axis**2).sum(axis=1)
    cover = np.clip(((c - b) * axis).sum(axis=1) / np.maximum(size, 1e-30), 0, 1)
    gap = c - b - cover[:, None] * axis
    return np.where(size <= SEPARATION, np.inf, np.sqrt((gap**2).sum(axis=1)))


def judged(part: pd.DataFrame, pixel_art: bool) -> pd.DataFrame:
    """joined and by_continuity for cells with their neighbourhoods: the diagonal that costs less to join."""
    n = len(part)
    grid = np.stack(part["grid"].to_numpy()).reshape(n, 6, 6) if n else np.zeros((0, 6, 6))
    lab = np.stack(part["lab"].to_numpy()).reshape(n, 4, 3) if n else np.zeros((0, 4, 3))
    rgb = np.stack(part["rgb"].to_numpy()).reshape(n, 4, 3) if n else np.zeros((0, 4, 3))
    nw, ne = part["nw"].to_numpy(), part["ne"].to_numpy()
    # rows of the grid are y - 3 to y + 2; the cell's pixels are at 2 and 3; colours come as nw, ne, sw, se
    sides = ((nw, (2, 2), (3, 3), ((1, 1), (4, 4)), (0, 3), (1, 2)), (ne, (2, 3), (3, 2), ((1, 4), (4, 1)), (1, 2), (0, 3)))
    energy, carry = [], []
    for label, first, second, beyond, own, other in sides:
        data = np.clip(np.sqrt(((lab[:, own[0]] - lab[:, own[1]]) ** 2).sum(axis=1)), 0, 1)
        matches = sum((grid[:, a, b] == label).astype(float) for a, b in beyond)
        cont = np.where(connected(grid, label, first, second), 0.0, 0.5 + 0.25 * matches)
        mix = np.zeros(n) if pixel_art else np.clip(1 - residual(rgb[:, own[0]], rgb[:, other[0]], rgb[:, other[1]]) / MAX_RESIDUAL, 0, 1)
        dense = (grid[:, 1:5, 1:5] == label[:, None, None]).mean(axis=(1, 2))
        energy.append(np.floor((WEIGHTS["data"] * data + WEIGHTS["continuity"] * (1 - cont) + WEIGHTS["mixture"] * mix + WEIGHTS["density"] * dense) * 1e9 + 0.5))
        carry.append(cont)
    first = (energy[0] < energy[1]) | ((energy[0] == energy[1]) & (nw <= ne))
    return part[AT].assign(joined=np.where(first, nw, ne).astype(np.int64), by_continuity=np.abs(carry[0] - carry[1]) > 1e-9)


def decisions(labels: DataFrame, px: DataFrame, pixel_art: bool = False) -> DataFrame:
    """image_id, x, y, joined (the label whose diagonal is joined), by_continuity of every ambiguous cell. Only the
    cells' neighbourhoods of six by six pixels travel."""
    cells = ambiguous(labels)
    offsets = [(dx, dy) for dy in range(-3, 3) for dx in range(-3, 3)]
    step = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(offsets)])
    l, a, b = C.oklab(*(C.unit(c) for c in "rgb"), "engine")
    seen = labels.select(*AT, F.col("label").cast("long").alias("label")).join(px.select(*AT, F.array(l, a, b).alias("lab"), F.array(*(C.to_linear(C.unit(c)) for c in "rgb")).alias("rgb")), AT, "left")
    asked = cells.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "nw", "ne", F.explode(step).alias("s")).select("image_id", "cx", "cy", "nw", "ne", F.col("s.k").alias("k"), (F.col("cx") + F.col("s.dx")).alias("x"), (F.col("cy") + F.col("s.dy")).alias("y"))
    near = asked.join(seen, AT, "left").withColumn("inner", F.col("k").isin(14, 15, 20, 21))
    zero = F.array(*[F.lit(0.0)] * 3)
    gathered = near.groupBy("image_id", "cx", "cy", "nw", "ne").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("label", F.lit(-2)).alias("v")))).alias("g"), F.array_sort(F.collect_list(F.when(F.col("inner"), F.struct("k", F.coalesce("lab", zero).alias("lab"), F.coalesce("rgb", zero).alias("rgb"))))).alias("c"))
    flat = gathered.select("image_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "nw", "ne", F.transform("g", lambda v: v["v"]).alias("grid"), F.flatten(F.transform("c", lambda v: v["lab"])).alias("lab"), F.flatten(F.transform("c", lambda v: v["rgb"])).alias("rgb"))

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield judged(part, pixel_art)

    kind = dict(flat.dtypes)
    return flat.mapInPandas(decide, f"image_id {kind['image_id']}, x {kind['x']}, y {kind['y']}, joined long, by_continuity boolean")


# ----------------------------------------------------------------- graph ----
def successors(found: DataFrame, joined: DataFrame) -> DataFrame:
    """Darts with end_x, end_y, next_dir (which keeps the same label on the left) and through (whether the end is no node,
    so that a chain goes on). joined: decisions() of the ambiguous cells."""
    ends = found.withColumns({"end_x": F.col("x") + by_direction(STEP_X, F.col("dir")), "end_y": F.col("y") + by_direction(STEP_Y, F.col("dir"))})
    v = vertices(found).join(joined.select(*AT, "joined"), AT, "left").select("image_id", F.col("x").alias("end_x"), F.col("y").alias("end_y"), "degree", "out", "joined")
    turn = lambda k: ((F.col("dir") + k) % 4).cast("int")
    leaves = lambda k: F.expr(f"shiftright(out, (dir + {k}) % 4) % 2 = 1")
    onward = F.when(F.col("joined") == F.col("lft"), turn(1)).when(leaves(3), turn(3)).when(leaves(0), turn(0)).otherwise(turn(1))
    return ends.join(v, ["image_id", "end_x", "end_y"]).withColumns({"next_dir": onward, "through": (F.col("degree") == 2) | F.col("joined").isNotNull()}).drop("degree", "out", "joined")


def key(x: str, y: str, direction: str) -> Column:
    """A dart's name, in raster order."""
    return F.struct("image_id", F.col(y).alias("y"), F.col(x).alias("x"), F.col(direction).alias("dir"))


class Topology:
    """darts: image_id, dart, twin, next, chain, through, lft, rgt, cross (twice the signed area of its step) and where it starts and ends.
    chains: one half-edge for each chain: its first and last dart, its twin, the next one of its face, its cycle, labels on both sides."""

    def __init__(self, labels: DataFrame, px: DataFrame, pixel_art: bool = False) -> None:
        self.labels = labels
        self.joined = written(decisions(labels, px, pixel_art), "ambiguous")
        steps = successors(darts(labels), self.joined)
        cross = F.col("x") * F.col("end_y") - F.col("end_x") * F.col("y")
        self.steps = written(steps.select("image_id", key("x", "y", "dir").alias("dart"), key("end_x", "end_y", "next_dir").alias("next"), F.struct("image_id", F.col("end_y").alias("y"), F.col("end_x").alias("x"), ((F.col("dir") + 2) % 4).cast("int").alias("dir")).alias("twin"), "through", "lft", "rgt", cross.alias("cross"), "x", "y", "end_x", "end_y"), "darts")

    @cached_property
    def darts(self) -> DataFrame:
        named = connected_components(self.steps.where("through").select(F.col("dart").alias("a"), F.col("next").alias("b")))
        return written(self.steps.join(named.select(F.col("node").alias("dart"), "component"), "dart", "left").withColumn("chain", F.coalesce("component", "dart")).drop("component"), "darts-chained")

    @cached_property
    def chains(self) -> DataFrame:
        of = self.darts.select("dart", "chain")
        last = self.darts.where("NOT through").select("chain", F.col("next").alias("dart")).join(of.withColumnRenamed("chain", "next"), "dart").select("chain", "next")
        first = self.darts.join(self.darts.where("NOT through").select(F.col("next").alias("dart")).distinct(), "dart", "left_semi").select("chain", F.col("dart").alias("first"))
        twins = self.darts.where("dart = chain").select("chain", F.col("twin").alias("dart")).join(of.withColumnRenamed("chain", "twin_chain"), "dart").select("chain", F.col("twin_chain").alias("twin"))
        total = self.darts.groupBy("image_id", "chain").agg(F.count("*").alias("steps"), F.sum("cross").alias("cross"), F.min("lft").alias("lft"), F.max("lft").alias("lft_max"), F.min("rgt").alias("rgt"))
        flat = written(total.join(last, "chain", "left").join(first, "chain", "left").join(twins, "chain", "left").withColumns({"next": F.coalesce("next", "chain"), "first": F.coalesce("first", "chain")}), "chains")
        cycle = connected_components(flat.select(F.col("chain").alias("a"), F.col("next").alias("b")))
        return written(flat.join(cycle.select(F.col("node").alias("chain"), "component"), "chain", "left").withColumn("cycle", F.coalesce("component", "chain")).drop("component"), "half-edges")

    def cycles(self) -> DataFrame:
        """image_id, cycle, face, steps, area, kind, place: outer cycles before holes within a face, then by their first half-edge."""
        from pyspark.sql import Window

        each = self.chains.groupBy("image_id", "cycle").agg(F.min("lft").alias("face"), F.sum("steps").alias("steps"), (F.sum("cross") / 2).alias("area"))
        each = each.withColumn("kind", F.when(F.col("area") < 0, "outer").otherwise("hole"))
        return each.withColumn("place", F.row_number().over(Window.partitionBy("image_id", "face").orderBy(F.col("kind") == "hole", "cycle")))

    def edges(self) -> DataFrame:
        """Shared edges, each once, from its lesser half-edge: labels on both sides, both ends and flags."""
        e = self.chains.where("chain <= twin")
        border = (F.col("lft") == EXTERIOR) | (F.col("rgt") == EXTERIOR)
        return e.select("image_id", "chain", "twin", F.col("lft").alias("left_face"), F.col("rgt").alias("right_face"), "steps", F.col("first.x").alias("x"), F.col("first.y").alias("y"), border.alias("domain_border"), (~border).alias("visible_interface"))

    def incidence(self) -> DataFrame:
        """image_id, x, y, chain: every end of every shared edge at its vertex (a loop counts twice)."""
        ends = self.chains.select("chain", F.col("first.x").alias("x"), F.col("first.y").alias("y"), "image_id", "twin")
        return ends.select("image_id", "x", "y", F.least("chain", "twin").alias("chain"))

    def counts(self) -> DataFrame:
        """For each image: vertices, edges, half-edges, cycles, holes of interior faces, interior faces, junctions (vertices of a degree other than two), the Euler characteristic V - E + F."""
        v = self.incidence().groupBy("image_id", "x", "y").agg(F.count("*").alias("degree")).groupBy("image_id").agg(F.count("*").alias("vertices"), F.count_if(F.col("degree") != 2).alias("junctions"))
        e = self.chains.groupBy("image_id").agg(F.count("*").alias("half_edges"), F.count_if(F.col("chain") <= F.col("twin")).alias("edges"))
        c = self.cycles().groupBy("image_id").agg(F.count("*").alias("cycles"), F.count_if((F.col("kind") == "hole") & (F.col("face") != EXTERIOR)).alias("holes"))
        f = self.labels.groupBy("image_id").agg(F.count_distinct("label").alias("interior_faces"))
        return v.join(e, "image_id").join(c, "image_id").join(f, "image_id").withColumn("euler", F.col("vertices") - F.col("edges") + F.col("interior_faces") + 1)

    def violations(self) -> DataFrame:
        """check, violations: what does not hold, over all images."""
        d, c = self.darts, self.chains
        pair = c.join(c.select(F.col("chain").alias("twin"), F.col("twin").alias("back"), F.col("steps").alias("twin_steps"), F.col("lft").alias("twin_lft"), (-F.col("cross")).alias("twin_cross")), "twin", "left")
        follow = c.join(c.select(F.col("chain").alias("next"), F.col("lft").alias("next_lft")), "next", "left")
        area = self.cycles().where(F.col("face") != EXTERIOR).groupBy("image_id", "face").agg(F.sum("area").alias("area"), F.count_if(F.col("kind") == "outer").alias("outer"))
        pixels = self.labels.groupBy("image_id", F.col("label").cast("long").alias("face")).agg(F.count("*").alias("pixels")).join(area, ["image_id", "face"], "left")
        checks = {
            "twin_involution": pair.where("back IS NULL OR back <> chain"),
            "twin_is_distinct": c.where("twin = chain"),
            "next_prev_inverse": c.groupBy("next").count().where("count > 1"),
            "cycle_stays_on_one_face": follow.where("next_lft IS NULL OR next_lft <> lft"),
            "shared_edge_is_one_chain": pair.where("twin_steps IS NULL OR twin_steps <> steps OR twin_lft <> rgt OR twin_cross <> cross"),
            "half_edge_without_cycle": c.where("cycle IS NULL"),
            "dart_leaves_its_face": c.where("lft <> lft_max"),
            "exterior_has_no_outer_cycle": self.cycles().where(f"face = {EXTERIOR} AND kind = 'outer'"),
            "face_has_an_outer_cycle": pixels.where("coalesce(outer, 0) = 0"),
            "face_area": pixels.where("coalesce(-area, 0) <> pixels"),
            "dart_without_successor": d.join(d.select(F.col("dart").alias("next")), "next", "left_anti"),
        }
        out = None
        for name, rows in checks.items():
            one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
            out = one if out is None else out.union(one)
        return out


#: Side of the squares of the plane in which chains are first strung together.
TILE = 512


def segments(part: pa.Table, tile: int) -> pa.Table:
    """The darts of one tile strung together, one row for each chain's stretch in it: first, least and next dart, the place of
    the least one, whether it may come from another tile, whether it goes on in one, and its corners in order."""
    y, x, way, ny, nx, nway = (part[c].to_numpy().astype(np.int64) for c in ("y", "x", "dir", "ny", "nx", "ndir"))
    through, n = part["through"].to_numpy(zero_copy_only=False).astype(bool), len(y)
    low_y, low_x = min(y.min(), ny.min()), min(x.min(), nx.min())
    wide = max(x.max(), nx.max()) - low_x + 1
    named = lambda y, x, way: ((y - low_y) * wide + x - low_x) * 4 + way
    code = named(y, x, way)
    order = np.argsort(code)
    x, y, nx, ny, nway, way, through, code = (v[order] for v in (x, y, nx, ny, nway, way, through, code))
    onward = named(ny, nx, nway)
    at = np.minimum(np.searchsorted(code, onward), n - 1)
    at = np.where(through & (code[at] == onward), at, n)  # n: nothing follows here
    # minima over all that follows; on a closed chain, the least dart
    low, jump = np.arange(n + 1), np.r_[at, n]
    for _ in range(int(n).bit_length() + 1):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    closed = jump[:-1] < n
    before = np.full(n + 1, -1)
    before[at] = np.arange(n)
    head = (before[:-1] < 0) | closed & (low[:-1] == np.arange(n))
    at = np.where((at < n) & np.r_[head, False][at], n, at)  # closed chains are cut at their least dart
    # a dart's place, counted from the end of its stretch, which names the stretch
    left, jump, last = np.r_[(at < n).astype(np.int64), 0], np.r_[at, n], np.r_[np.where(at < n, at, np.arange(n)), n]
    for _ in range(int(n).bit_length() + 1):
        left, jump, last = left + left[jump], jump[jump], last[last]
    order = np.lexsort((-left[:-1], last[:-1]))
    first = np.flatnonzero(np.r_[True, last[order][1:] != last[order][:-1]])
    size = np.diff(np.r_[first, n])
    heads, tails = order[first], order[first + size - 1]
    least = np.minimum.reduceat(order, first)
    edge = lambda v: ((v > 0) & (v % tile == 0)) | (v % tile == tile - 1)
    corners = np.empty((n + len(first), 2), np.int64)
    start = first + np.arange(len(first))
    rest = np.ones(len(corners), bool)
    rest[start] = False
    corners[start] = np.c_[x[heads], y[heads]]
    corners[rest] = np.c_[nx[order], ny[order]]
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(corners) + 1, 2), pa.int32()), pa.array(corners.ravel()))
    columns = {
        "image_id": part["image_id"].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(first), np.int64))),
        **{f"h{c}": v[heads] for c, v in (("y", y), ("x", x), ("dir", way))},
        **{f"c{c}": v[least] for c, v in (("y", y), ("x", x), ("dir", way))},
        **{f"n{c}": v[tails] for c, v in (("y", ny), ("x", nx), ("dir", nway))},
        "place": left[heads] - left[least],
        "entered": ~closed[heads] & (edge(x[heads]) | edge(y[heads])),
        "leaves": ~closed[heads] & through[tails],
        "points": pa.ListArray.from_arrays(pa.array(np.r_[start, len(corners)], pa.int32()), pairs),
    }
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def strung(part: pd.DataFrame) -> pd.DataFrame:
    """One chain from its stretches: they follow each other, and a closed chain starts at its least dart."""
    rows = list(part.itertuples(index=False))
    at = {(r.hy, r.hx, r.hdir): r for r in rows}
    follows = {(r.ny, r.nx, r.ndir) for r in rows if r.leaves}
    best = min(rows, key=lambda r: (r.cy, r.cx, r.cdir))
    begin = [r for r in rows if (r.hy, r.hx, r.hdir) not in follows]
    r, points, turn = begin[0] if begin else best, [], best.place
    for _ in rows:
        points += [list(p) for p in r.points][len(points) > 0 :]
        if not r.leaves:
            break
        r = at[(r.ny, r.nx, r.ndir)]
    if not begin:
        points = points[turn:] + points[1 : turn + 1]
    return pd.DataFrame({"image_id": [best.image_id], "cy": [best.cy], "cx": [best.cx], "cdir": [best.cdir], "points": [points]})


def walked(topology: Topology, tile: int = TILE) -> DataFrame:
    """image_id, chain, points: the corners of every chain in order. A tile is one group, and so is a chain that crosses tiles:
    its length is bounded by its image."""
    place = lambda v, n: [F.col(f"{v}.y").alias(f"{n}y"), F.col(f"{v}.x").alias(f"{n}x"), F.col(f"{v}.dir").alias(f"{n}dir")]
    flat = topology.steps.select("image_id", *place("dart", ""), *place("next", "n"), "through")
    kind = dict(flat.dtypes)["image_id"]
    found = flat.groupBy("image_id", F.expr(f"y div {tile}"), F.expr(f"x div {tile}")).applyInArrow(lambda part: segments(part, tile), f"image_id {kind}, hy long, hx long, hdir long, cy long, cx long, cdir long, ny long, nx long, ndir long, place long, entered boolean, leaves boolean, points array<array<long>>")
    found = written(found, "stretches")
    out = ["image_id", "cy", "cx", "cdir", "points"]
    whole, rest = found.where("NOT entered AND NOT leaves").select(*out), found.where("entered OR leaves")
    if rest.isEmpty():
        return whole
    at = lambda n: F.struct("image_id", *(F.col(f"{n}{c}").alias(c) for c in ("y", "x", "dir")))
    chain = connected_components(rest.where("leaves").select(at("h").alias("a"), at("n").alias("b")))
    named = rest.withColumn("head", at("h")).join(chain.select(F.col("node").alias("head"), "component"), "head", "left").withColumn("component", F.coalesce("component", "head"))
    return whole.union(named.groupBy("component").applyInPandas(strung, f"image_id {kind}, cy long, cx long, cdir long, points array<array<long>>").select(*out))


def label_components(px: DataFrame, mask: DataFrame) -> DataFrame:
    """labels of a mask: 1 inside, 0 outside."""
    return px.select(*AT).join(mask.select(*AT, F.lit(1).alias("label")), AT, "left").select(*AT, F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def neighbours_of(labels: DataFrame) -> DataFrame:
    return shifted(labels, [(1, 0), (0, 1)], "label")
