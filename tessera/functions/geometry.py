"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def two_colour(x: tuple, first: tuple, second: tuple) -> tuple[Column, Column]:
    """(share of first, squared residual) of colours as a mix of two."""
    axis = [a - b for a, b in zip(first, second, strict=True)]
    along = [(v - b) * k for v, b, k in zip(x, second, axis, strict=True)]
    cover = F.least(F.greatest((along[0] + along[1] + along[2]) / sum(k * k for k in axis), F.lit(0.0)), F.lit(1.0))
    gap = [v - b - cover * k for v, b, k in zip(x, second, axis, strict=True)]
    return cover, gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def nearest_rank(ordered: Column, share: float) -> Column:
    return F.element_at(ordered, F.ceil(F.size(ordered) * share).cast("int"))


def cubic(p: tuple, t: Column) -> Column:
    s = F.lit(1.0) - t
    return s * s * s * float(p[0]) + s * s * t * (3.0 * p[1]) + s * t * t * (3.0 * p[2]) + t * t * t * float(p[3])


def cubic_slope(p: tuple, t: Column) -> Column:
    s = F.lit(1.0) - t
    return s * s * (3.0 * (p[1] - p[0])) + s * t * (6.0 * (p[2] - p[1])) + t * t * (3.0 * (p[3] - p[2]))


def point_segment(x: Column, y: Column, a: tuple, b: tuple) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = F.least(F.greatest(((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return distance(x, y, t * dx + a[0], t * dy + a[1])


def side(a: tuple, b: tuple, p: tuple) -> Column:
    return F.signum((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))


def crosses(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether two segments cross properly."""
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def octant(nx: Column, ny: Column) -> tuple[Column, Column]:
    """The larger and the smaller part of a direction's unit vector."""
    length = F.sqrt(nx * nx + ny * ny)
    return F.greatest(F.abs(nx), F.abs(ny)) / length, F.least(F.abs(nx), F.abs(ny)) / length


def coverage_for_offset(offset: Column, a: Column, b: Column) -> Column:
    """The share of a unit square behind a line whose direction's octant is (a, b), at a signed distance from its centre."""
    support, inner = (a + b) / 2, (a - b) / 2
    low, high = offset + support, support - offset
    return F.when(offset <= -support, 0.0).when(offset >= support, 1.0).when(offset <= -inner, low * low / (a * b * 2)).when(offset >= inner, F.lit(1.0) - high * high / (a * b * 2)).otherwise(offset / a + 0.5)


def offset_for_coverage(coverage: Column, a: Column, b: Column) -> Column:
    """The inverse of coverage_for_offset."""
    share = F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0))
    support, corner = (a + b) / 2, b / (a * 2)
    root = lambda v: F.sqrt(F.greatest(a * b * v * 2, F.lit(0.0)))
    return F.when(share <= corner, root(share) - support).when(share >= F.lit(1.0) - corner, support - root(F.lit(1.0) - share)).otherwise(a * (share - 0.5))


#: How often a curve is halved at most.
MOST_HALVINGS = 10


def chord_bound(p0: tuple, p1: tuple, p2: tuple, p3: tuple) -> Column:
    """How far a cubic may be from its chord: how far its control points are from the chord's thirds."""
    third = lambda k, share: p0[k] + (p3[k] - p0[k]) * share
    return F.greatest(distance(*p1, third(0, 1 / 3), third(1, 1 / 3)), distance(*p2, third(0, 2 / 3), third(1, 2 / 3)))


def flatten_depth(bound: Column, tolerance: float) -> Column:
    """The least number of halvings after which a quarter of the bound for each is within the tolerance; null beyond MOST_HALVINGS."""
    out = F.lit(None).cast("int")
    for depth in range(MOST_HALVINGS, -1, -1):
        out = F.when(bound / 4**depth <= tolerance, depth).otherwise(out)
    return out


def flatten(p0: tuple, p1: tuple, p2: tuple, p3: tuple, depth: Column) -> Column:
    """The points of a cubic at equal steps of its parameter; first and last are its own ends."""
    steps = F.pow(F.lit(2), depth).cast("int")

    def at(i: Column) -> Column:
        t = i / steps
        u = F.lit(1.0) - t
        inner = lambda k: u * u * u * p0[k] + u * u * t * 3 * p1[k] + u * t * t * 3 * p2[k] + t * t * t * p3[k]
        pick = lambda k: F.when(i == 0, p0[k]).when(i == steps, p3[k]).otherwise(inner(k))
        return F.struct(pick(0).alias("x"), pick(1).alias("y"))

    return F.transform(F.sequence(F.lit(0), steps), at)


def turning(p0: tuple, p1: tuple, p2: tuple, p3: tuple, samples: int) -> Column:
    """The angles between a cubic's slopes at equal steps, added up; infinite where a slope vanishes."""
    slope = lambda k, t: (p1[k] - p0[k]) * (3 * (1 - t) ** 2) + (p2[k] - p1[k]) * (6 * (1 - t) * t) + (p3[k] - p2[k]) * (3 * t * t)
    each = [(slope(0, i / samples), slope(1, i / samples)) for i in range(samples + 1)]
    size = [F.sqrt(x * x + y * y) for x, y in each]
    total, lost = F.lit(0.0), size[0] <= 1e-12
    for (ax, ay), (bx, by), n, m in zip(each, each[1:], size, size[1:], strict=False):
        total = total + F.acos(F.least(F.greatest((ax * bx + ay * by) / (n * m), F.lit(-1.0)), F.lit(1.0)))
        lost = lost | (m <= 1e-12)
    return F.when(lost, float("inf")).otherwise(total)


#: Quantised comparisons of lengths and ratios.
GRID = 1e6


def quantised(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v) * GRID + 0.5)


def fit_circles(points: DataFrame, key: str, tolerance: float, least: int = 17) -> DataFrame:
    """key, cx, cy, radius of the closed loops (key, i, x, y) that are whole circles within a tolerance: an algebraic fit on
    centred sums scaled by their root mean square, then the mean distance as radius; refused are loops of too few samples, of nearly no
    width, that cover less than 0.95 of a turn, wind more than 1.1, leave a gap over a tenth, or whose distances
    from the circle exceed the tolerance (half of it at the 95th of a hundred, all at the 99th, one and a half at most).
    The last sample of a loop repeats its first. Aggregations and windows within a loop, no Python."""
    order = Window.partitionBy(key).orderBy("i")
    whole = points.withColumns({"x1": F.lead("x").over(order), "y1": F.lead("y").over(order)})
    body = whole.where("x1 IS NOT NULL")  # all samples but the one that closes the loop
    mean = body.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).where(F.col("n") + 1 >= least)
    total = lambda e, name: F.sum(F.expr(e)).alias(name)
    c = body.join(mean, key).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    s = c.groupBy(key, "mx", "my", "n").agg(total("u*u", "uu"), total("u*v", "uv"), total("v*v", "vv"), total("u*(u*u + v*v)", "uz"), total("v*(u*u + v*v)", "vz"))
    s = s.withColumns({"det": F.expr("uu * vv - uv * uv"), "rms": F.expr("sqrt((uu + vv) / n)")}).where((quantised(F.col("rms")) > 0) & (quantised(F.expr("det / ((uu + vv) * (uu + vv))")) >= quantised(F.lit(1e-3))))
    s = s.select(key, "n", F.expr("mx + 0.5 * (uz * vv - vz * uv) / det").alias("cx"), F.expr("my + 0.5 * (vz * uu - uz * uv) / det").alias("cy"))
    around = body.join(s, key).withColumns({"ax": F.col("x") - F.col("cx"), "ay": F.col("y") - F.col("cy"), "bx": F.col("x1") - F.col("cx"), "by": F.col("y1") - F.col("cy")})
    around = around.withColumns({"turn": F.expr("atan2(ax * by - ay * bx, ax * bx + ay * by) / (2 * pi())"), "far": F.expr("sqrt(ax * ax + ay * ay)")})
    turns = around.groupBy(key, "cx", "cy", "n").agg(F.abs(F.sum("turn")).alias("support"), F.sum(F.abs("turn")).alias("winding"), F.max(F.abs("turn")).alias("gap"), F.avg("far").alias("radius"))
    turns = turns.where((quantised(F.col("radius")) > 0) & (quantised(F.col("support")) >= quantised(F.lit(0.95))) & (quantised(F.col("winding")) <= quantised(F.lit(1.1))) & (quantised(F.col("gap")) <= quantised(F.lit(0.1))))
    wrong = around.select(key, "far").join(turns.select(key, "radius", "n"), key).withColumn("wrong", F.abs(F.col("far") - F.col("radius")))
    rank = wrong.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("wrong")) - 1)
    pick = lambda p: F.max(F.when(F.col("k") == F.floor((F.col("n") - 1) * p / 100), F.col("wrong")))
    gate = rank.groupBy(key).agg(pick(95).alias("p95"), pick(99).alias("p99"), F.max("wrong").alias("most"))
    good = gate.where((quantised(F.col("p95")) <= quantised(F.lit(tolerance * 0.5))) & (quantised(F.col("p99")) <= quantised(F.lit(tolerance))) & (quantised(F.col("most")) <= quantised(F.lit(tolerance * 1.5))))
    return turns.join(good, key).select(key, "cx", "cy", "radius")


def hysteresis(samples: DataFrame, key: str, value: str, enter: float, leave: float) -> DataFrame:
    """key, i, strength: the strongest sample (the first on ties) of every run of samples (key, i, value) that stays at
    `leave` or above and somewhere reaches `enter`. Gaps and islands, within a key."""
    warm = F.col(value) >= leave
    group = F.row_number().over(Window.partitionBy(key).orderBy("i")) - F.row_number().over(Window.partitionBy(key, warm).orderBy("i"))
    runs = samples.withColumn("_g", group).where(warm).groupBy(key, "_g").agg(F.min(F.struct((-F.col(value)).alias("v"), "i")).alias("p"))
    return runs.select(key, F.col("p.i").alias("i"), (-F.col("p.v")).alias("strength")).where(F.col("strength") >= enter)


def corners(samples: DataFrame, key: str, scales: tuple) -> DataFrame:
    """key, i, scales, turn: the least angle by which the chain turns at a sample, between the points that lie each scale of arc length
    before and behind it, over the scales that fit on the chain; at least two have to. A chain's arc length is a running sum;
    the points are met by a join within the chain on whole units of arc length."""
    order = Window.partitionBy(key).orderBy("i")
    step = F.coalesce(distance(F.col("x"), F.col("y"), F.lag("x").over(order), F.lag("y").over(order)), F.lit(0.0))
    at = samples.withColumn("_step", step).withColumn("s", F.sum("_step").over(order)).withColumn("total", F.max("s").over(Window.partitionBy(key)))
    piece = at.select(key, F.col("s").alias("s0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("s").over(order).alias("s1"), F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1")).where("s1 > s0")
    asked = at.select(key, "i", "x", "y", "s", "total", F.explode(F.array(*map(F.lit, scales))).alias("scale")).where("s - scale >= 0 AND s + scale <= total")
    asked = asked.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).withColumn("want", F.col("s") + F.col("side") * F.col("scale"))
    met = asked.join(piece, [key]).where((F.col("s0") <= F.col("want")) & (F.col("want") < F.col("s1")) | ((F.col("want") == F.col("total")) & (F.col("s1") == F.col("total"))))
    share = (F.col("want") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    there = met.select(key, "i", "x", "y", "scale", "side", (F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("px"), (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias("py"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = there.groupBy(key, "i", "x", "y", "scale").agg(pick(-1, "px").alias("bx"), pick(-1, "py").alias("by"), pick(1, "px").alias("ax"), pick(1, "py").alias("ay"))
    ux, uy, vx, vy = F.col("x") - F.col("bx"), F.col("y") - F.col("by"), F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    turn = F.abs(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy))
    return both.withColumn("turn", turn).groupBy(key, "i").agg(F.count("*").alias("scales"), F.min("turn").alias("turn")).where("scales >= 2")
