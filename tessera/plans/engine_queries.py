"""The boundary-graph half: matching, edges, regions and planar counts over the derived picture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.operators import matching as M
from tessera.operators import regions as R
from tessera.operators import topology as T
from tessera.operators.lineage import written
from tessera.operators.masks import AT, frames
from tessera.operators.matching import Entry
from tessera.plans import oracle as O
from tessera.plans.registry import query
from tessera.sources.raster import pixels

PALETTE = [Entry("p0", "#C83232", True, tol=(0.08, 0.06, 0.10), priority=1), Entry("p1", "#2C40C8", True, tol=(0.10, 0.08, 0.12)), Entry("p2", "#78B45A", True, tol=(0.06, 0.05, 0.08), priority=2), Entry("p3", "#F0EBE1", True, tol=(0.05, 0.05, 0.05))]


def _score_sql(e: Entry, threshold: float = 0.02) -> str:
    import math

    al, a, b = e.lab("engine")
    ac, ah = math.hypot(a, b), math.atan2(b, a)
    th, tc, tl = e.tol
    t = f"least(1.0, greatest(0.0, least(c, {ac!r}) / {threshold}))"
    chord = f"(2 * sqrt(c * {ac!r}) * sin(atan2(sin(h - ({ah!r})), cos(h - ({ah!r}))) / 2))"
    return f"(pow((l - {al!r}) / {tl}, 2) + pow((c - {ac!r}) / {tc}, 2) + {t} * {t} * (3 - 2 * {t}) * pow({chord} / {th}, 2))"


ECTE = f"WITH {O.PIXEL},\n{O.lab(half='engine')}"
_SCORED = f"{ECTE}, scored AS MATERIALIZED (SELECT *, " + ", ".join(f"{_score_sql(e)} AS s{k}" for k, e in enumerate(PALETTE)) + " FROM lab)"
_KEYS = ", ".join(f"(CAST(floor(s{k} * 1e9 + 0.5) AS BIGINT), {-e.priority}, {k}, s{k})" for k, e in enumerate(PALETTE))


def lch(px):
    l, a, b = C.oklab(*(C.unit(x) for x in "rgb"), "engine")
    lab = px.withColumns({"l": l, "ok_a": a, "ok_b": b})
    return lab.withColumns({"c": C.chroma(F.col("ok_a"), F.col("ok_b")), "h": F.atan2("ok_b", "ok_a")})


def scores(v=F.col):
    return [M.reach_score(v("l"), v("c"), v("h"), e) for e in PALETTE]


@query("f_reach_score", f"{_SCORED} SELECT pixel_id, " + ", ".join(f"round(s{k}, 5) AS s{k}" for k in range(4)) + " FROM scored")
def f_reach_score(spark, d):
    return lch(pixels(spark, d)).select("pixel_id", *(F.round(s, 5).alias(f"s{k}") for k, s in enumerate(scores())))


@query("flt_reach_engine", f"{_SCORED} SELECT pixel_id, " + ", ".join(f"s{k} <= 1 AS c{k}" for k in range(4)) + " FROM scored")
def flt_reach_engine(spark, d):
    return lch(pixels(spark, d)).select("pixel_id", *((s <= 1).alias(f"c{k}") for k, s in enumerate(scores())))


@query("f_hue_weight", f"{ECTE} SELECT pixel_id, round(t * t * (3 - 2 * t), 5) AS weight FROM (SELECT pixel_id, least(1.0, greatest(0.0, least(c, 0.1) / 0.15)) AS t FROM lab)")
def f_hue_weight(spark, d):
    return lch(pixels(spark, d)).select("pixel_id", F.round(M.hue_weight(F.col("c"), F.lit(0.1), 0.15), 5).alias("weight"))


@query("f_quantkey", "SELECT l_orderkey, l_linenumber, l_discount, CAST(floor(l_discount * 1e9 + 0.5) AS BIGINT) AS key FROM lineitem")
def f_quantkey(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_discount", C.quant_key(F.col("l_discount")).alias("key"))


_BEST = f"{_SCORED}, best AS MATERIALIZED (SELECT *, CASE " + " ".join(f"WHEN s{k} = least(s0, s1, s2, s3) THEN {k}" for k in range(4)) + " END AS label, least(s0, s1, s2, s3) AS score FROM scored)"


def matched(px):
    """Best entry by distinct colour, joined back: exact, and far fewer colours than pixels."""
    work = lambda colours: lch(colours).withColumn("best", M.let(F.struct("l", "c", "h"), lambda v: M.best_match(scores(lambda n: v[n]), PALETTE)))
    return M.by_distinct_colour(px, ["r", "g", "b"], work)


@query("j_best_match", f"{_BEST} SELECT pixel_id, CAST(label AS BIGINT) AS label, score <= 1 AS claimed FROM best")
def j_best_match(spark, d):
    return matched(pixels(spark, d)).select("pixel_id", F.col("best.label").cast("long").alias("label"), (F.col("best.key") <= 10**9).alias("claimed"))


@query("j_assign", f"{_BEST} SELECT CAST(CASE WHEN a = 0 THEN 0 ELSE label END AS BIGINT) AS owner, CAST(count(*) FILTER (a > 0 AND score <= 1) AS BIGINT) AS claimed, CAST(count(*) FILTER (a > 0 AND score > 1) AS BIGINT) AS unclaimed, CAST(count(*) FILTER (a = 0) AS BIGINT) AS transparent FROM best GROUP BY 1")
def j_assign(spark, d):
    px = matched(pixels(spark, d)).withColumn("claimed", F.col("best.key") <= 10**9)
    owner = F.when(F.col("a") == 0, 0).otherwise(F.col("best.label")).cast("long").alias("owner")
    return px.groupBy(owner).agg(F.count_if((F.col("a") > 0) & F.col("claimed")).alias("claimed"), F.count_if((F.col("a") > 0) & ~F.col("claimed")).alias("unclaimed"), F.count_if(F.col("a") == 0).alias("transparent"))


@query("flt_color_evidence", f"WITH {O.PIXEL} SELECT pixel_id, a > 0 AS evidence FROM pixel")
def flt_color_evidence(spark, d):
    return pixels(spark, d).select("pixel_id", (F.col("a") > 0).alias("evidence"))


@query("agg_label_hist", f"{_BEST} SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n FROM best GROUP BY label")
def agg_label_hist(spark, d):
    return matched(pixels(spark, d)).groupBy(F.col("best.label").cast("long").alias("label")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------ edges, regions ----
_EV = f"{ECTE}, ev AS MATERIALIZED (SELECT image_id, pixel_id, x, y, a / 255.0 AS alpha, zone AS claim, CASE WHEN a > 0 THEN l ELSE 0 END AS l, CASE WHEN a > 0 THEN ok_a ELSE 0 END AS ok_a, CASE WHEN a > 0 THEN ok_b ELSE 0 END AS ok_b FROM lab)"


def _edge_sql() -> str:
    parts = []
    for k, (_, dx, dy, cx, cy) in enumerate(R.DIRECTIONS):
        gap = lambda q: f"(sqrt(pow(p.l - {q}.l, 2) + pow(p.ok_a - {q}.ok_a, 2) + pow(p.ok_b - {q}.ok_b, 2)) / 1.5)"
        colour = f"({gap('q')} / ({gap('q')} + 0.25))"
        coarse = f"coalesce({gap('f')} / ({gap('f')} + 0.25), {colour})" if cx or cy else "0"
        w = f"floor(least(1.0, ({colour} + 0.5 * least({colour}, {coarse}) + abs(p.alpha - q.alpha) + CASE WHEN p.claim = q.claim THEN 0 ELSE 0.25 END) / 2.75) * 65535 + 0.5)"
        w = f"least(65535, floor({w} * sqrt(2) + 0.5))" if dx and dy else w
        join = f"LEFT JOIN ev f ON f.image_id = p.image_id AND f.x = p.x + {cx} AND f.y = p.y + {cy}" if cx or cy else ""
        parts.append(f"SELECT p.image_id, p.pixel_id AS a, q.pixel_id AS b, {k} AS dir, CAST({w} AS BIGINT) AS weight FROM ev p JOIN ev q ON q.image_id = p.image_id AND q.x = p.x + ({dx}) AND q.y = p.y + {dy} {join}")
    return "edges AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


_EDGES = f"{_EV}, {_edge_sql()}"


@query("f_edge_weight", f"{_EDGES} SELECT image_id, a, b, CAST(dir AS BIGINT) AS dir, weight FROM edges")
def f_edge_weight(spark, d):
    return R.edges(R.evidence(pixels(spark, d))).select("image_id", "a", "b", F.col("dir").cast("long").alias("dir"), "weight")


@query("j_neighbour", f"{_EV} SELECT p.image_id, p.pixel_id AS a, q.pixel_id AS b FROM ev p JOIN ev q ON q.image_id = p.image_id AND (q.x - p.x, q.y - p.y) IN ((1, 0), (0, 1), (1, 1), (-1, 1)) AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y AND p.y + 1")
def j_neighbour(spark, d):
    """Each pixel with its right, lower and two lower diagonal neighbours, by equal coordinates."""
    px = pixels(spark, d).select("image_id", "x", "y", "pixel_id")
    from tessera.operators.masks import shifted

    there = shifted(px, [(dx, dy) for _, dx, dy, _, _ in R.DIRECTIONS], "pixel_id").withColumnRenamed("pixel_id", "a")
    return there.join(px.withColumnRenamed("pixel_id", "b"), ["image_id", "x", "y"]).select("image_id", "a", "b")


_GAP = "sqrt(pow(p.l - {0}.l, 2) + pow(p.ok_a - {0}.ok_a, 2) + pow(p.ok_b - {0}.ok_b, 2)) / 1.5"


@query("win_coarse_gradient", f"{_EV} SELECT p.image_id, p.pixel_id, round(({_GAP.format('q')}) / ({_GAP.format('q')} + 0.25), 6) AS fine, round(({_GAP.format('f')}) / ({_GAP.format('f')} + 0.25), 6) AS coarse FROM ev p JOIN ev q ON q.image_id = p.image_id AND q.x = p.x + 1 AND q.y = p.y + 1 LEFT JOIN ev f ON f.image_id = p.image_id AND f.x = p.x + 2 AND f.y = p.y + 2")
def win_coarse_gradient(spark, d):
    """Down the diagonal; the coarse response is null where the second pixel lies outside."""
    return R.coarse_gradient(R.evidence(pixels(spark, d)), 1, 1).select("image_id", "pixel_id", F.round("fine", 6).alias("fine"), F.round("coarse", 6).alias("coarse"))


@query("g_evidence", f"{_EV} SELECT image_id, pixel_id, round(alpha, 6) AS alpha, CAST(claim AS BIGINT) AS claim, round(l, 5) AS l, round(ok_a, 5) AS ok_a, round(ok_b, 5) AS ok_b FROM ev")
def g_evidence(spark, d):
    return R.evidence(pixels(spark, d)).select("image_id", "pixel_id", F.round("alpha", 6).alias("alpha"), F.col("claim").cast("long").alias("claim"), *(F.round(c, 5).alias(c) for c in ("l", "ok_a", "ok_b")))


@query("srt_edges", f"{_EDGES} SELECT image_id, a, b, weight, row_number() OVER (PARTITION BY image_id ORDER BY weight, a, dir) - 1 AS place FROM edges")
def srt_edges(spark, d):
    """Every edge's place in its image's order by weight, then raster position, then direction."""
    from pyspark.sql import Window

    order = Window.partitionBy("image_id").orderBy("weight", "a", "dir")
    return R.edges(R.evidence(pixels(spark, d))).select("image_id", "a", "b", "weight", (F.row_number().over(order) - 1).cast("long").alias("place"))


@query("srt_counting", f"{_EDGES} SELECT weight, CAST(count(*) AS BIGINT) AS edges, CAST(sum(count(*)) OVER (ORDER BY weight) - count(*) AS BIGINT) AS first_place FROM edges GROUP BY weight")
def srt_counting(spark, d):
    """Where each weight's edges start in sorted order; a running sum over at most 65,536 weights."""
    from pyspark.sql import Window

    n = R.edges(R.evidence(pixels(spark, d))).groupBy("weight").agg(F.count("*").alias("edges"))
    return n.select("weight", "edges", (F.sum("edges").over(Window.orderBy("weight")) - F.col("edges")).alias("first_place"))


_REGION = "label AS (SELECT image_id, pixel_id, (y // 9) * 9 + x // 12 AS region FROM ev)"
_SIDES = "sides AS MATERIALIZED (SELECT edges.image_id, least(p.region, q.region) AS low, greatest(p.region, q.region) AS high, count(*) AS boundary_length, sum(weight) AS weight_sum FROM edges JOIN label p ON p.pixel_id = a JOIN label q ON q.pixel_id = b WHERE dir < 2 AND p.region <> q.region GROUP BY 1, 2, 3)"
_SUMMARY = """base AS (SELECT label.image_id, region, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, sum(l) AS sl, sum(ok_a) AS sa, sum(ok_b) AS sb, sum(l*l + ok_a*ok_a + ok_b*ok_b) AS sq, avg(alpha) AS alpha,
 sum(CAST(x = 0 AS INT) + CAST(x = 99 AS INT) + CAST(y = 0 AS INT) + CAST(y = last AS INT)) AS rim FROM ev JOIN label USING (pixel_id) JOIN (SELECT image_id, max(y) AS last FROM ev GROUP BY image_id) e ON e.image_id = label.image_id GROUP BY ALL),
votes AS (SELECT label.image_id, region, claim, count(*) AS n FROM ev JOIN label USING (pixel_id) GROUP BY ALL), claims AS (SELECT image_id, region, claim FROM (SELECT *, row_number() OVER (PARTITION BY image_id, region ORDER BY n DESC, claim) AS k FROM votes) WHERE k = 1),
walls AS (SELECT image_id, region, sum(boundary_length) AS walls FROM (SELECT image_id, low AS region, boundary_length FROM sides UNION ALL SELECT image_id, high, boundary_length FROM sides) GROUP BY ALL),
regions AS MATERIALIZED (SELECT base.*, claim, rim + coalesce(walls, 0) AS perimeter FROM base JOIN claims USING (image_id, region) LEFT JOIN walls USING (image_id, region))"""
_GUARD = "least(1, greatest(0, 2 - 2.0 * area / perimeter)) * least(1, greatest(0, (perimeter * perimeter / (16.0 * area) - 1) / 3))"


def _parts(spark, d):
    px = pixels(spark, d)
    return R.evidence(px), px.select("pixel_id", F.expr("(y div 9) * 9 + x div 12").alias("region"))


def _sides(spark, d):
    ev, labels = _parts(spark, d)
    return R.adjacency(labels, R.edges(ev))


@query("j_adjacency", f"{_EDGES}, {_REGION}, {_SIDES} SELECT image_id, low, high FROM sides")
def j_adjacency(spark, d):
    return _sides(spark, d).select("image_id", "low", "high")


@query("agg_region_adj", f"{_EDGES}, {_REGION}, {_SIDES} SELECT image_id, low, high, CAST(boundary_length AS BIGINT) AS boundary_length, CAST(weight_sum AS BIGINT) AS weight_sum FROM sides")
def agg_region_adj(spark, d):
    return _sides(spark, d)


def _summary(spark, d):
    """Summaries and sides; the sides are written, as they are read more than once."""
    ev, labels = _parts(spark, d)
    sides = written(R.adjacency(labels, R.edges(ev)), "sides")
    return R.summaries(ev, labels, sides), sides


@query("agg_region_summary", f"{_EDGES}, {_REGION}, {_SIDES}, {_SUMMARY} SELECT image_id, region, CAST(area AS BIGINT) AS area, x0, x1, y0, y1, round(sl, 5) AS sl, round(sq, 5) AS sq, round(alpha, 6) AS alpha, claim, CAST(perimeter AS BIGINT) AS perimeter FROM regions")
def agg_region_summary(spark, d):
    return _summary(spark, d)[0].select("image_id", "region", "area", "x0", "x1", "y0", "y1", F.round("sl", 5).alias("sl"), F.round("sq", 5).alias("sq"), F.round("alpha", 6).alias("alpha"), "claim", F.col("perimeter").cast("long").alias("perimeter"))


@query("f_protection", f"{_EDGES}, {_REGION}, {_SIDES}, {_SUMMARY} SELECT image_id, region, round({_GUARD}, 6) AS protection FROM regions")
def f_protection(spark, d):
    return _summary(spark, d)[0].select("image_id", "region", F.round(R.protection(F.col("area").cast("double"), F.col("perimeter").cast("double")), 6).alias("protection"))


@query("agg_stats_merge", f"{_EDGES}, {_REGION}, {_SIDES}, {_SUMMARY} SELECT sides.image_id, low, high, round(a.area * b.area / (a.area + b.area) * (pow(a.sl / a.area - b.sl / b.area, 2) + pow(a.sa / a.area - b.sa / b.area, 2) + pow(a.sb / a.area - b.sb / b.area, 2)), 5) AS ward FROM sides JOIN regions a ON a.image_id = sides.image_id AND a.region = low JOIN regions b ON b.image_id = sides.image_id AND b.region = high")
def agg_stats_merge(spark, d):
    regions, sides = _summary(spark, d)
    return R.paired(regions, sides).select("image_id", "low", "high", F.round(R.ward("a_", "b_"), 5).alias("ward"))


@query("f_merge_cost", f"{_EDGES}, {_REGION}, {_SIDES}, {_SUMMARY}, g AS (SELECT *, {_GUARD} AS guard FROM regions) SELECT sides.image_id, low, high, round((a.area * b.area / (a.area + b.area) * (pow(a.sl / a.area - b.sl / b.area, 2) + pow(a.sa / a.area - b.sa / b.area, 2) + pow(a.sb / a.area - b.sb / b.area, 2)) + CASE WHEN a.claim = b.claim THEN 0 ELSE 0.005 END + 0.04 * weight_sum / 65535.0 + 0.25 * CASE WHEN a.area <= b.area THEN a.guard ELSE b.guard END) / (boundary_length * greatest(a.area, b.area) / (a.area + b.area)), 5) AS cost FROM sides JOIN g a ON a.image_id = sides.image_id AND a.region = low JOIN g b ON b.image_id = sides.image_id AND b.region = high")
def f_merge_cost(spark, d):
    regions, sides = _summary(spark, d)
    return R.merge_costs(regions, sides).select("image_id", "low", "high", F.round("cost", 5).alias("cost"))


@query("g_msf_partition")
def g_msf_partition(spark, d):
    return R.spanning_forest(R.edges(R.evidence(pixels(spark, d))))


def pinned():
    """Whether a region's claim is one of the pinned ones."""
    return F.col("claim") < 2


@query("g_region_merge")
def g_region_merge(spark, d):
    regions, sides = _summary(spark, d)
    return R.merge_regions(regions.withColumn("pinned", pinned()), sides)


@query("g_segment")
def g_segment(spark, d):
    return R.segment(pixels(spark, d), pinned())


@query("g_relabel", f"WITH {O.PIXEL}, label AS (SELECT image_id, pixel_id, (y // 9) * 9 + x // 12 AS root FROM pixel WHERE x >= 30 OR y >= 3), f AS (SELECT image_id, root, row_number() OVER (PARTITION BY image_id ORDER BY min(pixel_id)) - 1 AS label FROM label GROUP BY image_id, root) SELECT image_id, pixel_id, label FROM label JOIN f USING (image_id, root)")
def g_relabel(spark, d):
    px = pixels(spark, d).where("x >= 30 OR y >= 3")
    return R.relabel(px.select("image_id", "pixel_id", F.expr("(y div 9) * 9 + x div 12").alias("root")))


# ------------------------------------------------------------- topology ----
@query("win_ambiguity_2x2", f"WITH {O.PIXEL}, q AS (SELECT nw.image_id, nw.x, nw.y, nw.noise // 3 AS a, ne.noise // 3 AS b, sw.noise // 3 AS c, se.noise // 3 AS d FROM pixel nw JOIN pixel ne ON ne.image_id = nw.image_id AND ne.x = nw.x + 1 AND ne.y = nw.y JOIN pixel sw ON sw.image_id = nw.image_id AND sw.x = nw.x AND sw.y = nw.y + 1 JOIN pixel se ON se.image_id = nw.image_id AND se.x = nw.x + 1 AND se.y = nw.y + 1) SELECT image_id, x, y FROM q WHERE a = d AND b = c AND a <> b")
def win_ambiguity_2x2(spark, d):
    px = pixels(spark, d).select("image_id", "x", "y", F.expr("noise div 3").alias("v"))
    at = lambda dx, dy, n: px.select("image_id", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("v").alias(n))
    q = px.join(at(1, 0, "ne"), AT).join(at(0, 1, "sw"), AT).join(at(1, 1, "se"), AT)
    return q.where("v = se AND ne = sw AND v <> ne").select(*AT)


_DARTS = """lab4 AS (SELECT image_id, x, y, zone AS v FROM pixel),
walls AS (SELECT p.image_id, p.x + 1 AS x0, p.y AS y0, p.x + 1 AS x1, p.y + 1 AS y1, p.v AS lft, coalesce(q.v, -1) AS rgt FROM lab4 p LEFT JOIN lab4 q ON q.image_id = p.image_id AND q.x = p.x + 1 AND q.y = p.y WHERE q.v IS NULL OR p.v <> q.v
 UNION ALL SELECT image_id, 0, y, 0, y + 1, -1, v FROM lab4 WHERE x = 0
 UNION ALL SELECT p.image_id, p.x, p.y + 1, p.x + 1, p.y + 1, p.v, coalesce(q.v, -1) FROM lab4 p LEFT JOIN lab4 q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y + 1 WHERE q.v IS NULL OR p.v <> q.v
 UNION ALL SELECT image_id, x, 0, x + 1, 0, -1, v FROM lab4 WHERE y = 0)"""


def walls(px):
    """Unit wall segments between pixels of different zones, and around the frame: image_id, x0, y0, x1, y1, lft, rgt."""
    px = px.select(*AT, F.col("zone").alias("v"))
    right = px.join(px.select("image_id", (F.col("x") - 1).alias("x"), "y", F.col("v").alias("w")), AT, "left").where("w IS NULL OR v <> w")
    down = px.join(px.select("image_id", "x", (F.col("y") - 1).alias("y"), F.col("v").alias("w")), AT, "left").where("w IS NULL OR v <> w")
    row = lambda df, *c: df.select("image_id", *(F.expr(str(e)).cast("long").alias(n) for e, n in zip(c, ("x0", "y0", "x1", "y1", "lft", "rgt"), strict=True)))
    return row(right, "x + 1", "y", "x + 1", "y + 1", "v", "coalesce(w, -1)").union(row(px.where("x = 0"), 0, "y", 0, "y + 1", -1, "v")).union(row(down, "x", "y + 1", "x + 1", "y + 1", "v", "coalesce(w, -1)")).union(row(px.where("y = 0"), "x", 0, "x + 1", 0, -1, "v"))


@query("g_grid", f"WITH {O.PIXEL}, {_DARTS} SELECT * FROM walls")
def g_grid(spark, d):
    return walls(pixels(spark, d))


_DEGREE = "ends AS (SELECT image_id, x0 AS x, y0 AS y FROM walls UNION ALL SELECT image_id, x1, y1 FROM walls), degree AS (SELECT image_id, x, y, count(*) AS degree FROM ends GROUP BY image_id, x, y)"


def degrees(px):
    w = walls(px)
    return w.select("image_id", F.col("x0").alias("x"), F.col("y0").alias("y")).union(w.select("image_id", "x1", "y1")).groupBy(*AT).agg(F.count("*").alias("degree"))


@query("j_twin", f"WITH {O.PIXEL}, {_DARTS}, darts AS (SELECT image_id, x0, y0, x1, y1, lft FROM walls UNION ALL SELECT image_id, x1, y1, x0, y0, rgt FROM walls) SELECT d.image_id, d.x0, d.y0, d.x1, d.y1, d.lft AS face, t.lft AS twin_face FROM darts d JOIN darts t ON t.image_id = d.image_id AND t.x0 = d.x1 AND t.y0 = d.y1 AND t.x1 = d.x0 AND t.y1 = d.y0")
def j_twin(spark, d):
    w = walls(pixels(spark, d))
    darts = w.select("image_id", "x0", "y0", "x1", "y1", "lft").union(w.select("image_id", "x1", "y1", "x0", "y0", "rgt"))
    twin = darts.select("image_id", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("lft").alias("twin_face"))
    return darts.join(twin, ["image_id", "x0", "y0", "x1", "y1"]).withColumnRenamed("lft", "face")


@query("top_two_neighbours", f"{_EDGES}, {_REGION}, {_SIDES}, ends AS (SELECT image_id, low AS region, high AS other, boundary_length AS n FROM sides UNION ALL SELECT image_id, high, low, boundary_length FROM sides) SELECT image_id, region, other, CAST(n AS BIGINT) AS boundary_length FROM ends QUALIFY row_number() OVER (PARTITION BY image_id, region ORDER BY n DESC, other) <= 2")
def top_two_neighbours(spark, d):
    """The two longest shared boundaries of each region, lower ids first on ties; bounded lists, no window over a region's rows."""
    sides = _sides(spark, d)
    side = lambda one, two: F.struct(F.col(one).alias("region"), F.col(two).alias("other"))
    both = sides.select("image_id", F.explode(F.array(side("low", "high"), side("high", "low"))).alias("s"), "boundary_length").select("image_id", "s.*", "boundary_length")
    top = both.groupBy("image_id", "region").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("boundary_length")).alias("n"), "other"))), 1, 2).alias("t"))
    return top.select("image_id", "region", F.explode("t").alias("t")).select("image_id", "region", "t.other", (-F.col("t.n")).alias("boundary_length"))


_RING = "ring AS (SELECT image_id, zone FROM pixel WHERE x = 0 UNION ALL SELECT image_id, zone FROM pixel WHERE x = 99 UNION ALL SELECT image_id, zone FROM pixel WHERE y = 0 UNION ALL SELECT image_id, zone FROM pixel JOIN frame USING (image_id) WHERE y = high - 1)"


@query("agg_border_engine", f"WITH {O.PIXEL}, {O.FRAME}, {_RING}, n AS (SELECT image_id, zone AS region, count(*) AS border FROM ring GROUP BY ALL), c AS (SELECT image_id, zone AS region, arg_min(noise, struct_pack(k := -c, n := noise)) AS claim FROM (SELECT image_id, zone, noise, count(*) AS c FROM pixel GROUP BY ALL) GROUP BY ALL) SELECT image_id, region, CAST(border AS BIGINT) AS border, claim FROM n JOIN c USING (image_id, region) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY border DESC, region) = 1")
def agg_border_engine(spark, d):
    """The region of each image with most border pixels (corners count twice), the lower one on ties, and its commonest claim."""
    px = pixels(spark, d)
    sides = sum(((c).cast("int") for c in (F.col("x") == F.col("width") - 1, F.col("y") == 0, F.col("y") == F.col("height") - 1)), (F.col("x") == 0).cast("int"))
    ring = px.join(frames(px), "image_id").groupBy("image_id", F.col("zone").alias("region")).agg(F.sum(sides).alias("border")).where("border > 0")
    most = ring.groupBy("image_id").agg(F.min(F.struct((-F.col("border")).alias("n"), "region")).alias("p")).select("image_id", "p.region", (-F.col("p.n")).alias("border"))
    votes = px.groupBy("image_id", F.col("zone").alias("region"), F.col("noise").alias("claim")).agg(F.count("*").alias("n"))
    claim = votes.groupBy("image_id", "region").agg(F.min(F.struct((-F.col("n")).alias("n"), "claim"))["claim"].alias("claim"))
    return most.join(claim, ["image_id", "region"]).select("image_id", "region", "border", "claim")


@query("set_ownership_gate", f"WITH {O.PIXEL}, owned AS (SELECT image_id, pixel_id FROM pixel WHERE noise <> 4 UNION ALL SELECT image_id, pixel_id FROM pixel WHERE noise = 2), n AS (SELECT image_id, pixel_id, count(*) AS n FROM owned GROUP BY ALL) SELECT p.image_id, CAST(count(*) AS BIGINT) AS pixels, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS unowned, CAST(count(*) FILTER (n > 1) AS BIGINT) AS owned_twice FROM pixel p LEFT JOIN n USING (image_id, pixel_id) GROUP BY p.image_id")
def set_ownership_gate(spark, d):
    """A partition with gaps and overlaps put in, to show that both are counted."""
    px = pixels(spark, d)
    return R.ownership(px, px.where("noise <> 4").union(px.where("noise = 2")))


@query("set_ownership_gate_partition", f"WITH {O.PIXEL} SELECT image_id, CAST(count(*) AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS unowned, CAST(0 AS BIGINT) AS owned_twice FROM pixel GROUP BY image_id")
def set_ownership_gate_partition(spark, d):
    """Every pixel has exactly one label of the segmentation."""
    px = pixels(spark, d)
    return R.ownership(px, R.segment(px, pinned()))


# ------------------------------------------------------ the planar graph ----
#: Labels with single pixels, diagonals and junctions in them.
_LABELS = "label AS (SELECT image_id, x, y, CASE WHEN noise = 4 THEN 4 ELSE zone END AS label FROM pixel)"


def labels(px):
    return px.select(*AT, F.when(F.col("noise") == 4, 4).otherwise(F.col("zone")).cast("long").alias("label"))


def topology(spark, d):
    px = pixels(spark, d)
    return T.Topology(labels(px), px)


_SIDES_SQL = " UNION ALL ".join(f"SELECT p.image_id, p.x + {sx} AS x, p.y + {sy} AS y, {k} AS dir, p.label AS lft, coalesce(q.label, -1) AS rgt FROM label p LEFT JOIN label q ON q.image_id = p.image_id AND q.x = p.x + ({dx}) AND q.y = p.y + ({dy}) WHERE q.label IS NULL OR q.label <> p.label" for (dx, dy), (sx, sy), k in T.SIDES)
_STEP = "CASE dir WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS sx, CASE dir WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS sy"
_GRAPH = f"WITH RECURSIVE {O.PIXEL}, {_LABELS}, inner_ AS ({_SIDES_SQL}), darts AS MATERIALIZED (SELECT *, {_STEP} FROM (SELECT * FROM inner_ UNION ALL SELECT image_id, x + CASE dir WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END, y + CASE dir WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END, (dir + 2) % 4, rgt, lft FROM inner_ WHERE rgt = -1))"


@query("h_darts", f"{_GRAPH} SELECT image_id, x, y, CAST(dir AS BIGINT) AS dir, CAST(lft AS BIGINT) AS lft, CAST(rgt AS BIGINT) AS rgt FROM darts")
def h_darts(spark, d):
    return T.darts(labels(pixels(spark, d))).select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("dir").cast("long").alias("dir"), "lft", "rgt")


@query("agg_topology_counts", f"{_GRAPH}, v AS (SELECT image_id, x, y, count(*) AS degree FROM darts GROUP BY ALL) SELECT image_id, CAST(count(*) AS BIGINT) AS points, CAST(sum(degree) AS BIGINT) AS darts, CAST(count(*) FILTER (degree <> 2) AS BIGINT) AS junctions FROM v GROUP BY image_id")
def agg_topology_counts(spark, d):
    """Points of the grid on a border, darts that leave them, and points where other than two do."""
    v = T.vertices(T.darts(labels(pixels(spark, d))))
    return v.groupBy("image_id").agg(F.count("*").alias("points"), F.sum("degree").cast("long").alias("darts"), F.count_if(F.col("degree") != 2).alias("junctions"))


@query("g_ambiguity_cells", f"WITH {O.PIXEL}, {_LABELS} SELECT nw.image_id, nw.x + 1 AS x, nw.y + 1 AS y, CAST(nw.label AS BIGINT) AS nw, CAST(ne.label AS BIGINT) AS ne FROM label nw JOIN label ne ON ne.image_id = nw.image_id AND ne.x = nw.x + 1 AND ne.y = nw.y JOIN label sw ON sw.image_id = nw.image_id AND sw.x = nw.x AND sw.y = nw.y + 1 JOIN label se ON se.image_id = nw.image_id AND se.x = nw.x + 1 AND se.y = nw.y + 1 WHERE nw.label = se.label AND ne.label = sw.label AND nw.label <> ne.label")
def g_ambiguity_cells(spark, d):
    return T.ambiguous(labels(pixels(spark, d)))


@query("g_ambiguity")
def g_ambiguity(spark, d):
    """The label whose diagonal is joined in every ambiguous cell; tested against a scalar decision."""
    px = pixels(spark, d)
    return T.decisions(labels(px), px)


@query("g_extract_topology")
def g_extract_topology(spark, d):
    """One row for every half-edge; cycles and chains are tested by tracing the plane step by step."""
    c = topology(spark, d).chains
    at = lambda n: F.concat_ws(",", F.col(f"{n}.x"), F.col(f"{n}.y"), F.col(f"{n}.dir")).alias(n)
    return c.select("image_id", at("chain"), at("first"), at("twin"), at("next"), at("cycle"), "steps", "lft", "rgt", (F.col("cross") / 2).alias("area"))


@query("agg_face_area", f"{_GRAPH} SELECT image_id, CAST(lft AS BIGINT) AS face, CAST(round(sum(x * (y + sy) - (x + sx) * y) / 2.0) AS DOUBLE) AS area FROM darts GROUP BY image_id, lft")
def agg_face_area(spark, d):
    """Signed area of each face by its cycles: minus its pixels inside, plus the whole image for the exterior."""
    return topology(spark, d).cycles().groupBy("image_id", "face").agg(F.round(F.sum("area")).alias("area"))


@query("g_validate_topology", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST(0 AS BIGINT))" for n in ("twin_involution", "twin_is_distinct", "next_prev_inverse", "cycle_stays_on_one_face", "shared_edge_is_one_chain", "half_edge_without_cycle", "dart_leaves_its_face", "exterior_has_no_outer_cycle", "face_has_an_outer_cycle", "face_area", "dart_without_successor")) + ") AS t(\"check\", violations)")
def g_validate_topology(spark, d):
    """No check fails on what is extracted; the tests break a graph to see each fail."""
    return topology(spark, d).violations()


@query("agg_euler")
def agg_euler(spark, d):
    return topology(spark, d).counts()


@query("srt_cycles")
def srt_cycles(spark, d):
    c = topology(spark, d).cycles()
    return c.select("image_id", F.concat_ws(",", "cycle.x", "cycle.y", "cycle.dir").alias("cycle"), "face", "steps", "area", "kind", "place")


@query("j_incidence")
def j_incidence(spark, d):
    """Every end of every shared edge at its vertex."""
    return topology(spark, d).incidence().select("image_id", "x", "y", F.concat_ws(",", "chain.x", "chain.y", "chain.dir").alias("edge"))


@query("j_edge_face", f"{_GRAPH}, f AS (SELECT image_id, label, avg(r) AS r FROM label JOIN pixel USING (image_id, x, y) GROUP BY ALL) SELECT d.image_id, CAST(lft AS BIGINT) AS lft, CAST(rgt AS BIGINT) AS rgt, CAST(count(*) AS BIGINT) AS steps, round(coalesce(a.r, 0), 6) AS left_red, round(coalesce(b.r, 0), 6) AS right_red FROM darts d LEFT JOIN f a ON a.image_id = d.image_id AND a.label = lft LEFT JOIN f b ON b.image_id = d.image_id AND b.label = rgt WHERE lft < rgt GROUP BY ALL")
def j_edge_face(spark, d):
    """Borders with the mean colour of the face on either side; the exterior has none."""
    px = pixels(spark, d)
    lab = labels(px)
    face = lab.join(px, AT).groupBy("image_id", "label").agg(F.avg("r").alias("r"))
    side = lambda n, m: face.select("image_id", F.col("label").alias(n), F.col("r").alias(m))
    border = T.darts(lab).where("lft < rgt").groupBy("image_id", "lft", "rgt").agg(F.count("*").alias("steps"))
    both = border.join(side("lft", "left_red"), ["image_id", "lft"], "left").join(side("rgt", "right_red"), ["image_id", "rgt"], "left")
    return both.select("image_id", "lft", "rgt", "steps", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("left_red", "right_red")))


@query("h_walk_cycle")
def h_walk_cycle(spark, d):
    """The corners of every chain, in order."""
    w = T.walked(topology(spark, d))
    return w.select("image_id", F.concat_ws(",", "cx", "cy", "cdir").alias("chain"), F.to_json("points").alias("points"))


@query("agg_boundary_census", f"{_GRAPH} SELECT image_id, CAST(count(*) FILTER (lft = -1 OR rgt = -1) / 2 AS BIGINT) AS domain_border, CAST(count(*) FILTER (lft >= 0 AND rgt >= 0) / 2 AS BIGINT) AS visible_interface, CAST(count(*) FILTER (lft IN (0, 1) AND rgt IN (0, 1)) / 2 AS BIGINT) AS pinned_interface FROM darts GROUP BY image_id")
def agg_boundary_census(spark, d):
    """Unit steps of border by kind: at the frame, between faces, between two pinned ones (labels 0 and 1)."""
    x = T.darts(labels(pixels(spark, d)))
    half = lambda c: F.expr(f"count_if({c}) div 2").cast("long")
    return x.groupBy("image_id").agg(half("lft = -1 OR rgt = -1").alias("domain_border"), half("lft >= 0 AND rgt >= 0").alias("visible_interface"), half("lft IN (0, 1) AND rgt IN (0, 1)").alias("pinned_interface"))
