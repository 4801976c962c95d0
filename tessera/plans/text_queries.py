"""Scalars on text, JSON, geometry and settings; output documents; presets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import matching as M
from tessera.operators.masks import frames
from tessera.plans import oracle as O
from tessera.plans.colour_queries import PALETTE
from tessera.plans.registry import query
from tessera.sources.raster import pixels, sniff


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------- numbers ----
@query("f_mm_to_px", "SELECT p_partkey, round(p_size / 25.4 * 96, 6) AS px FROM part")
def f_mm_to_px(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.mm_to_px(F.col("p_size")), 6).alias("px"))


@query("prj_preview_scale", "SELECT o_orderkey, round(CASE WHEN n <= 1000000 THEN 1 ELSE sqrt(1000000.0 / n) END, 6) AS factor FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 40) AS BIGINT) + 1 AS n FROM orders)")
def prj_preview_scale(spark, d):
    n = F.floor(F.col("o_totalprice") * 40) + 1
    return table(spark, d, "orders").select("o_orderkey", F.round(T.preview_scale(n), 6).alias("factor"))


_FIELDS = [("minAreaPx2", 12.0), ("holeAreaPx2", 4.5), ("widthPx", 3.0), ("corner", 1.5)]


@query("prj_scale_fields", "SELECT p_partkey, k AS field, round(CASE WHEN k LIKE '%Px2' THEN v * s * s WHEN k LIKE '%Px' THEN v * s ELSE v END, 6) AS value FROM (SELECT p_partkey, 1.0 / (1 + p_size) AS s FROM part), (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _FIELDS) + ") AS f(k, v)")
def prj_scale_fields(spark, d):
    """Areas scale with the square of the factor, lengths with the factor, all else not at all."""
    profile = F.create_map([F.lit(x) for kv in _FIELDS for x in kv])
    scaled = T.scale_fields(profile, F.lit(1.0) / (F.col("p_size") + 1))
    return table(spark, d, "part").select("p_partkey", F.explode(scaled).alias("field", "value")).withColumn("value", F.round("value", 6))


@query("f_format_coordinate", "SELECT event_id, CASE WHEN t IN ('-0', '') THEN '0' ELSE t END AS text FROM (SELECT event_id, regexp_replace(regexp_replace(printf('%.3f', round(value - 50, 3)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS t FROM events)")
def f_format_coordinate(spark, d):
    return table(spark, d, "events").select("event_id", T.coordinate(F.round(F.col("value") - 50, 3), 3).alias("text"))


@query("f_escape_xml", "SELECT c_custkey, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS text FROM (SELECT c_custkey, c_name || ' <a & \"b\"> ''' || c_mktsegment AS t FROM customer)")
def f_escape_xml(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.escape_xml(F.concat("c_name", F.lit(" <a & \"b\"> '"), "c_mktsegment")).alias("text"))


@query("f_bg_rectangle", "SELECT p_partkey, 'M 0 0 L ' || p_size || ' 0 L ' || p_size || ' ' || (p_size + 7) || ' L 0 ' || (p_size + 7) || ' Z' AS path FROM part")
def f_bg_rectangle(spark, d):
    return table(spark, d, "part").select("p_partkey", T.rectangle_path(F.col("p_size"), F.col("p_size") + 7).alias("path"))


_PATH = "'<path d=\"' || 'M' || p_size || ',' || p_partkey || 'L' || p_size || ',0,3,4Z' || '\"/>'"


def path_of(part):
    return part.select("p_partkey", F.concat(F.lit('<path d="M'), F.col("p_size").cast("string"), F.lit(","), F.col("p_partkey").cast("string"), F.lit("L"), F.col("p_size").cast("string"), F.lit(',0,3,4Z"/>')).alias("t"))


@query("f_normalize_path", f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({_PATH}, '^.*d=\"([^\"]*)\".*$', '\\1'), '([MLZ])', ' \\1 ', 'g'), '[, ]+', ' ', 'g')) AS path FROM part")
def f_normalize_path(spark, d):
    return path_of(table(spark, d, "part")).select("p_partkey", T.normalize_path(F.col("t")).alias("path"))


@query("h_count_nodes", f"SELECT p_partkey, CAST(length(regexp_replace(t, '[^MLHVCSQTAZmlhvcsqtaz]', '', 'g')) AS BIGINT) AS nodes, CAST(length(regexp_replace(t, '[^Mm]', '', 'g')) AS BIGINT) AS subpaths FROM (SELECT p_partkey, regexp_replace({_PATH}, '^.*d=\"([^\"]*)\".*$', '\\1') AS t FROM part)")
def h_count_nodes(spark, d):
    clean = path_of(table(spark, d, "part")).select("p_partkey", T.normalize_path(F.col("t")).alias("t"))
    return clean.select("p_partkey", F.regexp_count("t", F.lit("[MLHVCSQTAZmlhvcsqtaz]")).cast("long").alias("nodes"), F.regexp_count("t", F.lit("[Mm]")).cast("long").alias("subpaths"))


@query("f_css_parse", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '#' || printf('%02X%02X%02X', a, b, c) WHEN 1 THEN '#' || printf('%X%X%X%X%X%X', d, d, e, e, f, f) ELSE '#' || printf('%02X%02X%02X', a, b, c) END AS hex FROM (SELECT p_partkey, p_partkey % 256 AS a, (p_partkey * 7) % 256 AS b, (p_partkey * 13) % 256 AS c, p_partkey % 16 AS d, (p_partkey * 3) % 16 AS e, (p_partkey * 5) % 16 AS f FROM part)")
def f_css_parse(spark, d):
    k = F.col("p_partkey")
    byte, half = [k % 256, k * 7 % 256, k * 13 % 256], [k % 16, k * 3 % 16, k * 5 % 16]
    text = F.when(k % 3 == 0, F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(b)), 2, "0") for b in byte])).when(k % 3 == 1, F.concat(F.lit("#"), *[F.hex(h) for h in half])).otherwise(F.concat(F.lit("rgb("), F.concat_ws(", ", *[b.cast("string") for b in byte]), F.lit(")")))
    return table(spark, d, "part").select("p_partkey", T.css_hex(text).alias("hex"))


@query("f_css_format", f"WITH {O.PIXEL} SELECT pixel_id, 'rgb(' || r || ', ' || g || ', ' || b || ')' AS css FROM pixel")
def f_css_format(spark, d):
    return pixels(spark, d).select("pixel_id", F.format_string("rgb(%d, %d, %d)", "r", "g", "b").alias("css"))


# ------------------------------------------------------- compositing ----
@query("f_premul", f"WITH {O.PIXEL} SELECT pixel_id, round({O.linear('r / 255.0')} * a / 255.0, 6) AS red, round({O.linear('r / 255.0')} * a / 255.0 + 0.25 * (1 - a / 255.0), 6) AS over_grey FROM pixel")
def f_premul(spark, d):
    alpha = C.unit("a")
    red = C.to_linear(C.unit("r")) * alpha
    return pixels(spark, d).select("pixel_id", F.round(red, 6).alias("red"), F.round(red + (F.lit(1.0) - alpha) * 0.25, 6).alias("over_grey"))


@query("f_cache_key", f"WITH {O.PIXEL} SELECT pixel_id, CAST(r * 16777216 + g * 65536 + b * 256 + a AS BIGINT) AS key FROM pixel")
def f_cache_key(spark, d):
    key = F.shiftleft(F.col("r"), 24).bitwiseOR(F.shiftleft(F.col("g"), 16)).bitwiseOR(F.shiftleft(F.col("b"), 8)).bitwiseOR(F.col("a"))
    return pixels(spark, d).select("pixel_id", key.alias("key"))


@query("f_two_color", f"WITH {O.PIXEL}, m AS (SELECT pixel_id, r / 255.0 AS x, g / 255.0 AS y, b / 255.0 AS z FROM pixel), t AS (SELECT *, least(1, greatest(0, ((x - 0.2) * 0.6 + (y - 0.3) * -0.1 + (z - 0.7) * -0.5) / 0.62)) AS cover FROM m) SELECT pixel_id, round(cover, 6) AS coverage, round(pow(x - 0.2 - cover * 0.6, 2) + pow(y - 0.3 + cover * 0.1, 2) + pow(z - 0.7 + cover * 0.5, 2), 6) AS residual FROM t")
def f_two_color(spark, d):
    """Each pixel as a mix of two colours: how much of the first, and what is left unexplained."""
    cover, rest = G.two_colour(tuple(C.unit(c) for c in "rgb"), (0.8, 0.2, 0.2), (0.2, 0.3, 0.7))
    return pixels(spark, d).select("pixel_id", F.round(cover, 6).alias("coverage"), F.round(rest, 6).alias("residual"))


@query("f_robust", "SELECT event_id, round(value / 1.5 / (value / 1.5 + 0.25), 6) AS response FROM events")
def f_robust(spark, d):
    return table(spark, d, "events").select("event_id", F.round(C.robust(F.col("value") / 1.5), 6).alias("response"))


# ----------------------------------------------------------- geometry ----
_CHAIN = "chain AS (SELECT event_id // 40 AS chain, event_id AS i, CAST(event_id % 97 AS DOUBLE) AS x, value AS y FROM events)"


def chain(spark, d):
    return table(spark, d, "events").select(F.expr("event_id div 40").alias("chain"), F.col("event_id").alias("i"), (F.col("event_id") % 97).cast("double").alias("x"), F.col("value").alias("y"))


def along():
    return Window.partitionBy("chain").orderBy("i")


@query("win_arclen", f"WITH {_CHAIN}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM chain WINDOW w AS (PARTITION BY chain ORDER BY i)) SELECT chain, i, round(sum(step) OVER (PARTITION BY chain ORDER BY i), 4) AS length FROM s")
def win_arclen(spark, d):
    step = F.coalesce(G.distance(F.col("x"), F.col("y"), F.lag("x").over(along()), F.lag("y").over(along())), F.lit(0.0))
    return chain(spark, d).withColumn("step", step).select("chain", "i", F.round(F.sum("step").over(along()), 4).alias("length"))


@query("win_chord_tangent", f"WITH {_CHAIN} SELECT chain, i, round(coalesce(lead(x, 2) OVER w, last_value(x) OVER z) - coalesce(lag(x, 2) OVER w, first_value(x) OVER z), 6) AS dx, round(coalesce(lead(y, 2) OVER w, last_value(y) OVER z) - coalesce(lag(y, 2) OVER w, first_value(y) OVER z), 6) AS dy FROM chain WINDOW w AS (PARTITION BY chain ORDER BY i), z AS (PARTITION BY chain ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_chord_tangent(spark, d):
    whole = along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chord = lambda c: F.coalesce(F.lead(c, 2).over(along()), F.last(c).over(whole)) - F.coalesce(F.lag(c, 2).over(along()), F.first(c).over(whole))
    return chain(spark, d).select("chain", "i", F.round(chord("x"), 6).alias("dx"), F.round(chord("y"), 6).alias("dy"))


@query("win_signed_area", f"WITH {_CHAIN}, s AS (SELECT chain, x * lead(y) OVER w - lead(x) OVER w * y AS c FROM chain WINDOW w AS (PARTITION BY chain ORDER BY i)) SELECT chain, round(sum(c) / 2, 2) AS area FROM s GROUP BY chain")
def win_signed_area(spark, d):
    cross = F.col("x") * F.lead("y").over(along()) - F.lead("x").over(along()) * F.col("y")
    run = F.sum("c").over(along().rowsBetween(Window.unboundedPreceding, Window.currentRow))  # added up along the chain, whatever the plan
    area = chain(spark, d).withColumn("c", cross).withColumn("run", run).groupBy("chain").agg((F.max_by("run", "i") / 2).alias("area"))
    # DuckDB rounds the product with 100, not the decimal digits: half a hundredth then goes the way of the product
    return area.select("chain", (F.round(F.col("area") * 100, 0) / 100).alias("area"))


@query("f_cubic", "SELECT event_id, round(pow(1 - t, 3) * 0 + 3 * pow(1 - t, 2) * t * 1 + 3 * (1 - t) * t * t * 4 + pow(t, 3) * 3, 6) AS x, round(3 * pow(1 - t, 2) * t * 2 + 3 * (1 - t) * t * t * -1 + pow(t, 3) * 5, 6) AS y, round(3 * pow(1 - t, 2) * 1 + 6 * (1 - t) * t * 3 + 3 * t * t * -1, 6) AS dx FROM (SELECT event_id, (event_id % 1000) / 1000.0 AS t FROM events)")
def f_cubic(spark, d):
    t = (F.col("event_id") % 1000) / 1000.0
    return table(spark, d, "events").select("event_id", F.round(G.cubic((0, 1, 4, 3), t), 6).alias("x"), F.round(G.cubic((0, 2, -1, 5), t), 6).alias("y"), F.round(G.cubic_slope((0, 1, 4, 3), t), 6).alias("dx"))


@query("f_point_segment", "SELECT event_id, round(sqrt(pow(x - (10 + t * 60), 2) + pow(y - (20 + t * 30), 2)), 6) AS distance FROM (SELECT event_id, x, y, least(1, greatest(0, ((x - 10) * 60 + (y - 20) * 30) / 4500)) AS t FROM (SELECT event_id, CAST(event_id % 97 AS DOUBLE) AS x, value AS y FROM events))")
def f_point_segment(spark, d):
    return table(spark, d, "events").select("event_id", F.round(G.point_segment((F.col("event_id") % 97).cast("double"), F.col("value"), (10.0, 20.0), (70.0, 50.0)), 6).alias("distance"))


@query("f_segments_intersect", "SELECT event_id, (o1 * o2 < 0 AND o3 * o4 < 0) AS crosses FROM (SELECT event_id, sign(60 * (y - 20) - 30 * (x - 10)) AS o1, sign(60 * (y + 5 - 20) - 30 * (x + 9 - 10)) AS o2, sign(9 * (20 - y) - 5 * (10 - x)) AS o3, sign(9 * (50 - y) - 5 * (70 - x)) AS o4 FROM (SELECT event_id, CAST(event_id % 97 AS DOUBLE) AS x, value AS y FROM events))")
def f_segments_intersect(spark, d):
    x, y = (F.col("event_id") % 97).cast("double"), F.col("value")
    return table(spark, d, "events").select("event_id", G.crosses((F.lit(10.0), F.lit(20.0)), (F.lit(70.0), F.lit(50.0)), (x, y), (x + 9, y + 5)).alias("crosses"))


# ---------------------------------------------------- documents, sinks ----
_SCANS = [e.id for e in PALETTE]


_CTE = f"WITH {O.PIXEL},\n{O.lab()},\n{O.owner_ctes(PALETTE)}"


@query("snk_report", f"{_CTE} SELECT owner, '{{\"owner\":\"' || owner || '\",\"pixels\":' || count(*) || ',\"rows\":' || count(DISTINCT y) || '}}' AS report FROM owned WHERE owner IS NOT NULL GROUP BY owner")
def snk_report(spark, d):
    stats = M.ownership(pixels(spark, d), PALETTE).where("owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("pixels"), F.count_distinct("y").alias("rows"))
    return stats.select("owner", F.to_json(F.struct("owner", "pixels", "rows")).alias("report"))


@query("srt_layer_order", f"{_CTE}, n AS (SELECT owner, count(*) AS c FROM owned WHERE owner IS NOT NULL GROUP BY owner), o AS (SELECT * FROM (VALUES ('sand', 0), ('blue', 1), ('red', 2)) AS t(owner, pos)) SELECT owner, CAST(row_number() OVER (ORDER BY coalesce(pos, 99), owner) AS BIGINT) AS place FROM n LEFT JOIN o USING (owner)")
def srt_layer_order(spark, d):
    """Layers by the order asked for, unknown ones last; there are at most 64 rows to rank."""
    order = spark.createDataFrame([("sand", 0), ("blue", 1), ("red", 2)], "owner string, pos int")
    n = M.ownership(pixels(spark, d), PALETTE).where("owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("c")).join(F.broadcast(order), "owner", "left")
    return n.select("owner", F.row_number().over(Window.orderBy(F.coalesce("pos", F.lit(99)), "owner")).cast("long").alias("place"))


# ------------------------------------------------------- settings, JSON ----
@query("d_merge_profiles", "SELECT p_partkey, k AS field, round(CASE WHEN k = 'b' AND p_size % 2 = 0 THEN p_size ELSE v END, 6) AS value FROM part, (VALUES ('a', 1.0), ('b', 2.0), ('c', 3.0)) AS t(k, v)")
def d_merge_profiles(spark, d):
    base = F.create_map([F.lit(x) for x in ("a", 1.0, "b", 2.0, "c", 3.0)])
    over = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("b"), F.col("p_size").cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    return table(spark, d, "part").select("p_partkey", F.explode(T.merge_maps(base, over)).alias("field", "value")).withColumn("value", F.round("value", 6))


@query("h_canonical_pair", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem")
def h_canonical_pair(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least("l_partkey", "l_suppkey").alias("low"), F.greatest("l_partkey", "l_suppkey").alias("high"))


@query("h_remap", f"WITH {O.PIXEL} SELECT pixel_id, CASE zone WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 0 END AS label FROM pixel")
def h_remap(spark, d):
    lookup = spark.createDataFrame([(0, 7), (1, 5)], "zone long, label int")
    return pixels(spark, d).join(F.broadcast(lookup), "zone", "left").select("pixel_id", F.coalesce("label", F.lit(0)).alias("label"))


# ------------------------------------------------------- small helpers ----
@query("prj_paint", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '#112233' WHEN p_size % 3 = 1 THEN '#445566' ELSE '#000000' END AS paint FROM part")
def prj_paint(spark, d):
    """The output colour, else the anchor, else black."""
    output = F.when(F.col("p_size") % 3 == 0, "#112233")
    anchor = F.when(F.col("p_size") % 3 <= 1, "#445566")
    return table(spark, d, "part").select("p_partkey", F.coalesce(output, anchor, F.lit("#000000")).alias("paint"))


@query("flt_mode_whitelist", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'F' END AS mode FROM orders")
def flt_mode_whitelist(spark, d):
    known = spark.createDataFrame([("F",), ("O",)], "mode string")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(F.broadcast(known), F.col("o_orderstatus") == F.col("mode"), "left").select("o_orderkey", F.coalesce("mode", F.lit("F")).alias("mode"))


@query("f_geom_prims", "SELECT event_id, round(sqrt(pow(x - 3, 2) + pow(y - 4, 2)), 6) AS distance, round(x + (3 - x) * 0.25, 6) AS lerp, round(x * 4 - y * 3, 6) AS cross_product, round(x * 3 + y * 4, 6) AS dot_product FROM (SELECT event_id, CAST(event_id % 97 AS DOUBLE) AS x, value AS y FROM events)")
def f_geom_prims(spark, d):
    x, y = (F.col("event_id") % 97).cast("double"), F.col("value")
    return table(spark, d, "events").select("event_id", F.round(G.distance(x, y, F.lit(3.0), F.lit(4.0)), 6).alias("distance"), F.round(x + (F.lit(3.0) - x) * 0.25, 6).alias("lerp"), F.round(x * 4 - y * 3, 6).alias("cross_product"), F.round(x * 3 + y * 4, 6).alias("dot_product"))


@query("agg_percentile95", f"WITH {_CHAIN}, r AS (SELECT chain, y, row_number() OVER (PARTITION BY chain ORDER BY y) AS k, count(*) OVER (PARTITION BY chain) AS n FROM chain) SELECT chain, y AS p95 FROM r WHERE k = CAST(ceil(0.95 * n) AS BIGINT)")
def agg_percentile95(spark, d):
    """Nearest rank, not interpolated; ranks come from a window, so no chain is gathered into a row."""
    ordered = Window.partitionBy("chain").orderBy("y")
    r = chain(spark, d).select("chain", "y", F.row_number().over(ordered).alias("k"), F.count("*").over(Window.partitionBy("chain")).alias("n"))
    return r.where(F.col("k") == F.ceil(F.col("n") * 0.95)).select("chain", F.col("y").alias("p95"))


#: Loops by part: whole circles, half ones, and ones that wobble a little or too much; every fifth has too few samples.
_SAMPLES = "CASE WHEN p_partkey % 5 = 0 THEN 14 ELSE 24 END AS m"
_POLAR = ("2 * pi() * (i % m) / m * CASE WHEN p_partkey % 4 = 1 THEN 0.5 ELSE 1 END AS t", "5 + p_partkey % 7 + CASE p_partkey % 4 WHEN 2 THEN 0.1 WHEN 3 THEN 0.9 ELSE 0 END * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS r")
_PLANE = ("p_partkey AS loop", "i", "p_size + r * cos(t) AS x", "10 + r * sin(t) AS y")
_GATES = """mean AS (SELECT loop, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM body GROUP BY loop HAVING count(*) + 1 >= 17),
c AS (SELECT body.*, mx, my, n, x - mx AS u, y - my AS v FROM body JOIN mean USING (loop)),
s AS (SELECT loop, mx, my, n, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*(u*u+v*v)) AS uz, sum(v*(u*u+v*v)) AS vz FROM c GROUP BY ALL),
f AS (SELECT loop, n, mx + 0.5 * (uz * vv - vz * uv) / (uu * vv - uv * uv) AS cx, my + 0.5 * (vz * uu - uz * uv) / (uu * vv - uv * uv) AS cy FROM s WHERE (uu * vv - uv * uv) / pow(uu + vv, 2) >= 1e-3),
a AS (SELECT body.*, cx, cy, n, atan2((x - cx) * (y1 - cy) - (y - cy) * (x1 - cx), (x - cx) * (x1 - cx) + (y - cy) * (y1 - cy)) / (2 * pi()) AS turn, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS far FROM body JOIN f USING (loop)),
g AS (SELECT loop, cx, cy, n, avg(far) AS radius FROM a GROUP BY ALL HAVING abs(sum(turn)) >= 0.95 AND sum(abs(turn)) <= 1.1 AND max(abs(turn)) <= 0.1),
w AS (SELECT loop, g.cx, g.cy, g.n, radius, abs(far - radius) AS wrong, row_number() OVER (PARTITION BY loop ORDER BY abs(far - radius)) - 1 AS k FROM a JOIN g USING (loop))
SELECT loop, round(any_value(cx), 4) AS cx, round(any_value(cy), 4) AS cy, round(any_value(radius), 4) AS radius FROM w GROUP BY loop HAVING max(CASE WHEN k = floor((n - 1) * 95 / 100.0) THEN wrong END) <= 0.225 AND max(CASE WHEN k = floor((n - 1) * 99 / 100.0) THEN wrong END) <= 0.45 AND max(wrong) <= 0.675"""


@query("g_circle", f"WITH m AS (SELECT p_partkey, p_size, {_SAMPLES} FROM part), i AS (SELECT *, unnest(range(m + 1)) AS i FROM m), p AS (SELECT *, {', '.join(_POLAR)} FROM i), loops AS (SELECT {', '.join(_PLANE)} FROM p), body AS (SELECT * FROM (SELECT *, lead(x) OVER (PARTITION BY loop ORDER BY i) AS x1, lead(y) OVER (PARTITION BY loop ORDER BY i) AS y1 FROM loops) WHERE x1 IS NOT NULL), " + _GATES)
def g_circle(spark, d):
    """Closed loops that are whole circles within 0.45 of a pixel; the others are refused."""
    samples = table(spark, d, "part").selectExpr("p_partkey", "p_size", _SAMPLES).selectExpr("*", "explode(sequence(0, m)) AS i")
    loops = samples.selectExpr("*", *_POLAR).selectExpr(*_PLANE)
    return G.fit_circles(loops, "loop", 0.45).select("loop", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("radius", 4).alias("radius"))


@query("h_path_valid", "SELECT p_partkey, p_size % 6 IN (0, 1) AS valid FROM part")
def h_path_valid(spark, d):
    """Paths that are whole, relative, blank, without a command, with a number that is not finite, and with a fill rule that is none."""
    n = F.col("p_size").cast("string")
    kinds = [F.concat(F.lit("M 1 "), n, F.lit(" Z")), F.concat(F.lit("m 1 "), n, F.lit(" l 2 3")), F.lit("  "), F.concat(F.lit("1 2 "), n), F.concat(F.lit("M 1 "), n, F.lit("e999 Z")), F.lit("M 0 0 Z")]
    text = F.element_at(F.array(*kinds), (F.col("p_size") % 6 + 1).cast("int"))
    rule = F.when(F.col("p_size") % 6 == 5, "winding").otherwise(F.when(F.col("p_partkey") % 2 == 0, "evenodd").otherwise("nonzero"))
    return table(spark, d, "part").select("p_partkey", T.path_valid(text, rule).alias("valid"))


@query("f_display_name", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN left('x' || o_orderpriority || 'é.png', 120) WHEN 1 THEN o_orderstatus || ' b.png' WHEN 2 THEN 'image' ELSE repeat('n', 120) END AS name FROM orders")
def f_display_name(spark, d):
    """Names with folders of both kinds, refused and control characters, spaces at the ends, nothing left, and too many characters."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("/tmp/a\\x"), "o_orderpriority", F.lit("é*?.png"))).when(k == 1, F.concat(F.lit("c:\\ "), "o_orderstatus", F.lit(" \u0007b.png  "))).when(k == 2, F.lit("dir/<>|")).otherwise(F.repeat(F.lit("n"), 130))
    return table(spark, d, "orders").select("o_orderkey", T.display_name(text).alias("name"))


@query("h_svg_shallow_check", "SELECT page_id, page_id % 6 IN (0, 1) AS ok FROM pages")
def h_svg_shallow_check(spark, d):
    """Pages' text between <svg> tags, trimmed or not, and with each of the faults; pages as they are never pass."""
    plain = F.regexp_replace(F.regexp_replace("html", "[<>]", ""), "(NaN|Infinity)", "")
    kinds = [F.concat(F.lit("<svg>"), plain, F.lit("</svg>")), F.concat(F.lit(" \n<svg>"), plain, F.lit("</svg>\n")), F.concat(F.lit("<svg>"), plain, F.lit("<</svg>")), F.concat(F.lit("<svg>-Infinity"), plain, F.lit("</svg>")), F.concat(F.lit("<svg><script>"), plain, F.lit("</svg>")), F.col("html")]
    return table(spark, d, "pages").select("page_id", T.svg_ok(F.element_at(F.array(*kinds), (F.col("page_id") % 6 + 1).cast("int"))).alias("ok"))


# ------------------------------------------------------------------ SVG ----
def scan_paths(spark, d):
    """(image_id, owner, path): for each scan one path of all it owns, a rectangle for each horizontal run, in raster order."""
    owned = M.ownership(pixels(spark, d), PALETTE).where("owner IS NOT NULL")
    row = Window.partitionBy("image_id", "owner", "y").orderBy("x")
    runs = owned.withColumn("g", F.col("x") - F.row_number().over(row)).groupBy("image_id", "owner", "y", "g").agg(F.min("x").alias("x0"), F.count("*").alias("n"))
    part = F.format_string("M %d %d h %d v 1 h -%d Z", "x0", "y", "n", "n")
    # an image's size is limited, so a scan of one image is a bounded group
    return runs.groupBy("image_id", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x0", part.alias("p")))), lambda v: v["p"]).alias("subpaths"))


_RUNS = f"{_CTE}, marked AS (SELECT image_id, owner, y, x, x - row_number() OVER (PARTITION BY image_id, owner, y ORDER BY x) AS g FROM owned WHERE owner IS NOT NULL), runs AS (SELECT image_id, owner, y, min(x) AS x0, count(*) AS n FROM marked GROUP BY image_id, owner, y, g)"
_PART = "'M ' || x0 || ' ' || y || ' h ' || n || ' v 1 h -' || n || ' Z'"
_PAINT = {e.id: e.hex for e in PALETTE}
_PLACE = {e.id: k for k, e in enumerate(PALETTE)}


def by_owner(values):
    out = F.when(F.lit(False), F.lit(next(iter(values.values()))))
    for k, v in values.items():
        out = out.when(F.col("owner") == k, v)
    return out


_PAINT_SQL = "CASE owner " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PAINT.items()) + " END"
_LABEL_SQL = "CASE owner " + " ".join(f"WHEN '{k}' THEN '{v + 1:02d}'" for k, v in _PLACE.items()) + " END"


@query("snk_svg_app", f"{_RUNS}, paths AS (SELECT image_id, owner, string_agg({_PART}, ' ' ORDER BY y, x0) AS path FROM runs GROUP BY ALL), shown AS (SELECT image_id, owner, {_PAINT_SQL} AS paint, {_LABEL_SQL} AS place, path FROM paths) SELECT image_id, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"100\" height=\"' || any_value(high) || '\" viewBox=\"0 0 100 ' || any_value(high) || '\"><g id=\"result-' || image_id || '\" pt:generated=\"true\" pt:source-image-uuid=\"' || image_id || '\" pt:schema-version=\"1\">' || string_agg('<g inkscape:label=\"' || place || ' ' || owner || ' — ' || paint || '\" pt:palette-entry-id=\"' || owner || '\" pt:role=\"primary_fill\"><path d=\"' || path || '\" style=\"fill:' || paint || ';fill-rule:evenodd;stroke:none\"/></g>', '' ORDER BY place) || '</g></svg>' AS svg FROM shown JOIN (SELECT image_id, max(y) + 1 AS high FROM pixel GROUP BY image_id) USING (image_id) GROUP BY image_id")
def snk_svg_app(spark, d):
    """The whole document of each image: a layer for each scan with one path, so that holes subtract, and where it came from."""
    attr = lambda n, v: F.concat(F.lit(f' {n}="'), T.escape_xml(v.cast("string")), F.lit('"'))
    paint, place = by_owner(_PAINT), by_owner({k: f"{v + 1:02d}" for k, v in _PLACE.items()})
    layer = F.concat(F.lit("<g"), attr("inkscape:label", F.concat(place, F.lit(" "), "owner", F.lit(" — "), paint)), attr("pt:palette-entry-id", F.col("owner")), attr("pt:role", F.lit("primary_fill")), F.lit("><path"), attr("d", F.array_join("subpaths", " ")), attr("style", F.concat(F.lit("fill:"), paint, F.lit(";fill-rule:evenodd;stroke:none"))), F.lit("/></g>"))
    layers = scan_paths(spark, d).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), layer.alias("g")))), lambda v: v["g"]), "").alias("layers"))
    size = frames(pixels(spark, d))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"'), attr("width", F.col("width")), attr("height", F.col("height")), attr("viewBox", F.concat(F.lit("0 0 "), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"))), F.lit("><g"), attr("id", F.concat(F.lit("result-"), F.col("image_id").cast("string"))), attr("pt:generated", F.lit("true")), attr("pt:source-image-uuid", F.col("image_id")), attr("pt:schema-version", F.lit(1)), F.lit(">"))
    return layers.join(size, "image_id").select("image_id", F.concat(head, "layers", F.lit("</g></svg>")).alias("svg"))


@query("snk_svg_inkscape", f"{_RUNS} SELECT image_id, owner, row_number() OVER (PARTITION BY image_id, owner ORDER BY y, x0) AS place, '<path d=\"' || {_PART} || '\" style=\"fill:' || {_PAINT_SQL} || ';fill-rule:evenodd;stroke:none\"/>' AS element FROM runs")
def snk_svg_inkscape(spark, d):
    """The elements put into an open document: one for each subpath, in order."""
    one = scan_paths(spark, d).select("image_id", "owner", F.posexplode("subpaths").alias("k", "p"))
    return one.select("image_id", "owner", (F.col("k") + 1).cast("long").alias("place"), F.concat(F.lit('<path d="'), "p", F.lit('" style="fill:'), by_owner(_PAINT), F.lit(';fill-rule:evenodd;stroke:none"/>')).alias("element"))


@query("agg_segments", f"{_RUNS} SELECT image_id, owner, CAST(count(*) * 3 AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS subpaths, CAST(count(*) * 4 AS BIGINT) AS points FROM runs GROUP BY ALL")
def agg_segments(spark, d):
    """Line segments, subpaths and points of each scan's path, counted in its commands."""
    each = scan_paths(spark, d).select("image_id", "owner", F.explode("subpaths").alias("p"))
    many = lambda letters: F.sum(F.regexp_count("p", F.lit(f"[{letters}]"))).cast("long")
    return each.groupBy("image_id", "owner").agg(many("hvHV").alias("lines"), many("Mm").alias("subpaths"), many("MmhvHV").alias("points"))


# ------------------------------------------------------------- uploads ----
# What is accepted, the largest upload, and the most pixels that are worked on.
ACCEPTED = ("image/png", "image/jpeg", "image/gif", "image/bmp", "image/tiff", "image/webp", "image/x-portable-pixmap", "image/x-portable-graymap")
MOST_BYTES, MOST_PIXELS = 32 * 1024 * 1024, 4_000_000
_HEADS = ((b"\x89PNG\r\n\x1a\n00", "image/png"), (b"\xff\xd8\xff\xe000", "image/jpeg"), (b"GIF89a00", "image/gif"), (b"RIFF0000WEBP", "image/webp"), (b"hello", None), (b"P5 1 1 25", "image/x-portable-graymap"))
_SNIFFED = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(_HEADS) if v) + " END"
_DECLARED = "CASE p_size % 3 WHEN 0 THEN 'image/bmp' WHEN 1 THEN 'text/html' ELSE '' END"


@query("src_upload", f"WITH u AS (SELECT p_partkey, coalesce({_SNIFFED}, {_DECLARED}) AS kind, p_size * 1000000 AS n_bytes, p_size * 100 AS w, p_partkey % 1000 * 9 + 1 AS h FROM part), s AS (SELECT *, sqrt(4000000.0 / (w * h)) AS k FROM u) SELECT p_partkey, CASE WHEN kind NOT IN {ACCEPTED} THEN 'refused: kind' WHEN n_bytes > 33554432 THEN 'refused: size' ELSE kind END AS verdict, CAST(CASE WHEN w * h > 4000000 THEN greatest(1, floor(w * k)) ELSE w END AS BIGINT) AS width, CAST(CASE WHEN w * h > 4000000 THEN greatest(1, floor(h * k)) ELSE h END AS BIGINT) AS height FROM s")
def src_upload(spark, d):
    """What an upload is (its first bytes beat what it was declared as), whether it is taken, and the size it is worked on at."""
    head = F.element_at(F.array(*[F.lit(h) for h, _ in _HEADS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    declared = F.when(F.col("p_size") % 3 == 0, " Image/BMP; q=1").when(F.col("p_size") % 3 == 1, "text/html").otherwise("")
    up = table(spark, d, "part").select("p_partkey", F.coalesce(sniff(head), T.mime_type(declared)).alias("kind"), (F.col("p_size").cast("long") * 1_000_000).alias("n_bytes"), (F.col("p_size").cast("long") * 100).alias("w"), (F.col("p_partkey") % 1000 * 9 + 1).alias("h"))
    verdict = F.when(~F.col("kind").isin(*ACCEPTED), "refused: kind").when(F.col("n_bytes") > MOST_BYTES, "refused: size").otherwise(F.col("kind"))
    width, height = T.working_size(F.col("w"), F.col("h"), MOST_PIXELS)
    return up.select("p_partkey", verdict.alias("verdict"), width.alias("width"), height.alias("height"))


@query("prj_effective_scale", "WITH s AS (SELECT p_partkey, p_size * 100 AS w, p_partkey % 1000 * 9 + 1 AS h FROM part), t AS (SELECT *, sqrt(1000000.0 / (w * h)) AS k FROM s) SELECT p_partkey, round(CASE WHEN w * h > 1000000 THEN sqrt(greatest(1, floor(w * k)) * greatest(1, floor(h * k)) / (w * h)) ELSE 1 END, 6) AS scale FROM t")
def prj_effective_scale(spark, d):
    """The factor that a preview really has, once its size is whole pixels."""
    w, h = F.col("p_size").cast("long") * 100, F.col("p_partkey") % 1000 * 9 + 1
    width, height = T.working_size(w, h, T.PREVIEW_PIXELS)
    return table(spark, d, "part").select("p_partkey", F.round(F.sqrt(width * height / (w * h)), 6).alias("scale"))


_SHOWN = "regexp_replace(regexp_replace(printf('%.3f', CAST({0} AS DOUBLE)), '0+$', ''), '\\.$', '')"


@query("f_scale_path", "SELECT p_partkey, 'M ' || " + _SHOWN.format("p_size * 0.375") + " || ' ' || " + _SHOWN.format("-p_partkey * 0.375") + " || ' A ' || " + _SHOWN.format("2.5 * 0.375") + " || ' ' || " + _SHOWN.format("p_size * 0.375") + " || ' 30 0 1 ' || " + _SHOWN.format("p_size * 0.375") + " || ' 0 Z' AS path FROM part")
def f_scale_path(spark, d):
    size = F.col("p_size").cast("string")
    path = F.concat(F.lit("M"), size, F.lit(",-"), F.col("p_partkey").cast("string"), F.lit(" A 2.5 "), size, F.lit(" 30 0 1 "), size, F.lit(" 0 Z"))
    return table(spark, d, "part").select("p_partkey", T.scale_path(path, F.lit(0.375)).alias("path"))


@query("f_parse_hex", "WITH h AS (SELECT p_partkey, printf('%X', p_partkey % 16) AS a, printf('%02X', p_partkey % 256) AS b FROM part) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '#' || a || a || '0077FF' WHEN 1 THEN '#' || a || a || '007788' WHEN 2 THEN '#' || b || '1234FF' WHEN 3 THEN '#' || b || '123456' END AS hex FROM h")
def f_parse_hex(spark, d):
    """Colours of three, four, six, eight and five digits, the last refused."""
    one, two = F.lower(F.hex(F.col("p_partkey") % 16)), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0")
    kinds = [F.concat(F.lit("#"), one, F.lit("07")), F.concat(F.lit("#"), one, F.lit("078")), F.concat(F.lit("#"), two, F.lit("1234")), F.concat(F.lit("#"), two, F.lit("123456")), F.concat(F.lit("#"), two, F.lit("123"))]
    return table(spark, d, "part").select("p_partkey", T.parse_hex(F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("hex"))


@query("f_export_name", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pic' || o_custkey WHEN 1 THEN 'a.b' || o_custkey WHEN 2 THEN 'plain' ELSE 'palette-trace' END || '.palette-trace.svg' AS name FROM orders")
def f_export_name(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("pic"), c, F.lit(".png"))).when(k == 1, F.concat(F.lit("a.b"), c, F.lit(".jpeg"))).when(k == 2, "plain").otherwise(F.when(F.col("o_custkey") % 2 == 0, ".png").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", T.export_name(text).alias("name"))


@query("f_island_summary", "SELECT p_partkey, CASE WHEN h + l = 0 THEN '' WHEN h + l = 1 THEN 'One patch of the backdrop colour sits in the foreground — ' || CASE WHEN h = 1 THEN 'it became a hole.' ELSE 'it got a layer of its own.' END ELSE (h + l) || ' patches of the backdrop colour sit in the foreground — ' || CASE WHEN h > 0 AND l > 0 THEN CASE WHEN h = 1 THEN '1 became a hole, ' ELSE h || ' became holes, ' END || CASE WHEN l = 1 THEN '1 got a layer of its own.' ELSE l || ' got layers of their own.' END WHEN h > 0 THEN 'they became holes.' ELSE 'they got layers of their own.' END END AS text FROM (SELECT p_partkey, p_partkey % 3 AS h, p_partkey // 3 % 3 AS l FROM part)")
def f_island_summary(spark, d):
    return table(spark, d, "part").select("p_partkey", T.island_summary(F.col("p_partkey") % 3, F.expr("p_partkey div 3 % 3")).alias("text"))


_COVER = "CASE WHEN o <= -(a + b) / 2 THEN 0 WHEN o >= (a + b) / 2 THEN 1 WHEN o <= -(a - b) / 2 THEN pow(o + (a + b) / 2, 2) / (2 * a * b) WHEN o >= (a - b) / 2 THEN 1 - pow((a + b) / 2 - o, 2) / (2 * a * b) ELSE 0.5 + o / a END"


@query("f_coverage_offset", f"WITH n AS (SELECT event_id, event_id % 13 - 6.0 AS nx, event_id % 7 + 1.0 AS ny, event_id % 41 / 20.0 - 1 AS o FROM events), q AS (SELECT *, greatest(abs(nx), ny) / sqrt(nx * nx + ny * ny) AS a, least(abs(nx), ny) / sqrt(nx * nx + ny * ny) AS b FROM n), c AS (SELECT *, {_COVER} AS cover FROM q) SELECT event_id, round(cover, 6) AS coverage, round(greatest(-(a + b) / 2, least((a + b) / 2, o)), 5) AS back FROM c WHERE b > 0")
def f_coverage_offset(spark, d):
    """The share of a unit square on one side of a line at an offset, and the offset that this share stands for."""
    nx, ny, o = F.col("event_id") % 13 - 6.0, F.col("event_id") % 7 + 1.0, F.col("event_id") % 41 / 20.0 - 1
    a, b = G.octant(nx, ny)
    cover = G.coverage_for_offset(o, a, b)
    return table(spark, d, "events").where("event_id % 13 <> 6").select("event_id", F.round(cover, 6).alias("coverage"), F.round(G.offset_for_coverage(cover, a, b), 5).alias("back"))


_CURVE = "SELECT event_id, CAST(event_id % 11 AS DOUBLE) AS x1, value / 10 AS y1, 7.0 - event_id % 5 AS x2, -value / 20 AS y2 FROM events"


@query("f_cubic_bound", f"WITH c AS ({_CURVE}), b AS (SELECT event_id, greatest(sqrt(pow(x1 - 3, 2) + pow(y1 - 1, 2)), sqrt(pow(x2 - 6, 2) + pow(y2 - 2, 2))) AS bound FROM c) SELECT event_id, round(bound, 6) AS bound, CAST(CASE WHEN bound <= 0.1 THEN 0 ELSE ceil(log2(bound / 0.1) / 2) END AS BIGINT) AS depth FROM b")
def f_cubic_bound(spark, d):
    """How far cubics from (0, 0) to (9, 3) may stray from their chord, and how often to halve them to stay within 0.1."""
    c = table(spark, d, "events").select("event_id", (F.col("event_id") % 11).cast("double").alias("x1"), (F.col("value") / 10).alias("y1"), (F.lit(7.0) - F.col("event_id") % 5).alias("x2"), (-F.col("value") / 20).alias("y2"))
    bound = G.chord_bound((F.lit(0.0), F.lit(0.0)), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.lit(9.0), F.lit(3.0)))
    return c.select("event_id", F.round(bound, 6).alias("bound"), G.flatten_depth(bound, 0.1).cast("long").alias("depth"))


@query("f_cubic_flatten", f"WITH c AS ({_CURVE}), s AS (SELECT c.*, unnest(range(9)) AS i FROM c) SELECT event_id, i, round(3 * pow(1 - i / 8.0, 2) * i / 8.0 * x1 + 3 * (1 - i / 8.0) * pow(i / 8.0, 2) * x2 + pow(i / 8.0, 3) * 9 + 1e-7, 6) AS x, round(3 * pow(1 - i / 8.0, 2) * i / 8.0 * y1 + 3 * (1 - i / 8.0) * pow(i / 8.0, 2) * y2 + pow(i / 8.0, 3) * 3 + 1e-7, 6) AS y FROM s")
def f_cubic_flatten(spark, d):
    """Every curve at eight equal steps of its parameter; the ends are its own points."""
    c = table(spark, d, "events").select("event_id", (F.col("event_id") % 11).cast("double").alias("x1"), (F.col("value") / 10).alias("y1"), (F.lit(7.0) - F.col("event_id") % 5).alias("x2"), (-F.col("value") / 20).alias("y2"))
    points = G.flatten((F.lit(0.0), F.lit(0.0)), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.lit(9.0), F.lit(3.0)), F.lit(3))
    return c.select("event_id", F.posexplode(points).alias("i", "p")).select("event_id", F.col("i").cast("long").alias("i"), F.round(F.col("p.x") + 1e-7, 6).alias("x"), F.round(F.col("p.y") + 1e-7, 6).alias("y"))


@query("f_cubic_turning")
def f_cubic_turning(spark, d):
    """Total turning of each curve over sixteen samples of its slope."""
    c = table(spark, d, "events").select("event_id", (F.col("event_id") % 11).cast("double").alias("x1"), (F.col("value") / 10).alias("y1"), (F.lit(7.0) - F.col("event_id") % 5).alias("x2"), (-F.col("value") / 20).alias("y2"))
    return c.select("event_id", F.round(G.turning((F.lit(0.0), F.lit(0.0)), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.lit(9.0), F.lit(3.0)), 16), 6).alias("turning"))


_LINE = ((0.0, 0.0), (40.0, 30.0), (80.0, 10.0), (96.0, 90.0))


def _gap_sql(a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"least(1, greatest(0, ((x - {a[0]}) * {dx} + (y - {a[1]}) * {dy}) / {dx * dx + dy * dy}))"
    return f"sqrt(pow(x - ({a[0]} + {t} * {dx}), 2) + pow(y - ({a[1]} + {t} * {dy}), 2))"


@query("f_point_polyline", "SELECT event_id, round(least(" + ", ".join(_gap_sql(a, b) for a, b in zip(_LINE, _LINE[1:])) + "), 6) AS distance FROM (SELECT event_id, CAST(event_id % 97 AS DOUBLE) AS x, value AS y FROM events)")
def f_point_polyline(spark, d):
    """The distance from a polyline: the least over its segments."""
    x, y = (F.col("event_id") % 97).cast("double"), F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.least(*[G.point_segment(x, y, a, b) for a, b in zip(_LINE, _LINE[1:], strict=False)]), 6).alias("distance"))


# ------------------------------------------------- sources and limits ----
_P6 = "printf('%02X%02X%02X', p_size, p_partkey % 256, 7)"


@query("src_netpbm", "SELECT p_partkey, i AS x, CAST(0 AS BIGINT) AS y, CAST(CASE i WHEN 0 THEN p_size ELSE 255 END AS BIGINT) AS r, CAST(CASE i WHEN 0 THEN p_partkey % 256 ELSE 254 END AS BIGINT) AS g, CAST(CASE i WHEN 0 THEN 7 ELSE 253 END AS BIGINT) AS b, CAST(CASE WHEN p_partkey % 3 = 1 THEN 9 ELSE 255 END AS BIGINT) AS a FROM part, range(2) AS t(i) WHERE p_partkey % 3 < 2")
def src_netpbm(spark, d):
    """Two pixels of a P6 or a P7 file for each part; every third file has another format and is refused."""
    from tessera.sources.raster import decoded

    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    first = F.concat(byte(F.col("p_size")), byte(F.col("p_partkey") % 256), F.lit("07"))
    head = lambda t: F.hex(F.encode(F.lit(t), "US-ASCII"))
    plain = F.concat(head("P6\n# made here\n2 1\n255\n"), first, F.lit("FFFEFD"))
    clear = F.concat(head("P7\nWIDTH 2\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n"), first, F.lit("09FFFEFD09"))
    kind = F.col("p_partkey") % 3
    files = table(spark, d, "part").select("p_partkey", F.unhex(F.when(kind == 0, plain).when(kind == 1, clear).otherwise(head("P5 2 1 255 xx"))).alias("content"))
    return decoded(files, "p_partkey").select("p_partkey", "x", "y", "r", "g", "b", "a")


@query("src_raw_pixels", "SELECT p_partkey, x, y, CASE p_partkey % 3 WHEN 0 THEN 10 * y + x ELSE (p_size + 3 * x + 20 * y) % 256 END AS r, CASE p_partkey % 3 WHEN 0 THEN 10 * y + x ELSE (p_size + 1 + 3 * x + 20 * y) % 256 END AS g, CASE p_partkey % 3 WHEN 0 THEN 255 WHEN 1 THEN 255 ELSE (p_size + 9) % 256 END AS a FROM part, (SELECT * FROM range(2) AS t(x), range(2) AS u(y)) ORDER BY ALL")
def src_raw_pixels(spark, d):
    """Rows of grey, RGB and RGBA bytes with a stride of twenty, unpacked by arithmetic on the bytes."""
    byte = lambda c: F.lpad(F.hex(c.cast("long") % 256), 2, "0")
    kind, size = F.col("p_partkey") % 3, F.col("p_size")

    def line(y: int):
        grey = [F.lit(10 * y + k) for k in range(2)]
        rgb = [size + k + 20 * y for k in range(6)]
        rgba = [v for x in range(2) for v in (size + 3 * x + 20 * y, size + 1 + 3 * x + 20 * y, F.lit(0), size + 9)]
        return F.when(kind == 0, F.concat(*map(byte, grey))).when(kind == 1, F.concat(*map(byte, rgb))).otherwise(F.concat(*map(byte, rgba)))

    image = table(spark, d, "part").select("p_partkey", F.concat(F.rpad(line(0), 40, "0"), line(1)).alias("raw"), F.when(kind == 0, 1).when(kind == 1, 3).otherwise(4).alias("depth"))
    cell = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for y in range(2) for x in range(2)])
    px = image.select("p_partkey", "raw", "depth", F.explode(cell).alias("c")).select("p_partkey", "raw", "depth", "c.*")
    channel = lambda k: F.conv(F.substr("raw", ((F.col("y") * 20 + F.col("x") * F.col("depth") + k) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    grey = F.col("depth") == 1
    return px.select("p_partkey", "x", "y", channel(F.lit(0)).alias("r"), F.when(grey, channel(F.lit(0))).otherwise(channel(F.lit(1))).alias("g"), F.when(F.col("depth") == 4, channel(F.lit(3))).otherwise(F.lit(255)).alias("a"))


# The suffixes that the command line opens.
SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "ppm", "pgm")


@query("src_standalone", "SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS opened FROM orders")
def src_standalone(spark, d):
    """Whether a path's suffix is one that is opened, in whatever case."""
    name = F.element_at(F.array(*map(F.lit, ("a.PNG", "dir.x/b.tiff", "c.svg", "d", "e.png.txt"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.opened(name, SUFFIXES).alias("opened"))


@query("src_linked", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'data' WHEN 1 THEN '/abs/p.png' WHEN 2 THEN '/docs/img/p.png' WHEN 3 THEN 'refused: remote' WHEN 4 THEN 'refused: missing' ELSE 'refused: unsaved' END AS target FROM orders")
def src_linked(spark, d):
    """Where an image link of a document leads: embedded data, an absolute path, one beside the document; remote, missing and unsaved ones are refused."""
    k = (F.col("o_orderkey") % 6 + 1).cast("int")
    href = F.element_at(F.array(*[F.lit(v).cast("string") for v in ("data:image/png;base64,AA", "file:///abs/p.png", "img/p.png", "HTTPS://x/p.png", "", "img/p.png")]), k)
    folder = F.when(k == 6, F.lit(None).cast("string")).otherwise("/docs")
    return table(spark, d, "orders").select("o_orderkey", T.linked(href, folder).alias("target"))


@query("src_json_static", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[0]}', {v[1]}, {v[2]}, '{v[5]}')" for k, v in __import__("tessera.operators.documents", fromlist=["DESTINATIONS"]).DESTINATIONS.items()) + ") AS t(destination, policy, underlap, trapping, profile)")
def src_json_static(spark, d):
    """The table of destinations, read through JSON text."""
    import json

    from tessera.operators.documents import DESTINATIONS

    text = json.dumps([{"destination": k, "policy": v[0], "underlap": v[1], "trapping": v[2], "profile": v[5]} for k, v in DESTINATIONS.items()])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<destination: string, policy: string, underlap: double, trapping: double, profile: string>>")).alias("d"))
    return rows.select("d.*")


@query("lim_resources", f"WITH {O.PIXEL}, n AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, count(*) AS n, count(DISTINCT zone * 16 + noise) AS regions FROM pixel GROUP BY image_id) SELECT image_id, CASE WHEN w > 4096 THEN 'width' WHEN h > 30 THEN 'height' WHEN n > 3500 THEN 'pixels' WHEN regions > 30 THEN 'regions' ELSE 'ok' END AS verdict FROM n")
def lim_resources(spark, d):
    """The first limit that an image exceeds: counted before any work, one row for an image."""
    px = pixels(spark, d)
    n = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("pixels"), F.count_distinct(F.col("zone") * 16 + F.col("noise")).alias("regions"))
    out = F.lit("ok")
    for name, most in (("regions", 30), ("pixels", 3500), ("height", 30), ("width", 4096)):
        out = F.when(F.col(name) > most, name).otherwise(out)
    return n.select("image_id", out.alias("verdict"))


# --------------------------------------------------------- along chains ----
@query("win_hysteresis", f"WITH {_CHAIN}, m AS (SELECT *, y >= 40 AS warm, row_number() OVER (PARTITION BY chain ORDER BY i) - row_number() OVER (PARTITION BY chain, y >= 40 ORDER BY i) AS g FROM chain), r AS (SELECT chain, g, max(y) AS top FROM m WHERE warm GROUP BY chain, g HAVING max(y) >= 70) SELECT m.chain, CAST(min(m.i) AS BIGINT) AS i, any_value(top) AS strength FROM m JOIN r ON r.chain = m.chain AND r.g = m.g AND m.warm AND m.y = r.top GROUP BY m.chain, m.g")
def win_hysteresis(spark, d):
    """Runs of samples that reach 70 and stay at 40 or above: the strongest of each, the first on ties."""
    return G.hysteresis(chain(spark, d), "chain", "y", 70.0, 40.0)


@query("win_corner_multiscale")
def win_corner_multiscale(spark, d):
    """The least turning angle of each sample over arc lengths of 2, 4 and 8, where at least two of them fit on the chain."""
    return G.corners(chain(spark, d), "chain", (2.0, 4.0, 8.0)).select("chain", "i", "scales", F.round("turn", 6).alias("turn"))


@query("srt_canonical_palette", f"WITH {O.PIXEL},\n{O.lab(half='engine')}, c AS (SELECT zone, avg(l) AS l, avg(ok_a) AS oa, avg(ok_b) AS ob FROM lab GROUP BY zone) SELECT zone, row_number() OVER (ORDER BY floor(l * 1e9 + 0.5), floor(oa * 1e9 + 0.5), floor(ob * 1e9 + 0.5)) AS place FROM c")
def srt_canonical_palette(spark, d):
    """Centres in an order that only their quantised colours decide; a palette has at most 64 rows."""
    from tessera.functions import color as C

    l, a, b = C.oklab(*(C.unit(x) for x in "rgb"), "engine")
    c = pixels(spark, d).withColumns({"l": l, "oa": a, "ob": b}).groupBy("zone").agg(F.avg("l").alias("l"), F.avg("oa").alias("oa"), F.avg("ob").alias("ob"))
    return c.select("zone", F.row_number().over(Window.orderBy(*[C.quant_key(F.col(n)) for n in ("l", "oa", "ob")])).cast("long").alias("place"))


@query("f_sample_premul", f"WITH {O.PIXEL}, m AS (SELECT *, a / 255.0 AS al, CASE zone WHEN 0 THEN 'opaque' WHEN 1 THEN 'premultiplied' ELSE 'straight' END AS mode, CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END AS lin FROM pixel) SELECT pixel_id, round(CASE mode WHEN 'opaque' THEN lin WHEN 'premultiplied' THEN CASE WHEN al = 0 THEN 0 ELSE lin END ELSE lin * al END, 6) AS red, round(CASE mode WHEN 'opaque' THEN 1 ELSE al END, 6) AS alpha FROM m")
def f_sample_premul(spark, d):
    """Premultiplied linear samples of images whose alpha is to be ignored, already applied, or still to be."""
    from tessera.functions import color as C

    mode = F.when(F.col("zone") == 0, "opaque").when(F.col("zone") == 1, "premultiplied").otherwise("straight")
    alpha, red = C.unit("a"), C.to_linear(C.unit("r"))
    shown = F.when(mode == "opaque", red).when(mode == "premultiplied", F.when(alpha == 0, 0.0).otherwise(red)).otherwise(red * alpha)
    return pixels(spark, d).select("pixel_id", F.round(shown, 6).alias("red"), F.round(F.when(mode == "opaque", 1.0).otherwise(alpha), 6).alias("alpha"))
