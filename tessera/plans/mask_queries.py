"""Masks, components and policies over the derived picture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import masks as K
from tessera.operators import tracing as V
from tessera.operators.lineage import written
from tessera.plans import oracle as O
from tessera.plans.registry import query
from tessera.sources.raster import pixels

CTE = f"WITH RECURSIVE {O.PIXEL},\n{O.FRAME}"
MASK = "mask AS (SELECT image_id, x, y FROM pixel WHERE zone = 1 AND noise <> 4)"
OTHER = "other AS (SELECT image_id, x, y FROM pixel WHERE zone IN (0, 1))"


def mask(px):
    return px.where("zone = 1 AND noise <> 4").select(*K.AT)


def other(px):
    return px.where("zone IN (0, 1)").select(*K.AT)


def dilate_sql(source: str, radius: float, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT s.image_id, x + dx AS x, y + dy AS y FROM {source} s JOIN frame USING (image_id), {O.disc_values(radius)} WHERE x + dx BETWEEN 0 AND w - 1 AND y + dy BETWEEN 0 AND high - 1)"


def erode_sql(source: str, radius: float, name: str) -> str:
    return f"{name}_out AS (SELECT image_id, x, y FROM pixel EXCEPT SELECT image_id, x, y FROM {source}),\n{dilate_sql(f'{name}_out', radius, f'{name}_grown')},\n{name} AS (SELECT image_id, x, y FROM {source} EXCEPT SELECT image_id, x, y FROM {name}_grown)"


THIN = f"{erode_sql('mask', 1, 'er')},\n{dilate_sql('er', 1, 'op')},\nthin AS (SELECT image_id, x, y FROM mask EXCEPT SELECT image_id, x, y FROM op)"


@query("prj_mask", f"{CTE}, {MASK} SELECT image_id, x, y FROM mask")
def prj_mask(spark, d):
    return mask(pixels(spark, d))


@query("win_dilate", f"{CTE}, {MASK}, {dilate_sql('mask', 2, 'grown')} SELECT image_id, x, y FROM grown")
def win_dilate(spark, d):
    px = pixels(spark, d)
    return K.dilate(mask(px), 2, px)


@query("win_erode", f"{CTE}, {MASK}, {erode_sql('mask', 1, 'shrunk')} SELECT image_id, x, y FROM shrunk")
def win_erode(spark, d):
    px = pixels(spark, d)
    return K.erode(mask(px), 1, px)


@query("win_offset", f"{CTE}, {OTHER}, {erode_sql('other', 1.5, 'shrunk')} SELECT image_id, x, y FROM shrunk")
def win_offset(spark, d):
    px = pixels(spark, d)
    return K.offset(other(px), -1.5, px)


@query("win_opening_residue", f"{CTE}, {MASK}, {THIN} SELECT image_id, x, y FROM thin")
def win_opening_residue(spark, d):
    px = pixels(spark, d)
    return K.thin(mask(px), 2, px)


@query("win_restore_thin", f"{CTE}, {MASK}, {THIN}, cleaned AS (SELECT image_id, x, y FROM mask WHERE (x + y) % 3 <> 0) SELECT image_id, x, y FROM cleaned UNION SELECT image_id, x, y FROM (SELECT image_id, x, y FROM mask EXCEPT SELECT image_id, x, y FROM cleaned) AS lost SEMI JOIN thin USING (image_id, x, y)")
def win_restore_thin(spark, d):
    px = pixels(spark, d)
    return K.restore_thin(mask(px), mask(px).where("(x + y) % 3 <> 0"), 2, px)


@query("set_intersect", f"{CTE}, {MASK}, {OTHER} SELECT image_id, x, y FROM mask INTERSECT SELECT image_id, x, y FROM other")
def set_intersect(spark, d):
    px = pixels(spark, d)
    return mask(px).join(other(px), K.AT, "left_semi")


@query("set_except", f"{CTE}, {MASK}, {OTHER} SELECT image_id, x, y FROM other EXCEPT SELECT image_id, x, y FROM mask")
def set_except(spark, d):
    px = pixels(spark, d)
    return other(px).join(mask(px), K.AT, "left_anti")


@query("set_union", f"{CTE}, {MASK}, {OTHER} SELECT image_id, x, y FROM mask UNION SELECT image_id, x, y FROM other")
def set_union(spark, d):
    px = pixels(spark, d)
    return mask(px).union(other(px)).distinct()


_UNDERLAP = f"{CTE}, {MASK}, {OTHER}, {dilate_sql('mask', 1.5, 'grown')} SELECT image_id, x, y FROM grown INTERSECT SELECT image_id, x, y FROM other"


@query("set_trapping", f"{CTE}, {MASK}, {dilate_sql('mask', 1.5, 'grown')} SELECT image_id, x, y FROM grown")
def set_trapping(spark, d):
    """Trapped beyond the outer silhouette as well."""
    px = pixels(spark, d)
    return K.underlap(mask(px), other(px), 1.5, px, False)


@query("set_underlap", _UNDERLAP)
def set_underlap(spark, d):
    px = pixels(spark, d)
    return K.underlap(mask(px), other(px), 1.5, px)


_LAYERS = f"layers AS (SELECT image_id, x, y, 'low' AS entry, 0 AS layer FROM other UNION ALL SELECT image_id, x, y, 'mid', 1 FROM mask UNION ALL SELECT image_id, x, y, 'top', 2 FROM pixel WHERE zone = 2 AND noise < 6 OR zone = 1 AND noise < 2)"


def layers(px):
    tagged = lambda m, e, k: m.select(*K.AT, F.lit(e).alias("entry"), F.lit(k).alias("layer"))
    return tagged(other(px), "low", 0).union(tagged(mask(px), "mid", 1)).union(tagged(px.where("zone = 2 AND noise < 6 OR zone = 1 AND noise < 2"), "top", 2))


@query("set_exclusive", f"{CTE}, {MASK}, {OTHER}, {_LAYERS} SELECT image_id, x, y, arg_max(entry, layer) AS entry FROM layers GROUP BY image_id, x, y")
def set_exclusive(spark, d):
    return K.exclusive(layers(pixels(spark, d)))


@query("set_validate", f"{CTE}, {MASK}, {OTHER}, {_LAYERS}, many AS (SELECT * FROM layers UNION ALL SELECT image_id, x, y, 'copy', 3 FROM mask UNION ALL SELECT image_id, x, y, 'tiny', 4 FROM mask WHERE x = 13 AND y = 1), area AS (SELECT e.entry, count(l.x) AS n FROM (VALUES ('low'), ('mid'), ('top'), ('none'), ('copy'), ('tiny')) AS e(entry) LEFT JOIN many l USING (entry) GROUP BY e.entry) SELECT entry, 'empty_operation' AS code FROM area WHERE n = 0 UNION ALL SELECT entry, 'operation_below_minimum_area' FROM area WHERE n BETWEEN 1 AND 3 UNION ALL SELECT 'mid', 'duplicate_operation' FROM area WHERE entry = 'mid' AND n > 0")
def set_validate(spark, d):
    """Layers that are empty, too small, or the same as an earlier one by name: equal order-free digests, so masks are never compared pairwise."""
    px = pixels(spark, d)
    m = mask(px)
    more = m.select(*K.AT, F.lit("copy").alias("entry"), F.lit(3).alias("layer")).union(m.where("x = 13 AND y = 1").select(*K.AT, F.lit("tiny").alias("entry"), F.lit(4).alias("layer")))
    names = spark.createDataFrame([(e,) for e in ("low", "mid", "top", "none", "copy", "tiny")], "entry string")
    mark = [F.sum(F.pmod(F.xxhash64(*K.AT, F.lit(k)), F.lit(1 << 40))) for k in (1, 2)]
    area = written(names.join(layers(px).union(more).groupBy("entry").agg(F.count("*").alias("n"), mark[0].alias("s"), mark[1].alias("t")), "entry", "left").withColumn("n", F.coalesce("n", F.lit(0))), "areas")
    small = area.where("n < 4").select("entry", F.when(F.col("n") == 0, "empty_operation").otherwise("operation_below_minimum_area").alias("code"))
    first = area.where("n > 0").groupBy("n", "s", "t").agg(F.min("entry").alias("first"))
    twice = area.where("n > 0").join(first, ["n", "s", "t"]).where("entry <> first").select("entry", F.lit("duplicate_operation").alias("code"))
    return small.union(twice)


@query("agg_distinct_pairs", f"{CTE}, {OTHER}, copies AS (SELECT image_id, x, y, 'a' AS entry FROM other UNION ALL SELECT image_id, x, y, 'b' FROM other UNION ALL SELECT image_id, x, y, 'c' FROM other WHERE x > 0), n AS (SELECT entry, count(*) AS c FROM copies GROUP BY entry), shared AS (SELECT p.entry AS first, q.entry AS second, count(*) AS c FROM copies p JOIN copies q ON p.image_id = q.image_id AND p.x = q.x AND p.y = q.y AND p.entry < q.entry GROUP BY ALL) SELECT first, second FROM shared JOIN n a ON a.entry = first JOIN n b ON b.entry = second WHERE shared.c = a.c AND a.c = b.c")
def agg_distinct_pairs(spark, d):
    """Operations on the same pixels: equal order-free digests (count and two sums of hashes), so masks are never compared pairwise."""
    o = other(pixels(spark, d))
    copies = o.withColumn("entry", F.lit("a")).union(o.withColumn("entry", F.lit("b"))).union(o.where("x > 0").withColumn("entry", F.lit("c")))
    mark = [F.sum(F.pmod(F.xxhash64("image_id", "x", "y", F.lit(k)), F.lit(1 << 40))) for k in (1, 2)]
    digest = copies.groupBy("entry").agg(F.count("*").alias("n"), mark[0].alias("s"), mark[1].alias("t"))
    return digest.alias("p").join(digest.alias("q"), ["n", "s", "t"]).where("p.entry < q.entry").select(F.col("p.entry").alias("first"), F.col("q.entry").alias("second"))


# ------------------------------------------------------------ components ----
_COMP = f"{CTE}, {MASK}, {O.reachable('mask')}"
_SIZES = "sizes AS (SELECT image_id, component, count(*) AS area, bool_or(x = 0 OR y = 0 OR x = 99 OR y = high - 1) AS touches FROM comp JOIN frame USING (image_id) GROUP BY image_id, component)"


@query("g_components", f"{_COMP} SELECT image_id, x, y, component FROM comp")
def g_components(spark, d):
    return K.components(mask(px := pixels(spark, d)), px).select(*K.AT, "component")


@query("agg_component_sizes", f"{_COMP}, {_SIZES} SELECT image_id, component, CAST(area AS BIGINT) AS area, touches AS touches_frame FROM sizes")
def agg_component_sizes(spark, d):
    px = pixels(spark, d)
    return K.sizes(K.components(mask(px), px), px)


@query("g_speckle", f"{_COMP}, {_SIZES} SELECT image_id, x, y FROM comp JOIN sizes USING (image_id, component) WHERE area >= 40")
def g_speckle(spark, d):
    px = pixels(spark, d)
    return K.remove_speckles(mask(px), 40, px)


@query("g_holes", f"{CTE}, {MASK}, outside AS (SELECT image_id, x, y FROM pixel WHERE zone = 1 AND noise = 4), gaps AS (SELECT image_id, x, y FROM pixel EXCEPT SELECT image_id, x, y FROM (SELECT image_id, x, y FROM mask UNION ALL SELECT image_id, x, y FROM pixel WHERE zone <> 1)), {O.reachable('gaps')}, {_SIZES} SELECT image_id, x, y FROM mask UNION ALL SELECT image_id, x, y FROM pixel WHERE zone <> 1 UNION ALL SELECT image_id, x, y FROM comp JOIN sizes USING (image_id, component) WHERE area <= 3 AND NOT touches")
def g_holes(spark, d):
    """Everything but the speckles of one zone; gaps of up to three pixels are filled."""
    px = pixels(spark, d)
    return K.fill_holes(px.where("NOT (zone = 1 AND noise = 4)").select(*K.AT), 3, px)


_EDGE = f"{_COMP}, {_SIZES} SELECT image_id, x, y FROM comp JOIN sizes USING (image_id, component) WHERE touches"


@query("g_edge_connected", _EDGE)
@query("flt_bg_edge", _EDGE)
@query("j_semi_border", _EDGE)
def g_edge_connected(spark, d):
    px = pixels(spark, d)
    return K.edge_connected(mask(px), px)


@query("flt_bg_all", f"{CTE}, {MASK} SELECT image_id, x, y FROM mask")
def flt_bg_all(spark, d):
    return mask(pixels(spark, d))


@query("flt_bg_transparent", f"{CTE} SELECT image_id, x, y FROM pixel WHERE a / 255.0 < 0.05")
def flt_bg_transparent(spark, d):
    return pixels(spark, d).where(F.col("a") / 255.0 < 0.05).select(*K.AT)


_ISLAND = f"""{CTE}, island AS (SELECT image_id, x, y FROM pixel WHERE noise IN (2, 3)), {O.reachable('island')}, {_SIZES},
labels AS (SELECT image_id, x, y, CASE WHEN zone = 3 AND noise = 8 THEN 0 ELSE zone + 1 END AS label FROM pixel WHERE noise NOT IN (2, 3)),
around AS (SELECT DISTINCT comp.image_id, component, label FROM comp JOIN labels l ON l.image_id = comp.image_id AND abs(l.x - comp.x) + abs(l.y - comp.y) = 1 AND l.x BETWEEN comp.x - 1 AND comp.x + 1 AND l.y BETWEEN comp.y - 1 AND comp.y + 1)"""


def _islands(spark, d):
    px = pixels(spark, d)
    labels = px.where("noise NOT IN (2, 3)").select(*K.AT, F.when((F.col("zone") == 3) & (F.col("noise") == 8), 0).otherwise(F.col("zone") + 1).cast("long").alias("label"))
    return px.where("noise IN (2, 3)").select(*K.AT), labels, px


@query("g_islands", f"{_ISLAND}, near AS (SELECT image_id, component, count(*) AS scans, min(label) AS owner FROM around GROUP BY image_id, component) SELECT image_id, component, CAST(area AS BIGINT) AS area, CASE WHEN NOT touches AND scans = 1 AND owner > 0 THEN 'hole' ELSE 'layer' END AS verdict, CAST(CASE WHEN NOT touches AND scans = 1 AND owner > 0 THEN owner ELSE 0 END AS BIGINT) AS owner FROM sizes LEFT JOIN near USING (image_id, component)")
def g_islands(spark, d):
    return K.islands(*_islands(spark, d)).withColumn("owner", F.coalesce("owner", F.lit(0)).cast("long"))


@query("j_island_neighbours", f"{_ISLAND} SELECT image_id, component, CAST(label AS BIGINT) AS label FROM around")
def j_island_neighbours(spark, d):
    island, labels, px = _islands(spark, d)
    return K.shifted(K.components(island, px), K.SIDES, "component").join(labels, K.AT).select("image_id", "component", "label").distinct()


@query("g_islands_policies", f"{_ISLAND}, near AS (SELECT image_id, component, count(*) AS scans, min(label) AS owner FROM around GROUP BY image_id, component), both_ AS (SELECT image_id, component, NOT touches AND scans = 1 AND owner > 0 AS inner_, owner FROM sizes LEFT JOIN near USING (image_id, component)) SELECT policy, image_id, component, CASE WHEN policy = 'layer' THEN 'layer' ELSE 'hole' END AS verdict, CAST(CASE WHEN policy = 'hole' AND inner_ THEN owner ELSE 0 END AS BIGINT) AS owner FROM both_, (VALUES ('hole'), ('layer'), ('ignore')) AS p(policy) WHERE policy <> 'ignore'")
def g_islands_policies(spark, d):
    out = None
    for policy in ("hole", "layer", "ignore"):
        part = K.islands(*_islands(spark, d), policy).select(F.lit(policy).alias("policy"), "image_id", "component", "verdict", F.coalesce("owner", F.lit(0)).cast("long").alias("owner"))
        out = part if out is None else out.union(part)
    return out


@query("h_set_label", f"{CTE}, {MASK}, {OTHER}, {_LAYERS} SELECT p.pixel_id, CAST(coalesce(max(l.layer) + 1, 0) AS BIGINT) AS label FROM pixel p LEFT JOIN layers l ON l.image_id = p.image_id AND l.x = p.x AND l.y = p.y GROUP BY p.pixel_id")
def h_set_label(spark, d):
    """Later writes win; what no mask writes keeps label 0."""
    px = pixels(spark, d)
    top = layers(px).groupBy(*K.AT).agg((F.max("layer") + 1).cast("long").alias("label"))
    return px.join(top, K.AT, "left").select("pixel_id", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


# -------------------------------------------------------------- tracing ----
@query("g_trace_contour")
def g_trace_contour(spark, d):
    """Outlines of every component of the mask; tested on drawn masks and against a plain walk."""
    px = pixels(spark, d)
    return V.trace_contours(mask(px), px, 2)


@query("u_registry", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', '{v}', {str(a).lower()}, '{','.join(s)}')" for k, (n, (v, a, s)) in enumerate(V.BACKENDS.items())) + ") AS t(place, id, version, available, settings)")
def u_registry(spark, d):
    return V.backends(spark).withColumn("settings", F.array_join("settings", ","))


@query("h_list_backends", "SELECT 'python_contour' AS id")
def h_list_backends(spark, d):
    """Those that can be used here."""
    return V.backends(spark).where("available").select("id")


@query("u_conformance", "SELECT * FROM (VALUES ('valid_paths', true), ('closed_paths', true), ('deterministic', true), ('no_empty_path', true)) AS t(\"check\", passed)")
def u_conformance(spark, d):
    """What a backend has to keep to, checked on the contour backend over the mask, traced twice."""
    px = pixels(spark, d)
    one, two = (written(V.trace_contours(mask(px), px, 2), "traced") for _ in range(2))
    return V.conformance(one, two)


@query("agg_fit_stats")
def agg_fit_stats(spark, d):
    """Outlines, nodes and the longest outline of each image."""
    px = pixels(spark, d)
    return V.trace_contours(mask(px), px, 2).groupBy("image_id").agg(F.count("*").alias("paths"), F.sum("nodes").alias("nodes"), F.max("nodes").alias("longest"))


@query("agg_coverage_gate", f"{CTE}, {MASK}, {OTHER}, {_LAYERS}, n AS (SELECT p.image_id, p.x, p.y, count(l.entry) AS total FROM pixel p LEFT JOIN layers l ON l.image_id = p.image_id AND l.x = p.x AND l.y = p.y GROUP BY ALL) SELECT image_id, CAST(count(*) FILTER (total < 1) AS BIGINT) AS exposed, CAST(count(*) FILTER (total > 1) AS BIGINT) AS overlapping FROM n GROUP BY image_id")
def agg_coverage_gate(spark, d):
    """Pixels that no layer covers, and those that more than one covers; whole pixels cover by 0 or 1 each."""
    px = pixels(spark, d)
    total = layers(px).groupBy(*K.AT).agg(F.count("*").alias("total"))
    n = px.select(*K.AT).join(total, K.AT, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return n.groupBy("image_id").agg(F.count_if(F.col("total") < 1).alias("exposed"), F.count_if(F.col("total") > 1).alias("overlapping"))
