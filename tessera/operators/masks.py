"""Masks as sparse relations of pixels: morphology, components, policies.

A mask is a DataFrame of (image_id, x, y), at most once each; px holds all pixels of the
images, whose extent is taken from it. Nothing here is limited to one image, or to an image in
memory: neighbours are equi-joins within an image, components work on runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import connected_components
from tessera.operators.lineage import written

AT = ["image_id", "x", "y"]
#: The policies for islands, the first of which stands in for an unknown one.
ISLAND_POLICIES = ("hole_or_layer", "hole", "layer", "ignore")


def disc(radius: float) -> list[tuple[int, int]]:
    """Offsets within a radius; below one pixel only the centre."""
    n = int(radius)
    return [(dx, dy) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if dx * dx + dy * dy <= radius * radius]


def frames(px: DataFrame) -> DataFrame:
    """(image_id, width, height): one row for an image."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def shifted(mask: DataFrame, offsets: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Every pixel at every offset, with the columns keep."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    return mask.select("image_id", "x", "y", *keep, F.explode(steps).alias("o")).select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), *keep)


def dilate(mask: DataFrame, radius: float, px: DataFrame) -> DataFrame:
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
    return shifted(mask, disc(radius)).distinct().join(frames(px), "image_id").where(inside).select(*AT)


def erode(mask: DataFrame, radius: float, px: DataFrame) -> DataFrame:
    """The frame's edge is neutral: only pixels of the image outside the mask eat into it."""
    outside = px.select(*AT).join(mask, AT, "left_anti")
    return mask.join(dilate(outside, radius, px), AT, "left_anti")


def offset(mask: DataFrame, radius: float, px: DataFrame) -> DataFrame:
    if radius > 0:
        return dilate(mask, radius, px)
    return erode(mask, -radius, px) if radius < 0 else mask


def thin(mask: DataFrame, size: float, px: DataFrame) -> DataFrame:
    return mask.join(dilate(erode(mask, size / 2, px), size / 2, px), AT, "left_anti")


def restore_thin(original: DataFrame, cleaned: DataFrame, size: float, px: DataFrame) -> DataFrame:
    lost = original.join(cleaned, AT, "left_anti")
    return cleaned.union(lost.join(thin(original, size, px), AT, "left_semi"))


def underlap(mask: DataFrame, silhouette: DataFrame, radius: float, px: DataFrame, preserve_outer_silhouette: bool = True) -> DataFrame:
    """The mask grown under its neighbours; kept inside the silhouette unless told otherwise."""
    if radius <= 0:
        return mask
    grown = dilate(mask, radius, px)
    return grown.join(silhouette, AT, "left_semi") if preserve_outer_silhouette else grown


def runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs (image_id, y, x0, x1): far fewer rows than pixels."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    # within a row of consecutive pixels x - rank is constant
    return mask.withColumn("_g", F.col("x") - F.row_number().over(row)).groupBy("image_id", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def components(mask: DataFrame, px: DataFrame) -> DataFrame:
    """4-connected components: (image_id, x, y, component), named by their smallest y * width + x.

    Runs of neighbouring rows that overlap are linked; the links are contracted.
    """
    run = written(runs(mask).join(frames(px), "image_id").select("image_id", "y", "x0", "x1", F.struct("image_id", (F.col("y") * F.col("width") + F.col("x0")).alias("id")).alias("run")), "runs")
    below = run.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("run").alias("b"))
    link = run.join(below, ["image_id", "y"]).where("x0 <= bx1 AND bx0 <= x1").select(F.col("run").alias("a"), "b")
    named = run.join(connected_components(link).select(F.col("node").alias("run"), "component"), "run", "left")
    return named.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", F.coalesce("component", "run")["id"].alias("component"))


def sizes(parts: DataFrame, px: DataFrame) -> DataFrame:
    """(image_id, component, area, touches_frame)."""
    box = parts.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    touches = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("width") - 1) | (F.col("y1") == F.col("height") - 1)
    return box.join(frames(px), "image_id").select("image_id", "component", "area", touches.alias("touches_frame"))


def _those(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    return parts.join(chosen, ["image_id", "component"], "left_semi").select(*AT)


def remove_speckles(mask: DataFrame, least: int, px: DataFrame) -> DataFrame:
    if least <= 1:
        return mask
    parts = written(components(mask, px), "parts")
    return _those(parts, sizes(parts, px).where(F.col("area") >= least))


def fill_holes(mask: DataFrame, most: int, px: DataFrame) -> DataFrame:
    if most <= 0:
        return mask
    parts = written(components(px.select(*AT).join(mask, AT, "left_anti"), px), "parts")
    return mask.union(_those(parts, sizes(parts, px).where(~F.col("touches_frame") & (F.col("area") <= most))))


def edge_connected(mask: DataFrame, px: DataFrame) -> DataFrame:
    parts = written(components(mask, px), "parts")
    return _those(parts, sizes(parts, px).where("touches_frame"))


def exclusive(masks: DataFrame) -> DataFrame:
    """(image_id, x, y, entry) of the topmost layer of each pixel of (image_id, x, y, entry, layer)."""
    return masks.groupBy(*AT).agg(F.max_by("entry", "layer").alias("entry"))


SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def islands(island: DataFrame, labels: DataFrame, px: DataFrame, policy: str = "hole_or_layer") -> DataFrame:
    """(image_id, component, area, verdict, owner) of every island, by policy: a hole of the one scan around
    it, else a layer; always a layer; or always a hole, where only one scan around it makes an owner. `ignore` leaves none.

    labels: (image_id, x, y, label) of all other pixels, 0 where nothing owns them.
    """
    parts = written(components(island, px), "parts")
    outside = shifted(parts, SIDES, "component").join(island.select(*AT), AT, "left_anti").join(labels, AT)
    near = outside.groupBy("image_id", "component").agg(F.count_distinct("label").alias("scans"), F.min("label").alias("owner"))
    joined = sizes(parts, px).join(near, ["image_id", "component"], "left")
    enclosed = ~F.col("touches_frame") & (F.col("scans") == 1) & (F.col("owner") > 0)
    if policy not in ISLAND_POLICIES:
        policy = ISLAND_POLICIES[0]
    verdict = {"hole": F.lit("hole"), "layer": F.lit("layer")}.get(policy, F.when(enclosed, "hole").otherwise("layer"))
    owner = F.when(enclosed, F.col("owner")) if policy != "layer" else F.lit(None)
    out = joined.select("image_id", "component", "area", verdict.alias("verdict"), owner.cast("long").alias("owner"))
    return out.where("false") if policy == "ignore" else out
