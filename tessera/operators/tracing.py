"""Tracing masks into paths: the contour backend, the registry of backends, and the checks a backend has to pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import path_valid
from tessera.operators.lineage import written
from tessera.operators.masks import AT, SIDES, components

#: Where a walk goes on to, in order of preference: up, right, down, left.
TURNS = ((0, -1), (1, 0), (0, 1), (-1, 0))
# Backends by id with their version, whether this engine has them, and the settings of a profile they heed.
BACKENDS = {
    "potrace": ("1.16", False, ("cornerSensitivity", "curveSmoothing", "minimumPathAreaPx2", "optimization")),
    "vtracer": ("0.6.15", False, ("cornerSensitivity", "curveSmoothing", "minimumPathAreaPx2")),
    "python_contour": ("1.0.0", True, ("minimumPathAreaPx2",)),
}


def backends(spark: SparkSession) -> DataFrame:
    """place, id, version, available, settings: in the order in which one is picked."""
    return spark.createDataFrame([(k, n, v, a, list(s)) for k, (n, (v, a, s)) in enumerate(BACKENDS.items())], "place int, id string, version string, available boolean, settings array<string>")


def chosen_backend(preferred: str, exact: bool = False) -> str:
    """The backend that is asked for if it is here, else the first that is; an error if only the one asked for will do."""
    if BACKENDS.get(preferred, ("", False, ()))[1]:
        return preferred
    if exact and preferred != "auto":
        raise ValueError(f"backend {preferred} is not available")
    return next(n for n, (_, available, _) in BACKENDS.items() if available)


def walk(pixels: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Loops of border pixels (y, x), each begun at the first one left in raster order and led on to a neighbour not yet
    taken, by TURNS; loops of fewer than three pixels are dropped."""
    left, loops = set(pixels), []
    for start in sorted(pixels):
        loop, at = [], start
        while at in left:
            left.discard(at)
            loop.append(at)
            at = next(((at[0] + dy, at[1] + dx) for dx, dy in TURNS if (at[0] + dy, at[1] + dx) in left), at)
        if len(loop) >= 3:
            loops.append(loop)
    return loops


def trace_contours(mask: DataFrame, px: DataFrame, least_area: int = 1) -> DataFrame:
    """image_id, component, place, path, nodes: the outlines of every component of at least an area, through pixel centres.
    Only border pixels travel; a component's border is one group, bounded by its image."""
    parts = written(components(mask, px), "parts")
    large = parts.groupBy("image_id", "component").agg(F.count("*").alias("area")).where(F.col("area") >= least_area)
    step = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in SIDES])
    around = parts.select("image_id", "component", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(step).alias("n")).select("image_id", "component", "px", "py", "n.x", "n.y")
    border = around.join(parts.select(*AT), AT, "left_anti").select("image_id", "component", "px", "py").distinct().join(large, ["image_id", "component"], "left_semi")

    def outline(part: pd.DataFrame) -> pd.DataFrame:
        loops = walk(list(zip(part["py"].tolist(), part["px"].tolist(), strict=True)))
        paths = [" L ".join(f"{x + 0.5:.3f} {y + 0.5:.3f}" for y, x in loop) for loop in loops]
        key = part[["image_id", "component"]].iloc[[0] * len(loops)].reset_index(drop=True)
        return key.assign(place=range(len(loops)), path=pd.Series([f"M {p} Z" for p in paths], dtype=object), nodes=[len(x) + 1 for x in loops])

    kind = dict(parts.dtypes)
    return border.groupBy("image_id", "component").applyInPandas(outline, f"image_id {kind['image_id']}, component {kind['component']}, place long, path string, nodes long")


def conformance(paths: DataFrame, again: DataFrame) -> DataFrame:
    """check, passed: of a backend's paths (image_id, component, place, path) and those of a second run."""
    key = ["image_id", "component", "place", "path"]
    differ = paths.select(*key).exceptAll(again.select(*key)).union(again.select(*key).exceptAll(paths.select(*key)))
    checks = {"valid_paths": paths.where(~path_valid(F.col("path"), F.lit("evenodd"))), "closed_paths": paths.where(~F.endswith("path", F.lit("Z"))), "deterministic": differ, "no_empty_path": paths.where("nodes < 4")}
    out = None
    for name, bad in checks.items():
        one = bad.agg((F.count("*") == 0).alias("passed")).select(F.lit(name).alias("check"), "passed")
        out = one if out is None else out.union(one)
    return out
