"""Settings documents: defaults, destinations, profiles, patches and provenance as column expressions.

A document is one struct column; its palette is an array of entry structs, in order of claim. Nothing
here parses by hand: text comes in through from_json and goes out through to_json.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION, SCANS, MOST_SCANS = 1, 4, 64

MASK = "minimumRegionAreaPx2 DOUBLE, fillHolesAreaPx2 DOUBLE, closeGapsRadiusPx DOUBLE, smoothingRadiusPx DOUBLE, preserveThinFeatures BOOLEAN, minimumFeatureWidthPx DOUBLE, offsetPx DOUBLE"
VECTOR = "cornerSensitivity DOUBLE, curveSmoothing DOUBLE, optimization DOUBLE, requireClosedPaths BOOLEAN, minimumPathAreaPx2 DOUBLE"
PROFILE = f"STRUCT<mask: STRUCT<{MASK.replace(' DOUBLE', ': DOUBLE').replace(' BOOLEAN', ': BOOLEAN')}>, vector: STRUCT<{VECTOR.replace(' DOUBLE', ': DOUBLE').replace(' BOOLEAN', ': BOOLEAN')}>>"
ENTRY = f"STRUCT<id: STRING, name: STRING, enabled: BOOLEAN, kind: STRING, anchor: STRING, outputMode: STRING, outputColor: STRING, reach: DOUBLE, role: STRING, traceProfile: STRUCT<mode: STRING, profileId: STRING>>"

# The built-in profiles, mask fields then vector fields in the order of the schemas above.
PROFILES = {
    "default": ((4, 4, 1, 0.5, True, 1, 0), (0.65, 0.5, 0.2, False, 1)),
    "smooth_shapes": ((8, 8, 2, 1.2, False, 2, 0), (0.35, 0.8, 0.65, False, 2)),
    "sharp_details": ((12, 2, 0, 0.2, True, 1, 0), (0.9, 0.15, 0.15, False, 1)),
    "thin_line_art": ((2, 1, 1, 0.3, True, 1, 0), (0.85, 0.4, 0.25, False, 1)),
    "small_accents": ((1, 0, 0, 0.15, True, 1, 0), (0.8, 0.2, 0.1, False, 1)),
    "simplified_background": ((64, 32, 3, 1.5, False, 3, 0), (0.25, 0.9, 0.8, False, 4)),
    "fabrication_clean": ((16, 16, 1, 0.4, False, 2, 0), (0.75, 0.35, 0.6, True, 4)),
}
# The destinations: policy, underlap (source pixels), trapping (mm), closed paths validated, duplicates detected, profile.
DESTINATIONS = {
    "illustration": ("stacked", 0.5, 0.0, False, False, "default"),
    "logo_branding": ("stacked", 0.25, 0.0, True, True, "smooth_shapes"),
    "screen_printing": ("stacked_trapped", 0.0, 0.25, False, False, "default"),
    "vinyl_paper": ("exclusive_layers", 0.0, 0.0, True, True, "fabrication_clean"),
    "laser": ("separate_operations", 0.0, 0.0, True, True, "fabrication_clean"),
    "custom": ("stacked", 0.0, 0.0, False, False, "default"),
}
FALLBACK = {"destination": "illustration", "profile": "default"}
OVERLAPPING = ("stacked", "stacked_trapped")
# Which parts of a document a preset of each scope carries.
SCOPES = {"structure": ("destination", "geometry", "globalTraceProfile", "output", "scanCount", "entryStructure"), "palette": ("entries", "backgroundMatching", "colorProcessing", "alpha"), "full": ("destination", "geometry", "globalTraceProfile", "output", "scanCount", "entries", "backgroundMatching", "colorProcessing", "alpha")}


def fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ")) for f in ddl.split(", ")]


def profile(name: str) -> Column:
    """A built-in profile as a struct; the default one for an unknown name."""
    mask, vector = PROFILES.get(name, PROFILES[FALLBACK["profile"]])
    part = lambda ddl, values: F.struct(*[F.lit(v if k == "BOOLEAN" else float(v)).alias(n) for (n, k), v in zip(fields(ddl), values, strict=True)])
    return F.struct(part(MASK, mask).alias("mask"), part(VECTOR, vector).alias("vector"))


def choose(name: Column, known: dict, make, fallback: str) -> Column:
    """make(k) for the known name that a column holds, else for the fallback: one CASE over a fixed handful."""
    out = F.when(F.lit(False), make(fallback))
    for k in known:
        out = out.when(name == k, make(k))
    return out.otherwise(make(fallback))


def profile_of(name: Column) -> Column:
    return choose(name, PROFILES, profile, FALLBACK["profile"])


def destination_id(name: Column) -> Column:
    return choose(name, DESTINATIONS, F.lit, FALLBACK["destination"])


def geometry(name: str) -> Column:
    policy, underlap, trapping, closed, duplicates, _ = DESTINATIONS[name]
    measure = lambda v, unit: F.struct(F.lit(float(v)).alias("value"), F.lit(unit).alias("unit"))
    return F.struct(F.lit(policy).alias("policy"), measure(underlap, "source_px").alias("underlap"), measure(trapping, "mm").alias("trapping"), F.lit(True).alias("preserveOuterSilhouette"), F.lit(closed).alias("validateClosedPaths"), F.lit(duplicates).alias("detectDuplicateGeometry"))


def entry(index: Column | int, entry_id: Column) -> Column:
    """A fresh automatic entry; index counts from 0."""
    number = (F.lit(index) if isinstance(index, int) else index) + 1
    text = lambda v, n: F.lit(v).cast("string").alias(n)
    inherit = F.struct(text("inherit", "mode"), text(None, "profileId")).alias("traceProfile")
    return F.struct(entry_id.cast("string").alias("id"), F.concat(F.lit("Colour "), number.cast("string")).alias("name"), F.lit(True).alias("enabled"), text("automatic", "kind"), text(None, "anchor"), text("automatic_centroid", "outputMode"), text(None, "outputColor"), F.lit(25.0).alias("reach"), text("primary_fill", "role"), inherit).cast(ENTRY)


def entries(count: Column | int, prefix: Column) -> Column:
    """count fresh entries whose ids are the prefix and their place."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.when(n <= 0, F.array().cast(f"array<{ENTRY}>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: entry(i, F.concat(prefix, F.lit("-"), i.cast("string")))))


def default_settings(image: Column) -> Column:
    made = entries(SCANS, image.cast("string"))
    return F.struct(
        F.lit(VERSION).alias("schemaVersion"), image.cast("string").alias("imageUuid"), F.struct(F.lit("").alias("fingerprint")).alias("source"),
        F.struct(F.lit("illustration").alias("id"), F.lit(1).alias("presetVersion")).alias("destination"), F.lit(SCANS).alias("scanCount"),
        F.struct(made.alias("entries"), F.transform(made, lambda e: e["id"]).alias("layerOrder"), F.lit(None).cast("string").alias("backgroundEntryId"), F.lit("all_matching").alias("backgroundMatching"), F.lit("hole_or_layer").alias("backgroundForegroundPolicy")).alias("palette"),
        F.struct(F.lit(0.05).alias("ignoreBelow")).alias("alpha"), profile("default").alias("globalTraceProfile"), geometry("illustration").alias("geometry"),
        F.struct(F.lit(False).alias("hideSourceImageAfterApply"), F.lit("keep_paths").alias("backgroundOutput")).alias("output"),
        F.struct(*[F.lit(None).cast("string").alias(n) for n in ("lastSourceHash", "lastSettingsHash", "lastBackendId", "lastBackendVersion", "lastGeneratedGroupId")]).alias("generation"),
    )


def apply_destination(doc: Column, name: Column) -> Column:
    """What a destination governs is overwritten; palette, scan count and picked colours stay."""
    known = destination_id(name)
    doc = doc.withField("destination", F.struct(known.alias("id"), F.lit(1).alias("presetVersion")))
    doc = doc.withField("geometry", choose(known, DESTINATIONS, geometry, FALLBACK["destination"]))
    doc = doc.withField("globalTraceProfile", choose(known, DESTINATIONS, lambda k: profile(DESTINATIONS[k][5]), FALLBACK["destination"]))
    return doc.withField("output.hideSourceImageAfterApply", F.lit(False))


def reset_defaults(image: Column, name: Column) -> Column:
    return apply_destination(default_settings(image), name)


def reset_automatic(found: Column) -> Column:
    """Pinned entries stay; automatic ones become fresh ones with their id, at their place."""
    return F.transform(found, lambda e, i: F.when(e["kind"] == "pinned", e).otherwise(entry(i, e["id"])))


def normalized(found: Column, count: Column, prefix: Column) -> Column:
    """Entries padded with fresh ones or trimmed to the scan count (1 to MOST_SCANS)."""
    n = F.least(F.greatest(count, F.lit(1)), F.lit(MOST_SCANS))
    have = F.size(found)
    fresh = F.transform(F.sequence(have, F.greatest(n, have + 1) - 1), lambda i: entry(i, F.concat(prefix, F.lit("-new-"), i.cast("string"))))
    return F.slice(F.when(n > have, F.concat(found, fresh)).otherwise(found), 1, n.cast("int"))


def layer_order(found: Column, order: Column) -> Column:
    """Ids from bottom to top: those of the order that are known, then the others as in the palette."""
    ids = F.transform(found, lambda e: e["id"])
    kept = F.filter(order, lambda x: F.array_contains(ids, x))
    return F.concat(kept, F.array_except(ids, kept))


def resolve_profile(mode: Column, name: Column, over: Column, base: Column) -> Column:
    """An entry's profile: the document's (also for an unknown mode), a built-in one, or either with the values of a map
    put over it. over: map of field to double; a field it does not name stays."""

    def put(section: Column, ddl: str) -> Column:
        new = [F.coalesce(over[n] != 0 if k == "BOOLEAN" else over[n], section[n]).alias(n) for n, k in fields(ddl)]
        return F.struct(*new)

    under = F.when(name.isNotNull(), profile_of(name)).otherwise(base)
    overridden = F.struct(put(under["mask"], MASK).alias("mask"), put(under["vector"], VECTOR).alias("vector"))
    return F.when(mode == "preset", profile_of(F.coalesce(name, F.lit("default")))).when(mode == "override", overridden).otherwise(base)


def patch_fields(scope: Column) -> Column:
    """The parts that a patch of a scope carries, sorted."""
    return choose(scope, SCOPES, lambda k: F.array(*map(F.lit, sorted(SCOPES[k]))), "full")


def build_patch(doc: Column, scope: Column) -> Column:
    """A preset's patch as a struct whose fields are null where the scope leaves them out; never the image's identity or what was generated."""
    held = lambda n, v: F.when(F.array_contains(patch_fields(scope), n), v).alias(n)
    found = doc["palette"]["entries"]
    return F.struct(
        held("destination", doc["destination"]), held("geometry", doc["geometry"]), held("globalTraceProfile", doc["globalTraceProfile"]), held("output", doc["output"]), held("scanCount", doc["scanCount"]),
        held("entries", F.transform(found, lambda e: F.struct(*[e[n].alias(n) for n in ("kind", "anchor", "outputMode", "outputColor", "reach", "role", "traceProfile")]))), held("backgroundMatching", doc["palette"]["backgroundMatching"]), held("alpha", doc["alpha"]),
        held("entryStructure", F.transform(found, lambda e: F.struct(*[e[n].alias(n) for n in ("enabled", "role", "traceProfile")]))),
    )


def apply_patch(doc: Column, patch: Column, prefix: Column) -> Column:
    """The patch merged into a document; entries get new ids (prefix and place), and the scan count follows them."""
    old = doc["palette"]
    new_id = lambda i: F.concat(prefix, F.lit("-"), i.cast("string"))

    def rebuilt(kept: dict):
        """A fresh entry in which some fields come from the patch's entry."""

        def make(e: Column, i: Column) -> Column:
            fresh = entry(i, new_id(i))
            for n, take in kept.items():
                fresh = fresh.withField(n, take(e[n], n))
            return fresh

        return make

    usual = {"kind": F.lit("automatic"), "outputMode": F.lit("automatic_centroid"), "reach": F.lit(25.0), "role": F.lit("primary_fill"), "enabled": F.lit(True), "traceProfile": F.struct(F.lit("inherit").alias("mode"), F.lit(None).cast("string").alias("profileId"))}
    or_usual = lambda v, n: F.coalesce(v, usual[n])
    full = rebuilt({**dict.fromkeys(("kind", "outputMode", "reach", "role", "traceProfile"), or_usual), **dict.fromkeys(("anchor", "outputColor"), lambda v, n: v)})
    structure = rebuilt(dict.fromkeys(("enabled", "role", "traceProfile"), or_usual))
    made = F.when(patch["entries"].isNotNull(), F.transform(patch["entries"], full)).when(patch["entryStructure"].isNotNull(), F.transform(patch["entryStructure"], structure))
    palette = {"entries": F.coalesce(made, old["entries"]), "layerOrder": F.coalesce(F.transform(made, lambda e: e["id"]), old["layerOrder"]), "backgroundEntryId": F.when(made.isNull(), old["backgroundEntryId"]), "backgroundMatching": F.coalesce(patch["backgroundMatching"], old["backgroundMatching"])}
    new = {part: F.coalesce(patch[part], doc[part]) for part in ("destination", "geometry", "globalTraceProfile", "output", "alpha")}
    new["scanCount"] = F.coalesce(F.when(made.isNotNull(), F.size(made)), patch["scanCount"], doc["scanCount"])
    # every new value is read from the documents as they came, so the expression grows with the fields and not with their nesting
    out = doc
    for name, value in (*new.items(), *((f"palette.{n}", v) for n, v in palette.items())):
        out = out.withField(name, value)
    return out


def unsupported(vector_keys: Column, supported: Column) -> Column:
    """Vector settings that a backend does not claim; requireClosedPaths concerns the pipeline."""
    return F.array_sort(F.array_except(F.array_remove(vector_keys, "requireClosedPaths"), supported))


def stored_fingerprint(doc: Column) -> Column:
    return F.coalesce(doc["source"]["fingerprint"], F.lit(""))


def source_changed(doc: Column, current: Column) -> Column:
    """A recorded fingerprint that no longer matches; none recorded is no change."""
    return (stored_fingerprint(doc) != "") & (stored_fingerprint(doc) != current)


def canonical(text: str) -> str:
    """Sorted keys, no spaces, without what was generated."""
    return json.dumps({k: v for k, v in json.loads(text).items() if k != "generation"}, sort_keys=True, separators=(",", ":"))


@F.arrow_udf(StringType())
def settings_hash(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SHA-256 of a JSON document's canonical form, null where it is no object. Key order is nothing that SQL functions can change."""

    def one(text: str | None) -> str | None:
        try:
            return hashlib.sha256(canonical(text).encode()).hexdigest()
        except (TypeError, ValueError, AttributeError):
            return None

    for batch in texts:
        yield pa.array([one(t) for t in batch.to_pylist()], pa.string())


def record_provenance(doc: Column, source_hash: Column, settings: Column, backend: Column, version: Column, group: Column) -> Column:
    """The block written after a run, and the source's fingerprint."""
    out = doc
    for n, v in (("lastSourceHash", source_hash), ("lastSettingsHash", settings), ("lastBackendId", backend), ("lastBackendVersion", version), ("lastGeneratedGroupId", F.coalesce(group, doc["generation"]["lastGeneratedGroupId"]))):
        out = out.withField(f"generation.{n}", v)
    return out.withField("source.fingerprint", source_hash)


def read_settings(text: Column, image: Column) -> Column:
    """schemaVersion, scanCount, destination and imageUuid of a sidecar's text; the defaults where it can't be read or has another version."""
    read = F.from_json(text, "schemaVersion INT, scanCount INT, imageUuid STRING, destination STRUCT<id: STRING>", {"mode": "PERMISSIVE"})
    good = read["schemaVersion"] == VERSION
    usual = default_settings(image)
    pick = lambda v, d: F.when(good, F.coalesce(v, d)).otherwise(d)
    return F.struct(F.lit(VERSION).alias("schemaVersion"), pick(read["scanCount"], usual["scanCount"]).alias("scanCount"), pick(read["destination"]["id"], usual["destination"]["id"]).alias("destination"), pick(read["imageUuid"], usual["imageUuid"]).alias("imageUuid"), F.coalesce(good, F.lit(False)).alias("read"))


def read_presets(texts: DataFrame, column: str) -> DataFrame:
    """presetUuid, name, updatedAt, scope of every readable preset of version 1."""
    read = F.from_json(F.col(column), "schemaVersion INT, presetUuid STRING, name STRING, updatedAt STRING, scope STRING", {"mode": "PERMISSIVE"})
    return texts.select(read.alias("p")).where(F.col("p.schemaVersion") == VERSION).select("p.presetUuid", "p.name", F.coalesce("p.updatedAt", F.lit("")).alias("updatedAt"), "p.scope")


def load_presets(spark: SparkSession, folder: str) -> DataFrame:
    return read_presets(spark.read.text(folder, wholetext=True, pathGlobFilter="*.json"), "value")


def save_presets(presets: DataFrame, folder: str) -> None:
    """One JSON text for each row; Spark's committer renames files into place, so no reader sees half a file."""
    presets.select(F.to_json(F.struct(*presets.columns)).alias("value")).write.mode("append").text(folder)
