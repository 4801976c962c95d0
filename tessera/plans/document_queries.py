"""Settings documents over the driver's tables: an image for every part or order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import documents as D
from tessera.operators.ranking import ranked
from tessera.plans.registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", D.default_settings(F.col("p_partkey")).alias("doc"))


@query("d_default_settings", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS image, 4 AS scans, 'illustration' AS destination, 'stacked' AS policy, 0.5 AS underlap, 4.0 AS region_area, 'hole_or_layer' AS islands, p_partkey || '-0,' || p_partkey || '-1,' || p_partkey || '-2,' || p_partkey || '-3' AS layers FROM part")
def d_default_settings(spark, d):
    doc = F.col("doc")
    return parts(spark, d).select("p_partkey", doc["imageUuid"].alias("image"), doc["scanCount"].alias("scans"), doc["destination"]["id"].alias("destination"), doc["geometry"]["policy"].alias("policy"), doc["geometry"]["underlap"]["value"].alias("underlap"), doc["globalTraceProfile"]["mask"]["minimumRegionAreaPx2"].alias("region_area"), doc["palette"]["backgroundForegroundPolicy"].alias("islands"), F.array_join(doc["palette"]["layerOrder"], ",").alias("layers"))


@query("d_entry", "SELECT p_partkey, i AS place, p_partkey || '-' || i AS id, 'Colour ' || (i + 1) AS name, 'automatic' AS kind, 25.0 AS reach, 'primary_fill' AS role, 'inherit' AS profile FROM part, range(4) AS t(i)")
def d_entry(spark, d):
    e = parts(spark, d).select("p_partkey", F.posexplode("doc.palette.entries").alias("place", "e"))
    return e.select("p_partkey", F.col("place").cast("long").alias("place"), "e.id", "e.name", "e.kind", "e.reach", "e.role", F.col("e.traceProfile.mode").alias("profile"))


_DEST = "(VALUES " + ", ".join(f"('{k}', '{p}', {u}, {t}, {str(c).lower()}, {D.PROFILES[f][0][0]}.0, {D.PROFILES[f][1][0]})" for k, (p, u, t, c, _, f) in D.DESTINATIONS.items()) + ") AS t(destination, policy, underlap, trapping, closed, region_area, corner)"
#: Names that orders ask for by priority; two of them are not known.
_ASKED = {"1-URGENT": "laser", "2-HIGH": "screen_printing", "3-MEDIUM": "vinyl_paper", "4-NOT SPECIFIED": "embroidery"}
_ASKED_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ASKED.items()) + " ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'logo_branding' ELSE 'custom' END END"


def asked(spark, d):
    name = F.when(F.lit(False), "")
    for k, v in _ASKED.items():
        name = name.when(F.col("o_orderpriority") == k, v)
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", name.otherwise(F.when(F.col("o_orderkey") % 2 == 0, "logo_branding").otherwise("custom")).alias("asked"))


def governed(doc):
    return [doc["destination"]["id"].alias("destination"), doc["geometry"]["policy"].alias("policy"), doc["geometry"]["underlap"]["value"].alias("underlap"), doc["geometry"]["trapping"]["value"].alias("trapping"), doc["geometry"]["validateClosedPaths"].alias("closed"), doc["globalTraceProfile"]["mask"]["minimumRegionAreaPx2"].alias("region_area"), doc["globalTraceProfile"]["vector"]["cornerSensitivity"].alias("corner")]


_KNOWN = f"WITH a AS (SELECT o_orderkey, o_custkey, {_ASKED_SQL} AS asked FROM orders), d AS (SELECT * FROM {_DEST})"


@query("d_apply_destination", f"{_KNOWN} SELECT o_orderkey, destination, policy, underlap, trapping, closed, region_area, corner, 4 AS scans, o_orderkey || '-0' AS first_entry FROM a JOIN d ON destination = CASE WHEN asked IN (SELECT destination FROM d) THEN asked ELSE 'illustration' END")
def d_apply_destination(spark, d):
    docs = asked(spark, d).select("o_orderkey", D.apply_destination(D.default_settings(F.col("o_orderkey")), F.col("asked")).alias("doc"))
    doc = F.col("doc")
    return docs.select("o_orderkey", *governed(doc), doc["scanCount"].alias("scans"), doc["palette"]["entries"][0]["id"].alias("first_entry"))


@query("d_reset_defaults", f"{_KNOWN} SELECT o_orderkey, destination, policy, underlap, trapping, closed, region_area, corner, CAST(0 AS BIGINT) AS pinned FROM a JOIN d ON destination = CASE WHEN asked IN (SELECT destination FROM d) THEN asked ELSE 'illustration' END")
def d_reset_defaults(spark, d):
    doc = F.col("doc")
    docs = asked(spark, d).select("o_orderkey", D.reset_defaults(F.col("o_orderkey"), F.col("asked")).alias("doc"))
    return docs.select("o_orderkey", *governed(doc), F.size(F.filter(doc["palette"]["entries"], lambda e: e["kind"] == "pinned")).cast("long").alias("pinned"))


def pinned_some(spark, d):
    """Documents whose entry at place p_size mod 4 is pinned and named."""
    chosen = F.transform("doc.palette.entries", lambda e, i: F.when(i == F.col("p_size") % 4, e.withField("kind", F.lit("pinned")).withField("name", F.lit("mine")).withField("anchor", F.lit("#102030")).withField("outputColor", F.lit("#112233"))).otherwise(e.withField("name", F.lit("stale")).withField("outputColor", F.lit("#ABCDEF"))))
    return parts(spark, d).select("p_partkey", "p_size", F.col("doc").withField("palette.entries", chosen).alias("doc"))


@query("d_reset_automatic", "SELECT p_partkey, i AS place, p_partkey || '-' || i AS id, CASE WHEN i = p_size % 4 THEN 'mine' ELSE 'Colour ' || (i + 1) END AS name, CASE WHEN i = p_size % 4 THEN '#112233' ELSE '' END AS paint FROM part, range(4) AS t(i)")
def d_reset_automatic(spark, d):
    e = pinned_some(spark, d).select("p_partkey", F.posexplode(D.reset_automatic(F.col("doc.palette.entries"))).alias("place", "e"))
    return e.select("p_partkey", F.col("place").cast("long").alias("place"), "e.id", "e.name", F.coalesce("e.outputColor", F.lit("")).alias("paint"))


@query("flt_enabled", "SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS enabled, CAST(CASE WHEN p_size % 3 = 0 AND p_size % 4 = 1 THEN 0 ELSE 1 END AS BIGINT) AS pinned, CAST(CASE WHEN p_size % 3 = 0 AND p_size % 4 <> 1 THEN 2 ELSE 3 END AS BIGINT) AS automatic FROM part")
def flt_enabled(spark, d):
    """Entries that are enabled, and of those the pinned and the automatic ones; every third document has its second entry off."""
    found = F.transform("doc.palette.entries", lambda e, i: e.withField("enabled", ~((i == 1) & (F.col("p_size") % 3 == 0))))
    on = pinned_some(spark, d).select("p_partkey", F.filter(found, lambda e: e["enabled"]).alias("e"))
    many = lambda kind: F.size(F.filter("e", lambda e: e["kind"] == kind)).cast("long")
    return on.select("p_partkey", F.size("e").cast("long").alias("enabled"), many("pinned").alias("pinned"), many("automatic").alias("automatic"))


_SCOPE = "CASE p_size % 4 WHEN 0 THEN 'structure' WHEN 1 THEN 'palette' WHEN 2 THEN 'full' ELSE 'unheard' END"


def scope():
    return F.when(F.col("p_size") % 4 == 0, "structure").when(F.col("p_size") % 4 == 1, "palette").when(F.col("p_size") % 4 == 2, "full").otherwise("unheard")


@query("d_build_patch", f"SELECT p_partkey, s <> 'palette' AS destination, s = 'structure' AS structure, CAST(CASE WHEN s = 'structure' THEN 0 ELSE 4 END AS BIGINT) AS entries, CASE WHEN s = 'structure' THEN '' ELSE 'all_matching' END AS matching FROM (SELECT p_partkey, {_SCOPE} AS s FROM part)")
def d_build_patch(spark, d):
    made = pinned_some(spark, d).select("p_partkey", D.build_patch(F.col("doc"), scope()).alias("p"))
    return made.select("p_partkey", F.col("p.destination").isNotNull().alias("destination"), F.col("p.entryStructure").isNotNull().alias("structure"), F.greatest(F.coalesce(F.size("p.entries"), F.lit(0)), F.lit(0)).cast("long").alias("entries"), F.coalesce("p.backgroundMatching", F.lit("")).alias("matching"))


@query("d_apply_patch", f"SELECT p_partkey, 4 AS scans, i AS place, 'new' || p_partkey || '-' || i AS id, 'Colour ' || (i + 1) AS name, CASE WHEN s <> 'structure' AND i = p_size % 4 THEN 'pinned' ELSE 'automatic' END AS kind, CASE WHEN s = 'structure' THEN '' WHEN i = p_size % 4 THEN '#112233' ELSE '#ABCDEF' END AS paint, CASE WHEN s = 'palette' THEN 'illustration' ELSE 'laser' END AS destination FROM (SELECT p_partkey, p_size, {_SCOPE} AS s FROM part), range(4) AS t(i)")
def d_apply_patch(spark, d):
    """Patches of documents made for the laser, put onto fresh ones."""
    key = F.col("p_partkey").cast("string")
    lasers = pinned_some(spark, d).select("p_partkey", "p_size", D.apply_destination(F.col("doc"), F.lit("laser")).alias("doc"))
    both = lasers.select("p_partkey", D.build_patch(F.col("doc"), scope()).alias("patch"), D.default_settings(F.concat(F.lit("other"), key)).alias("doc"))
    docs = both.select("p_partkey", D.apply_patch(F.col("doc"), F.col("patch"), F.concat(F.lit("new"), key)).alias("doc"))
    e = docs.select("p_partkey", F.col("doc.scanCount").alias("scans"), F.col("doc.destination.id").alias("destination"), F.posexplode("doc.palette.entries").alias("place", "e"))
    return e.select("p_partkey", "scans", F.col("place").cast("long").alias("place"), "e.id", "e.name", "e.kind", F.coalesce("e.outputColor", F.lit("")).alias("paint"), "destination")


_MODE = "CASE p_size % 4 WHEN 0 THEN 'inherit' WHEN 1 THEN 'preset' WHEN 2 THEN 'override' ELSE 'unheard' END"
_NAMED = "CASE p_partkey % 3 WHEN 0 THEN 'sharp_details' WHEN 1 THEN 'no_such' END"
_PROF = "(VALUES " + ", ".join(f"('{k}', {m[0]}.0, {m[3]}, {v[0]})" for k, (m, v) in D.PROFILES.items()) + ") AS t(name, region_area, smoothing, corner)"


@query("j_label_profile", f"WITH a AS (SELECT p_partkey, p_size, {_MODE} AS mode, {_NAMED} AS named FROM part), p AS (SELECT * FROM {_PROF}), b AS (SELECT a.*, CASE WHEN mode IN ('inherit', 'unheard') OR mode = 'override' AND named IS NULL THEN 'smooth_shapes' WHEN named = 'sharp_details' THEN 'sharp_details' ELSE 'default' END AS base FROM a) SELECT p_partkey, round(CASE WHEN mode = 'override' THEN p_size ELSE region_area END, 6) AS region_area, smoothing, corner FROM b JOIN p ON p.name = base")
def j_label_profile(spark, d):
    """Entries that inherit, name a built-in profile, or override one field; the document's own profile is smooth_shapes."""
    mode = F.when(F.col("p_size") % 4 == 0, "inherit").when(F.col("p_size") % 4 == 1, "preset").when(F.col("p_size") % 4 == 2, "override").otherwise("unheard")
    named = F.when(F.col("p_partkey") % 3 == 0, "sharp_details").when(F.col("p_partkey") % 3 == 1, "no_such")
    over = F.create_map(F.lit("minimumRegionAreaPx2"), F.col("p_size").cast("double"))
    p = table(spark, d, "part").select("p_partkey", D.resolve_profile(mode, named, over, D.profile("smooth_shapes")).alias("p"))
    return p.select("p_partkey", F.round("p.mask.minimumRegionAreaPx2", 6).alias("region_area"), F.col("p.mask.smoothingRadiusPx").alias("smoothing"), F.col("p.vector.cornerSensitivity").alias("corner"))


@query("lim_scan_count", "WITH a AS (SELECT p_partkey, least(64, greatest(1, p_size - 3)) AS n FROM part) SELECT p_partkey, i AS place, CASE WHEN i < 4 THEN p_partkey || '-' || i ELSE p_partkey || '-new-' || i END AS id, 'Colour ' || (i + 1) AS name FROM a, LATERAL (SELECT unnest(range(n)) AS i)")
def lim_scan_count(spark, d):
    """Entries padded or trimmed to a scan count from -2 up."""
    n = parts(spark, d).select("p_partkey", F.posexplode(D.normalized(F.col("doc.palette.entries"), F.col("p_size") - 3, F.col("p_partkey").cast("string"))).alias("place", "e"))
    return n.select("p_partkey", F.col("place").cast("long").alias("place"), "e.id", "e.name")


@query("d_layer_order", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey || '-3,' || p_partkey || '-1,' || p_partkey || '-0,' || p_partkey || '-2' ELSE p_partkey || '-0,' || p_partkey || '-1,' || p_partkey || '-2,' || p_partkey || '-3' END AS layers FROM part")
def d_layer_order(spark, d):
    key = F.col("p_partkey").cast("string")
    wanted = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(key, F.lit("-3")), F.lit("gone"), F.concat(key, F.lit("-1")))).otherwise(F.array().cast("array<string>"))
    return parts(spark, d).select("p_partkey", F.array_join(D.layer_order(F.col("doc.palette.entries"), wanted), ",").alias("layers"))


@query("d_unsupported", "WITH k AS (SELECT p_partkey, unnest(CASE p_size % 3 WHEN 0 THEN ['requireClosedPaths', 'optimization', 'cornerSensitivity'] WHEN 1 THEN ['minimumPathAreaPx2'] ELSE ['curveSmoothing', 'optimization'] END) AS k, CASE WHEN p_partkey % 2 = 0 THEN ['cornerSensitivity', 'optimization'] ELSE [] END AS have FROM part), m AS (SELECT p_partkey, k FROM k WHERE k <> 'requireClosedPaths' AND NOT list_contains(have, k)) SELECT p.p_partkey, coalesce(string_agg(k, ',' ORDER BY k), '') AS missing FROM part p LEFT JOIN m USING (p_partkey) GROUP BY p.p_partkey")
def d_unsupported(spark, d):
    text = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    keys = F.when(F.col("p_size") % 3 == 0, text("requireClosedPaths", "optimization", "cornerSensitivity")).when(F.col("p_size") % 3 == 1, text("minimumPathAreaPx2")).otherwise(text("curveSmoothing", "optimization"))
    have = F.when(F.col("p_partkey") % 2 == 0, text("cornerSensitivity", "optimization")).otherwise(text())
    return table(spark, d, "part").select("p_partkey", F.array_join(D.unsupported(keys, have), ",").alias("missing"))


_JSON = "'{\"scanCount\":' || (o_custkey % 9) || ',\"imageUuid\":\"' || o_orderkey || '\",\"generation\":{\"lastBackendId\":\"x' || o_orderkey || '\"},\"alpha\":{\"matte\":\"white\",\"ignoreBelow\":0.05}}'"


@query("f_settings_hash", "SELECT o_orderkey, sha256('{\"alpha\":{\"ignoreBelow\":0.05,\"matte\":\"white\"},\"imageUuid\":\"' || o_orderkey || '\",\"scanCount\":' || (o_custkey % 9) || '}') AS hash FROM orders")
def f_settings_hash(spark, d):
    """Keys in another order and what was generated change nothing."""
    return table(spark, d, "orders").select("o_orderkey", D.settings_hash(F.expr(_JSON)).alias("hash"))


@query("d_source_changed", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS stored, o_custkey % 3 <> 0 AND o_custkey % 2 = 1 AS changed, 'potrace' AS backend, coalesce(CASE WHEN o_custkey % 5 = 0 THEN 'g' || o_custkey END, '') AS made FROM orders")
def d_source_changed(spark, d):
    """Fingerprints recorded after a run (or never), against the picture's present one."""
    mark = lambda c: F.sha2(c.cast("string"), 256)
    key = F.col("o_custkey")
    ran = D.record_provenance(D.default_settings(F.col("o_orderkey")), mark(key), F.lit("h"), F.lit("potrace"), F.lit("1"), F.when(key % 5 == 0, F.concat(F.lit("g"), key.cast("string"))))
    never = D.record_provenance(D.default_settings(F.col("o_orderkey")), F.lit(""), F.lit("h"), F.lit("potrace"), F.lit("1"), F.when(key % 5 == 0, F.concat(F.lit("g"), key.cast("string"))))
    doc = F.when(key % 3 == 0, never).otherwise(ran)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", doc.alias("doc"))
    return rows.select("o_orderkey", D.stored_fingerprint(F.col("doc")).alias("stored"), D.source_changed(F.col("doc"), mark(key - key % 2)).alias("changed"), F.col("doc.generation.lastBackendId").alias("backend"), F.coalesce("doc.generation.lastGeneratedGroupId", F.lit("")).alias("made"))


_SIDECAR = "CASE o_orderkey % 4 WHEN 0 THEN '{\"schemaVersion\":1,\"scanCount\":' || (o_custkey % 9 + 1) || ',\"imageUuid\":\"u' || o_custkey || '\",\"destination\":{\"id\":\"laser\"}}' WHEN 1 THEN '{\"schemaVersion\":2,\"scanCount\":9}' WHEN 2 THEN '{\"schemaVersion\":1,\"later\":true}' ELSE '{broken' END"


@query("src_settings", "SELECT o_orderkey, 1 AS version, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 9 + 1 ELSE 4 END AS scans, CASE WHEN o_orderkey % 4 = 0 THEN 'laser' ELSE 'illustration' END AS destination, CASE WHEN o_orderkey % 4 = 0 THEN 'u' || o_custkey ELSE CAST(o_orderkey AS VARCHAR) END AS image, o_orderkey % 4 IN (0, 2) AS read FROM orders")
def src_settings(spark, d):
    """Sidecars that are whole, of another version, partial, or broken; nothing fails."""
    got = table(spark, d, "orders").select("o_orderkey", D.read_settings(F.expr(_SIDECAR), F.col("o_orderkey")).alias("s"))
    return got.select("o_orderkey", F.col("s.schemaVersion").alias("version"), F.col("s.scanCount").alias("scans"), "s.destination", F.col("s.imageUuid").alias("image"), "s.read")


_PRESET = "CASE WHEN o_custkey % 11 = 0 THEN '{{not json' ELSE '{{\"schemaVersion\":' || (CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 1 END) || ',\"presetUuid\":\"' || o_orderkey || '\",\"name\":\"n' || o_custkey || '\",\"updatedAt\":\"' || {0} || '\",\"scope\":\"full\"}}' END"
_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"


@query("src_presets", "SELECT CAST(o_orderkey AS VARCHAR) AS preset, 'n' || o_custkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders WHERE o_custkey % 11 <> 0 AND o_custkey % 7 <> 0")
def src_presets(spark, d):
    """Every preset that can be read and has version 1."""
    texts = table(spark, d, "orders").select(F.expr(_PRESET.format(_DAY)).alias("text"))
    return D.read_presets(texts, "text").select(F.col("presetUuid").alias("preset"), "name", F.col("updatedAt").alias("updated"))


@query("srt_presets", "SELECT CAST(o_orderkey AS VARCHAR) AS preset, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, CAST(o_orderkey AS VARCHAR)) AS place FROM orders WHERE o_custkey % 11 <> 0 AND o_custkey % 7 <> 0")
def srt_presets(spark, d):
    """All of them, newest first, by identifier on ties."""
    return ranked(src_presets(spark, d), F.desc("updated"), F.col("preset")).select("preset", "place")


@query("snk_preset", "SELECT p_partkey, '{\"schemaVersion\":1,\"presetUuid\":\"' || p_partkey || '\",\"name\":\"' || p_name || '\",\"scope\":\"' || s || '\"}' AS text FROM (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'palette' END AS s FROM part)")
def snk_preset(spark, d):
    """The text that save_presets writes for each preset."""
    p = table(spark, d, "part").select("p_partkey", F.lit(1).alias("schemaVersion"), F.col("p_partkey").cast("string").alias("presetUuid"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "full").otherwise("palette").alias("scope"))
    return p.select("p_partkey", F.to_json(F.struct("schemaVersion", "presetUuid", "name", "scope")).alias("text"))


@query("snk_sidecar", "SELECT o_orderkey, '{\"schemaVersion\":1,\"imageUuid\":\"' || o_orderkey || '\",\"destination\":{\"id\":\"illustration\",\"presetVersion\":1},\"scanCount\":4}' AS text FROM orders")
def snk_sidecar(spark, d):
    """The minified text that stands beside an image; its fields are those that src_settings reads."""
    doc = D.default_settings(F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(doc["schemaVersion"].alias("schemaVersion"), doc["imageUuid"].alias("imageUuid"), doc["destination"].alias("destination"), doc["scanCount"].alias("scanCount"))).alias("text"))


@query("h_allows_overlap", "SELECT p_partkey, p_size % 5 IN (0, 1) AS overlap FROM part")
def h_allows_overlap(spark, d):
    policy = F.element_at(F.array(*map(F.lit, ("stacked", "stacked_trapped", "exclusive_layers", "separate_operations", "unheard"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", policy.isin(*D.OVERLAPPING).alias("overlap"))
