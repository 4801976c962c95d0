"""Colour scalars, palettes and histograms over the derived picture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.operators import matching as M
from tessera.operators.masks import frames
from tessera.operators.ranking import ranked
from tessera.operators.matching import Entry
from tessera.plans import oracle as O
from tessera.plans.registry import query
from tessera.sources.raster import pixels

PALETTE = [Entry("red", "#C83232", True, 22), Entry("blue", "#2C40C8", True, 24), Entry("rust", "#B83028", True, 30), Entry("sand", "#F0EBE1", False), Entry("leaf", "#7CB45A", False)]
PINNED = [e for e in PALETTE if e.pinned]
CTE = f"WITH {O.PIXEL},\n{O.lab()}"
ECTE = f"WITH {O.PIXEL},\n{O.lab(half='engine')}"


def lch(spark, d):
    return M.with_lch(pixels(spark, d))


def r6(col, name):
    return F.round(col, 6).alias(name)


@query("f_oklab", f"{CTE} SELECT pixel_id, round(l, 6) AS l, round(ok_a, 6) AS ok_a, round(ok_b, 6) AS ok_b FROM lab")
def f_oklab(spark, d):
    return lch(spark, d).select("pixel_id", r6("l", "l"), r6("ok_a", "ok_a"), r6("ok_b", "ok_b"))


@query("f_oklch", f"{CTE} SELECT pixel_id, round(l, 6) AS l, round(c, 6) AS c, round(h, 5) AS h FROM lab")
def f_oklch(spark, d):
    return lch(spark, d).select("pixel_id", r6("l", "l"), r6("c", "c"), F.round("h", 5).alias("h"))


@query("f_oklab_engine", f"{ECTE} SELECT pixel_id, round(l, 6) AS l, round(ok_a, 6) AS ok_a, round(ok_b, 6) AS ok_b, round(h, 6) AS hue FROM lab")
def f_oklab_engine(spark, d):
    l, a, b = C.oklab(*(C.unit(x) for x in "rgb"), "engine")
    return pixels(spark, d).select("pixel_id", l.alias("l"), a.alias("ok_a"), b.alias("ok_b")).select("pixel_id", r6("l", "l"), r6("ok_a", "ok_a"), r6("ok_b", "ok_b"), r6(F.atan2("ok_b", "ok_a"), "hue"))


@query("f_oklab_inv", f"WITH {O.PIXEL} SELECT pixel_id, '#' || printf('%02X%02X%02X', r, g, b) AS hex FROM pixel")
def f_oklab_inv(spark, d):
    """There and back again is the identity on 8-bit colours, which is what the SQL states."""
    return lch(spark, d).select("pixel_id", C.hex_of(*C.oklab_to_srgb(F.col("l"), F.col("ok_a"), F.col("ok_b"))).alias("hex"))


@query("f_srgb_to_hex", f"WITH {O.PIXEL} SELECT r, g, b, '#' || printf('%02X%02X%02X', r, g, b) AS hex, CAST(count(*) AS BIGINT) AS n FROM pixel GROUP BY r, g, b")
def f_srgb_to_hex(spark, d):
    return pixels(spark, d).groupBy("r", "g", "b").agg(F.count("*").alias("n")).select("r", "g", "b", C.hex_of(*(C.unit(x) for x in "rgb")).alias("hex"), "n")


@query("f_hex_to_srgb", f"WITH {O.PIXEL} SELECT pixel_id, round(r / 255.0, 6) AS red, round(g / 255.0, 6) AS green, round(b / 255.0, 6) AS blue FROM pixel")
def f_hex_to_srgb(spark, d):
    text = C.hex_of(*(C.unit(x) for x in "rgb"))
    return pixels(spark, d).select("pixel_id", text.alias("t")).select("pixel_id", *(r6(C.hex_channel(F.col("t"), k), n) for k, n in enumerate(("red", "green", "blue"))))


@query("f_srgb_linear", f"WITH {O.PIXEL} SELECT pixel_id, round({O.linear('r / 255.0')}, 6) AS red, round({O.linear('g / 255.0')}, 6) AS green, round(b / 255.0, 6) AS back FROM pixel")
def f_srgb_linear(spark, d):
    return pixels(spark, d).select("pixel_id", r6(C.to_linear(C.unit("r")), "red"), r6(C.to_linear(C.unit("g")), "green"), r6(C.from_linear(C.to_linear(C.unit("b"))), "back"))


_REACH_SQL = "CASE " + " ".join(f"WHEN k <= {hi[0]} THEN {{{n}}}" for n, hi in enumerate(M.REACH[1:])) + " END"


def _reach_sql(k: int) -> str:
    return _REACH_SQL.format(*(f"{lo[k]!r} + (k - {lo[0]}) / {float(hi[0] - lo[0])!r} * ({hi[k]!r} - {lo[k]!r})" for lo, hi in zip(M.REACH, M.REACH[1:], strict=False)))


@query("f_reach_interp", f"SELECT p_partkey, round({_reach_sql(1)}, 6) AS hue, round({_reach_sql(2)}, 6) AS chroma, round({_reach_sql(3)}, 6) AS lightness FROM (SELECT p_partkey, least(100, greatest(0, p_partkey % 131 - 15)) AS k FROM part)")
def f_reach_interp(spark, d):
    reach = F.col("p_partkey") % 131 - 15
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *(r6(M.reach_tolerance(reach, k), n) for k, n in ((1, "hue"), (2, "chroma"), (3, "lightness"))))


@query("f_hue_distance", "SELECT event_id, round(least(abs(p - q) % 360, 360 - abs(p - q) % 360), 6) AS distance, round(atan2(sin(radians(p - q)), cos(radians(p - q))), 6) AS signed FROM (SELECT event_id, CAST(event_id % 367 AS DOUBLE) AS p, CAST((event_id * 7 + user_id) % 359 AS DOUBLE) + 0.25 AS q FROM events)")
def f_hue_distance(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 367).cast("double").alias("p"), ((F.col("event_id") * 7 + F.col("user_id")) % 359 + 0.25).cast("double").alias("q"))
    return ev.select("event_id", r6(C.hue_distance(F.col("p"), F.col("q")), "distance"), r6(C.hue_difference(F.radians("p"), F.radians("q")), "signed"))


@query("f_hue_confidence", f"{CTE} SELECT pixel_id, round(least(1.0, greatest(0.0, c / 0.05)), 5) AS confidence FROM lab")
def f_hue_confidence(spark, d):
    return lch(spark, d).select("pixel_id", F.round(C.hue_confidence(F.col("c")), 5).alias("confidence"))


@query("f_delta_e", f"{CTE} SELECT p.pixel_id, round(sqrt(pow(p.l - q.l, 2) + pow(p.ok_a - q.ok_a, 2) + pow(p.ok_b - q.ok_b, 2)), 6) AS delta FROM lab p JOIN lab q ON q.pixel_id = p.pixel_id + 1")
def f_delta_e(spark, d):
    lab = lch(spark, d).select("pixel_id", "l", "ok_a", "ok_b")
    nxt = lab.select((F.col("pixel_id") - 1).alias("pixel_id"), *(F.col(c).alias(c + "2") for c in ("l", "ok_a", "ok_b")))
    delta = F.sqrt(C.distance_sq((F.col("l"), F.col("ok_a"), F.col("ok_b")), (F.col("l2"), F.col("ok_a2"), F.col("ok_b2"))))
    return lab.join(nxt, "pixel_id").select("pixel_id", r6(delta, "delta"))


_SCORES = ", ".join(f"round({O.claim_score(e)}, 5) AS score_{e.id}" for e in PINNED)


@query("f_claim_score", f"{CTE} SELECT pixel_id, {_SCORES} FROM lab")
def f_claim_score(spark, d):
    px = lch(spark, d)
    return px.select("pixel_id", *(F.round(M.claim_score(F.col("l"), F.col("c"), F.col("h"), e), 5).alias(f"score_{e.id}") for e in PINNED))


@query("flt_reach", f"{CTE} SELECT pixel_id, " + ", ".join(f"({O.claim_score(e)}) IS NOT NULL AS in_{e.id}" for e in PINNED) + " FROM lab")
def flt_reach(spark, d):
    px = lch(spark, d)
    return px.select("pixel_id", *(M.claim_score(F.col("l"), F.col("c"), F.col("h"), e).isNotNull().alias(f"in_{e.id}") for e in PINNED))


@query("j_claim", f"{CTE},\n{O.claim_ctes(PALETTE)} SELECT pixel_id, winner FROM claimed")
def j_claim(spark, d):
    return M.claims(pixels(spark, d), PALETTE).select("pixel_id", "winner")


@query("j_claim_ids", f"{CTE},\n{O.claim_ctes(PALETTE)} SELECT pixel_id, CASE " + " ".join(f"WHEN winner = {k} THEN '{e.id}'" for k, e in enumerate(PINNED)) + " END AS entry FROM claimed")
def j_claim_ids(spark, d):
    names = spark.createDataFrame([(k, e.id) for k, e in enumerate(PINNED)], "winner int, entry string")
    return M.claims(pixels(spark, d), PALETTE).join(F.broadcast(names), "winner", "left").select("pixel_id", "entry")


@query("agg_claim_pct", f"{CTE},\n{O.claim_ctes(PALETTE)} SELECT e.id AS entry, round(count(c.pixel_id) * 100.0 / (SELECT count(*) FROM pixel), 6) AS percent FROM (VALUES " + ", ".join(f"({k}, '{e.id}')" for k, e in enumerate(PINNED)) + ") AS e(k, id) LEFT JOIN claimed c ON c.winner = e.k GROUP BY e.id")
def agg_claim_pct(spark, d):
    counts = M.claims(pixels(spark, d), PALETTE).groupBy("winner").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    names = spark.createDataFrame([(k, e.id) for k, e in enumerate(PINNED)], "winner int, entry string")
    return F.broadcast(names).join(counts, "winner", "left").crossJoin(F.broadcast(total)).select("entry", r6(F.coalesce("n", F.lit(0)) * 100.0 / F.col("total"), "percent"))


@query("j_nearest", f"{CTE} SELECT pixel_id, {O.nearest([e.lab() for e in PALETTE])} AS centre FROM lab")
def j_nearest(spark, d):
    return lch(spark, d).select("pixel_id", M.nearest((F.col("l"), F.col("ok_a"), F.col("ok_b")), [e.lab() for e in PALETTE]).alias("centre"))


@query("j_nearest_policy", f"{CTE},\n{O.owner_ctes(PALETTE)} SELECT pixel_id, owner FROM owned")
def j_nearest_policy(spark, d):
    return M.ownership(pixels(spark, d), PALETTE).select("pixel_id", "owner")


_SHARE = f"{CTE},\n{O.owner_ctes(PALETTE)} SELECT owner, CAST(count(*) AS BIGINT) AS pixels, round(count(*) * 100.0 / (SELECT count(*) FROM pixel), 6) AS percent FROM owned WHERE owner IS NOT NULL GROUP BY owner"


@query("agg_coverage_pct", f"{CTE},\n{O.owner_ctes(PALETTE)} SELECT image_id, owner, CAST(count(*) AS BIGINT) AS pixels, round(count(*) * 100.0 / any_value(n), 6) AS percent FROM owned JOIN (SELECT image_id, count(*) AS n FROM pixel GROUP BY image_id) USING (image_id) WHERE owner IS NOT NULL GROUP BY image_id, owner")
def agg_coverage_pct(spark, d):
    """Share of each image that a palette colour owns."""
    owned = M.ownership(pixels(spark, d), PALETTE).groupBy("image_id", "owner").agg(F.count("*").alias("pixels"))
    share = F.col("pixels") * 100.0 / F.sum("pixels").over(Window.partitionBy("image_id"))
    return owned.select("image_id", "owner", "pixels", r6(share, "percent")).where("owner IS NOT NULL")


@query("share_per_colour", _SHARE)
def share_per_colour(spark, d):
    """Share of the picture per palette colour: claims, then nearest, then coverage."""
    owned = M.ownership(pixels(spark, d), PALETTE).groupBy("owner").agg(F.count("*").alias("pixels"))
    total = owned.agg(F.sum("pixels").alias("total"))
    return owned.crossJoin(F.broadcast(total)).where("owner IS NOT NULL").select("owner", "pixels", r6(F.col("pixels") * 100.0 / F.col("total"), "percent"))


@query("agg_border_share", f"{CTE},\n{O.owner_ctes(PALETTE)},\n{O.FRAME},\nring AS (SELECT image_id, owner FROM owned WHERE y = 0 UNION ALL SELECT image_id, owner FROM owned JOIN frame USING (image_id) WHERE y = high - 1 UNION ALL SELECT image_id, owner FROM owned WHERE x = 0 UNION ALL SELECT image_id, owner FROM owned WHERE x = 99) SELECT image_id, owner, CAST(count(*) AS BIGINT) AS border, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY image_id), 6) AS percent FROM ring GROUP BY image_id, owner")
def agg_border_share(spark, d):
    """Corners count twice: rows and columns of each image's frame are added up."""
    px = pixels(spark, d)
    sides = sum(((c).cast("int") for c in (F.col("y") == F.col("height") - 1, F.col("x") == 0, F.col("x") == F.col("width") - 1)), (F.col("y") == 0).cast("int"))
    ring = M.ownership(px, PALETTE).join(frames(px), "image_id").select("image_id", "owner", sides.alias("sides")).where("sides > 0").groupBy("image_id", "owner").agg(F.sum("sides").alias("border"))
    share = F.col("border") * 100.0 / F.sum("border").over(Window.partitionBy("image_id"))
    return ring.select("image_id", "owner", "border", r6(share, "percent"))


@query("flt_alpha", f"WITH {O.PIXEL} SELECT pixel_id, a FROM pixel WHERE a / 255.0 >= 0.05")
def flt_alpha(spark, d):
    return pixels(spark, d).where(F.col("a") / 255.0 >= 0.05).select("pixel_id", "a")


@query("flt_unclaimed", f"{CTE},\n{O.claim_ctes(PALETTE)} SELECT pixel_id FROM claimed WHERE winner < 0 AND a / 255.0 >= 0.05")
def flt_unclaimed(spark, d):
    return M.claims(pixels(spark, d), PALETTE).where((F.col("winner") < 0) & (F.col("a") / 255.0 >= 0.05)).select("pixel_id")


@query("agg_hist_app", f"WITH {O.PIXEL} SELECT ((r >> 2) << 12) + ((g >> 2) << 6) + (b >> 2) AS bin, CAST(trunc((r >> 2) / 63.0 * 255) * 65536 + trunc((g >> 2) / 63.0 * 255) * 256 + trunc((b >> 2) / 63.0 * 255) AS BIGINT) AS packed, CAST(count(*) AS BIGINT) AS weight FROM pixel WHERE a / 255.0 >= 0.05 GROUP BY r >> 2, g >> 2, b >> 2")
def agg_hist_app(spark, d):
    """Six-bit histogram; the packed colour truncates, as the bins' colours do in the reference semantics."""
    px = pixels(spark, d).where(F.col("a") / 255.0 >= 0.05)
    bins = px.select(*(F.shiftright(c, 2).alias(c) for c in "rgb")).groupBy("r", "g", "b").agg(F.count("*").alias("weight"))
    whole = [(F.col(c) / F.lit(63.0) * 255).cast("long") for c in "rgb"]
    return bins.select((F.shiftleft("r", 12) + F.shiftleft("g", 6) + F.col("b")).alias("bin"), (whole[0] * 65536 + whole[1] * 256 + whole[2]).alias("packed"), "weight")


@query("agg_unique_colors", f"WITH {O.PIXEL} SELECT r, g, b, CAST(count(*) AS BIGINT) AS n FROM pixel GROUP BY r, g, b")
def agg_unique_colors(spark, d):
    return pixels(spark, d).groupBy("r", "g", "b").agg(F.count("*").alias("n"))


@query("agg_hist_engine", f"{ECTE} SELECT CAST(round(r * 31 / 255.0) * 1024 + round(g * 31 / 255.0) * 32 + round(b * 31 / 255.0) AS BIGINT) AS bucket, round(avg(l), 6) AS l, round(avg(ok_a), 6) AS ok_a, round(avg(ok_b), 6) AS ok_b, CAST(count(*) AS BIGINT) AS weight FROM lab GROUP BY bucket")
def agg_hist_engine(spark, d):
    l, a, b = C.oklab(*(C.unit(x) for x in "rgb"), "engine")
    five = [F.round(F.col(c) * 31 / 255.0).cast("long") for c in "rgb"]
    px = pixels(spark, d).select((five[0] * 1024 + five[1] * 32 + five[2]).alias("bucket"), l.alias("l"), a.alias("ok_a"), b.alias("ok_b"))
    return px.groupBy("bucket").agg(r6(F.avg("l"), "l"), r6(F.avg("ok_a"), "ok_a"), r6(F.avg("ok_b"), "ok_b"), F.count("*").alias("weight"))


CENTRES = [(0.55, 0.15, 0.08), (0.45, 0.02, -0.18), (0.72, -0.09, 0.09), (0.9, 0.0, 0.01)]
_CENTRE_VALUES = ", ".join(f"({k}, {l!r}, {a!r}, {b!r})" for k, (l, a, b) in enumerate(CENTRES))


@query("j_snap", f"""WITH {O.PIXEL}, colours AS (SELECT r, g, b, count(*) AS n FROM pixel GROUP BY r, g, b),
{O.lab('colours')}, pairs AS (SELECT k, r, g, b, n, pow(l - cl, 2) + pow(ok_a - ca, 2) + pow(ok_b - cb, 2) AS d FROM lab, (VALUES {_CENTRE_VALUES}) AS t(k, cl, ca, cb)),
near AS (SELECT *, min(d) OVER (PARTITION BY k) AS m FROM pairs),
pick AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, r * 65536 + g * 256 + b) AS rank FROM near WHERE d <= m + 1e-12)
SELECT CAST(k AS BIGINT) AS centre, '#' || printf('%02X%02X%02X', r, g, b) AS hex FROM pick WHERE rank = 1""")
def j_snap(spark, d):
    """Every centre becomes the nearest colour that the picture has; ties by count, then colour.
    Nearest candidates are found by aggregation, so no window holds all colours in one task."""
    colours = M.with_lch(pixels(spark, d).groupBy("r", "g", "b").agg(F.count("*").alias("n")))
    at = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("centre"), C.distance_sq((F.col("l"), F.col("ok_a"), F.col("ok_b")), tuple(F.lit(v) for v in c)).alias("d")) for k, c in enumerate(CENTRES)]))
    pairs = colours.select("r", "g", "b", "n", at.alias("t")).select("r", "g", "b", "n", "t.*")
    least = pairs.groupBy("centre").agg(F.min("d").alias("m"))
    best = pairs.join(F.broadcast(least), "centre").where(F.col("d") <= F.col("m") + 1e-12).groupBy("centre").agg(F.min(F.struct(-F.col("n"), F.col("r"), F.col("g"), F.col("b"))).alias("p"))
    return best.select("centre", C.hex_of(*(F.col(f"p.{c}") / 255.0 for c in "rgb")).alias("hex"))


@query("j_nearest_source", f"WITH {O.PIXEL}, c AS (SELECT DISTINCT r, g, b FROM pixel) SELECT r, g, b FROM c ORDER BY pow(r - 130, 2) + pow(g - 90, 2) + pow(b - 60, 2), r, g, b LIMIT 1")
def j_nearest_source(spark, d):
    gap = (F.col("r") - 130) * (F.col("r") - 130) + (F.col("g") - 90) * (F.col("g") - 90) + (F.col("b") - 60) * (F.col("b") - 60)
    return pixels(spark, d).select("r", "g", "b").distinct().agg(F.min(F.struct(gap, F.col("r"), F.col("g"), F.col("b"))).alias("p")).select("p.r", "p.g", "p.b")


_WINDOW = f"WITH {O.PIXEL}, win AS (SELECT * FROM pixel WHERE abs(x - 40) <= {{0}} AND abs(y - 5) <= {{0}})"


@query("win_sample_exact", f"WITH {O.PIXEL} SELECT image_id, r, g, b FROM pixel WHERE x = 40 AND y = 5")
def win_sample_exact(spark, d):
    """The pixel picked at (40, 5), in every image."""
    return pixels(spark, d).where("x = 40 AND y = 5").select("image_id", "r", "g", "b")


_REPRESENT = "med AS (SELECT image_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM win GROUP BY image_id) SELECT image_id, r, g, b FROM win JOIN med USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2), pixel_id) = 1"


def represent(window):
    """Of each image the real pixel nearest the median of each channel, first in raster order."""
    mid = window.groupBy("image_id").agg(*(F.median(c).alias("m" + c) for c in "rgb"))
    gap = sum(((F.col(c) - F.col("m" + c)) * (F.col(c) - F.col("m" + c)) for c in "gb"), (F.col("r") - F.col("mr")) * (F.col("r") - F.col("mr")))
    return window.join(mid, "image_id").groupBy("image_id").agg(F.min_by(F.struct("r", "g", "b"), F.struct(gap, F.col("pixel_id"))).alias("p")).select("image_id", "p.r", "p.g", "p.b")


@query("win_sample_5x5", f"{_WINDOW.format(2)}, {_REPRESENT}")
def win_sample_5x5(spark, d):
    return represent(pixels(spark, d).where("abs(x - 40) <= 2 AND abs(y - 5) <= 2"))


@query("agg_median_pixel", f"{_WINDOW.format(2)} SELECT image_id, round(median(r), 3) AS r, round(median(g), 3) AS g, round(median(b), 3) AS b FROM win GROUP BY image_id")
def agg_median_pixel(spark, d):
    return pixels(spark, d).where("abs(x - 40) <= 2 AND abs(y - 5) <= 2").groupBy("image_id").agg(*(F.round(F.median(c), 3).alias(c) for c in "rgb"))


def bucket():
    five = [F.round(F.col(c) * 31 / 255.0).cast("long") for c in "rgb"]
    return five[0] * 1024 + five[1] * 32 + five[2]


_BUCKET = "CAST(round(r * 31 / 255.0) * 1024 + round(g * 31 / 255.0) * 32 + round(b * 31 / 255.0) AS BIGINT) AS bucket"


def commonest(win):
    """(image_id, bucket, n) of each image's commonest bucket, the lowest on ties."""
    counts = win.groupBy("image_id", "bucket").agg(F.count("*").alias("n"))
    return counts.groupBy("image_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "bucket")).alias("p")).select("image_id", "p.bucket", (-F.col("p.n")).alias("n"))


@query("agg_mode_bucket", f"{_WINDOW.format(7)}, c AS (SELECT image_id, {_BUCKET}, CAST(count(*) AS BIGINT) AS n FROM win GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bucket) = 1")
def agg_mode_bucket(spark, d):
    return commonest(pixels(spark, d).where("abs(x - 40) <= 7 AND abs(y - 5) <= 7").withColumn("bucket", bucket()))


@query("win_sample_15x15", f"WITH {O.PIXEL}, zone0 AS (SELECT *, {_BUCKET} FROM pixel WHERE abs(x - 40) <= 7 AND abs(y - 5) <= 7), counts AS (SELECT image_id, bucket, count(*) AS n FROM zone0 GROUP BY ALL), top AS (SELECT image_id, bucket FROM counts QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bucket) = 1), win AS (SELECT zone0.* FROM zone0 SEMI JOIN top USING (image_id, bucket)), {_REPRESENT}")
def win_sample_15x15(spark, d):
    win = pixels(spark, d).where("abs(x - 40) <= 7 AND abs(y - 5) <= 7").withColumn("bucket", bucket())
    return represent(win.join(commonest(win), ["image_id", "bucket"], "left_semi"))


@query("srt_hist", f"WITH {O.PIXEL}, c AS (SELECT r * 65536 + g * 256 + b AS packed, count(*) AS n FROM pixel GROUP BY packed) SELECT packed, CAST(n AS BIGINT) AS weight, CAST(row_number() OVER (ORDER BY n DESC, packed) AS BIGINT) AS place FROM c")
def srt_hist(spark, d):
    """All colours, the commonest first, lower packed values on ties."""
    n = pixels(spark, d).groupBy((F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("packed")).agg(F.count("*").alias("weight"))
    return ranked(n, F.desc("weight"), F.col("packed"))


@query("f_linear_srgb", f"WITH {O.PIXEL} SELECT pixel_id, round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END, 6) AS encoded FROM (SELECT pixel_id, r / 255.0 * 0.5 AS v FROM pixel)")
def f_linear_srgb(spark, d):
    return pixels(spark, d).select("pixel_id", r6(C.from_linear(C.unit("r") * 0.5), "encoded"))


@query("f_oklch_to_oklab_image", f"{CTE} SELECT pixel_id, round(l, 6) AS l, round(c * cos(radians(h)), 6) AS ok_a, round(c * sin(radians(h)), 6) AS ok_b FROM lab")
def f_oklch_to_oklab_image(spark, d):
    """A stored plane of lightness, chroma and hue (degrees) back to OKLab."""
    stored = lch(spark, d).select("pixel_id", "l", "c", "h")
    return stored.select("pixel_id", r6(F.col("l"), "l"), *(r6(v, n) for v, n in zip(C.polar_to_lab(F.col("c"), F.col("h")), ("ok_a", "ok_b"), strict=True)))


_D50 = (0.3457 / 0.3585, 1.0, (1.0 - 0.3457 - 0.3585) / 0.3585)


@query("f_lab", "WITH s AS (SELECT p_partkey, p_size * 2.0 AS cl, p_size - 25.0 AS ca, p_size % 7 * 9.0 - 30 AS cb FROM part), f AS (SELECT *, (cl + 16) / 116 AS fy FROM s), g AS (SELECT *, fy + ca / 500 AS fx, fy - cb / 200 AS fz FROM f), x AS (SELECT p_partkey, " + ", ".join(f"{w!r} * CASE WHEN pow({v}, 3) > 216 / 24389.0 THEN pow({v}, 3) ELSE (116 * {v} - 16) / (24389 / 27.0) END AS {n}" for v, w, n in (("fx", _D50[0], "px"), ("fy", 1.0, "py"), ("fz", _D50[2], "pz"))) + " FROM g), l AS (SELECT p_partkey, " + ", ".join(f"least(1, greatest(0, CASE WHEN {e} <= 0.0031308 THEN {e} * 12.92 ELSE 1.055 * pow({e}, 1 / 2.4) - 0.055 END)) AS {n}" for e, n in zip(("(" + " + ".join(f"({k!r}) * {v}" for k, v in zip(row, ("px", "py", "pz"))) + ")" for row in C.FROM_XYZ_D50), ("red", "green", "blue"))) + " FROM x) SELECT p_partkey, round(red, 5) AS red, round(green, 5) AS green, round(blue, 5) AS blue FROM l")
def f_lab(spark, d):
    """CSS Lab colours (D50) as sRGB."""
    part = spark.read.parquet(f"{d}/part.parquet")
    rgb = C.lab_to_srgb(F.col("p_size") * 2.0, F.col("p_size") - 25.0, F.col("p_size") % 7 * 9.0 - 30)
    return part.select("p_partkey", *(F.round(v, 5).alias(n) for v, n in zip(rgb, ("red", "green", "blue"), strict=True)))


_HSL = "CASE WHEN s = 0 THEN 0 WHEN t = r / 255.0 THEN CASE WHEN g >= b THEN 60 * ((g - b) / 255.0 / s) ELSE 60 * ((g - b) / 255.0 / s + 6) END WHEN t = g / 255.0 THEN 60 * ((b - r) / 255.0 / s + 2) ELSE 60 * ((r - g) / 255.0 / s + 4) END"


@query("f_hsl", f"WITH {O.PIXEL}, m AS (SELECT *, greatest(r, g, b) / 255.0 AS t, least(r, g, b) / 255.0 AS o, greatest(r, g, b) / 255.0 - least(r, g, b) / 255.0 AS s FROM pixel) SELECT pixel_id, round({_HSL}, 5) AS hue, round(CASE WHEN s = 0 THEN 0 ELSE 100 * s / (1 - abs(t + o - 1)) END, 5) AS saturation, round(50 * (t + o), 5) AS lightness FROM m")
def f_hsl(spark, d):
    return pixels(spark, d).select("pixel_id", *(F.round(c, 5).alias(n) for c, n in zip(C.hsl(*(C.unit(x) for x in "rgb")), ("hue", "saturation", "lightness"), strict=True)))


@query("f_hsv", f"WITH {O.PIXEL}, m AS (SELECT *, greatest(r, g, b) / 255.0 AS t, greatest(r, g, b) / 255.0 - least(r, g, b) / 255.0 AS s FROM pixel) SELECT pixel_id, round({_HSL}, 5) AS hue, round(CASE WHEN t = 0 THEN 0 ELSE 100 * s / t END, 5) AS saturation, round(100 * t, 5) AS brightness FROM m")
def f_hsv(spark, d):
    return pixels(spark, d).select("pixel_id", *(F.round(c, 5).alias(n) for c, n in zip(C.hsv(*(C.unit(x) for x in "rgb")), ("hue", "saturation", "brightness"), strict=True)))


@query("f_cmyk", f"WITH {O.PIXEL}, m AS (SELECT *, greatest(r, g, b) / 255.0 AS t FROM pixel) SELECT pixel_id, round((t - r / 255.0) / t, 6) AS cyan, round((t - g / 255.0) / t, 6) AS magenta, round((t - b / 255.0) / t, 6) AS yellow, round(1 - t, 6) AS black FROM m")
def f_cmyk(spark, d):
    return pixels(spark, d).select("pixel_id", *(r6(c, n) for c, n in zip(C.cmyk(*(C.unit(x) for x in "rgb")), ("cyan", "magenta", "yellow", "black"), strict=True)))


# ------------------------------------------------- iterative: no SQL form ----
@query("g_kmeans_app")
def g_kmeans_app(spark, d):
    from tessera.operators.palettes import kmeans

    return spark.createDataFrame([(k, *r) for k, r in enumerate(kmeans(pixels(spark, d).where("a > 12"), 6))], "centre int, l double, a double, b double, pixels long")


@query("g_palette_engine")
def g_palette_engine(spark, d):
    from tessera.operators.palettes import engine_palette

    return spark.createDataFrame([(k, *r) for k, r in enumerate(engine_palette(pixels(spark, d).where("a > 0"), 6))], "centre int, l double, a double, b double, pixels long")


@query("top_farthest")
def top_farthest(spark, d):
    from tessera.operators.palettes import bins, seeds

    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(seeds(*bins(pixels(spark, d)), 8, 0.02))], "place int, l double, a double, b double")


@query("top_farthest_engine")
def top_farthest_engine(spark, d):
    from tessera.operators.palettes import bins, seeds

    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(seeds(*bins(pixels(spark, d), "engine"), 8))], "place int, l double, a double, b double")


@query("agg_kmeans_update", f"{CTE}, near AS (SELECT *, {O.nearest(CENTRES)} AS centre FROM lab) SELECT CAST(centre AS BIGINT) AS centre, round(avg(l), 6) AS l, round(avg(ok_a), 6) AS ok_a, round(avg(ok_b), 6) AS ok_b, CAST(count(*) AS BIGINT) AS n FROM near GROUP BY centre")
def agg_kmeans_update(spark, d):
    """One round of means: each pixel to its nearest centre, then one aggregation."""
    px = lch(spark, d).withColumn("centre", M.nearest((F.col("l"), F.col("ok_a"), F.col("ok_b")), CENTRES).cast("long"))
    return px.groupBy("centre").agg(r6(F.avg("l"), "l"), r6(F.avg("ok_a"), "ok_a"), r6(F.avg("ok_b"), "ok_b"), F.count("*").alias("n"))


@query("st_incremental_hist", f"WITH {O.PIXEL} SELECT ((r >> 2) << 12) + ((g >> 2) << 6) + (b >> 2) AS bin, CAST(count(*) AS BIGINT) AS weight FROM pixel GROUP BY 1")
def st_incremental_hist(spark, d):
    from tessera.streaming.histogram import binned

    return binned(pixels(spark, d))
