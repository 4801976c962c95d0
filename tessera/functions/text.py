"""Text, path and settings scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_PIXELS = 1_000_000


def mm_to_px(v: Column) -> Column:
    return v / 25.4 * 96


def preview_scale(pixels: Column, budget: int = PREVIEW_PIXELS) -> Column:
    return F.when(pixels <= budget, 1.0).otherwise(F.sqrt(F.lit(float(budget)) / pixels))


def scale_fields(profile: Column, factor: Column) -> Column:
    """Values of a map of doubles, scaled by what the key's suffix says (…Px2 before …Px)."""
    return F.transform_values(profile, lambda k, v: F.when(F.endswith(k, F.lit("Px2")), v * factor * factor).when(F.endswith(k, F.lit("Px")), v * factor).otherwise(v))


def coordinate(v: Column, places: int) -> Column:
    """Fixed decimals without trailing zeros or a negative zero."""
    fixed = F.format_string(f"%.{places}f", v)
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short.isin("-0", ""), "0").otherwise(short)


def escape_xml(v: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        v = F.replace(v, F.lit(plain), F.lit(safe))
    return v


def rectangle_path(width: Column, height: Column) -> Column:
    return F.format_string("M 0 0 L %d 0 L %d %d L 0 %d Z", width, width, height, height)


def normalize_path(markup: Column) -> Column:
    """Path data of an element, commands and numbers set apart by one space."""
    data = F.regexp_replace(markup, '^.*d="([^"]*)".*$', "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(data, "([MLHVCSQTAZmlhvcsqtaz])", " $1 "), "[, ]+", " "))


def path_valid(path: Column, rule: Column) -> Column:
    """A path that is not blank, has a command and only finite numbers, under a fill rule that exists."""
    numbers = F.regexp_extract_all(path, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), 1)
    finite = F.forall(numbers, lambda n: F.abs(n.cast("double")) < float("inf"))
    return (F.trim(path) != "") & path.rlike("[MLCSQTAHVZmlcsqtahvz]") & finite & rule.isin("nonzero", "evenodd")


def mime_type(declared: Column) -> Column:
    """A declared type without its parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(F.coalesce(declared, F.lit("")), ";", 1)))


def working_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """The size of an image once it has at most so many pixels: both sides scaled alike and cut to whole ones."""
    factor = F.sqrt(F.lit(float(most)) / (width * height))
    side = lambda v: F.when(width * height > most, F.greatest(F.floor(v * factor), F.lit(1))).otherwise(v).cast("long")
    return side(width), side(height)


def display_name(v: Column) -> Column:
    """What is left of a file's name once its folders, control characters and characters that no file system likes are gone; "image" if nothing."""
    base = F.regexp_replace(F.replace(F.coalesce(v, F.lit("")), F.lit("\\"), F.lit("/")), "^.*/", "")
    kept = F.regexp_replace(base, r'[<>:"|?*\p{C}\p{Zl}\p{Zp}\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]', "")
    short = F.substring(F.trim(kept), 1, 120)
    return F.when(short == "", "image").otherwise(short)


def css_hex(v: Column) -> Column:
    """#RRGGBB of hex (3, 4, 6 or 8 digits, alpha dropped) and rgb() colours; null otherwise."""
    v = F.lower(F.trim(v))
    digits = F.regexp_extract(v, "^#([0-9a-f]{3,8})$", 1)
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(digits, k, 1), 2) for k in (1, 2, 3)])
    number = lambda k: F.least(F.regexp_extract(v, r"^rgba?\(\s*(\d+)[\s,]+(\d+)[\s,]+(\d+)", k).try_cast("int"), F.lit(255))
    rgb = F.concat(F.lit("#"), *[F.lpad(F.hex(number(k)), 2, "0") for k in (1, 2, 3)])
    return F.upper(F.when(F.length(digits).isin(6, 8), F.concat(F.lit("#"), F.substring(digits, 1, 6))).when(F.length(digits).isin(3, 4), short).when(F.startswith(v, F.lit("rgb")), rgb))


def merge_maps(base: Column, over: Column) -> Column:
    """Keys of base, with the values of over where it has them."""
    return F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))


def svg_ok(v: Column) -> Column:
    """What can be told of an SVG text without a parser: how it starts and ends, brackets that balance, no number that is not finite, no script."""
    ends = F.startswith(F.regexp_replace(v, r"^\s+", ""), F.lit("<svg")) & F.endswith(F.regexp_replace(v, r"\s+$", ""), F.lit("</svg>"))
    balanced = F.length(F.regexp_replace(v, "[^<]", "")) == F.length(F.regexp_replace(v, "[^>]", ""))
    return ends & balanced & ~F.contains(v, F.lit("NaN")) & ~F.contains(v, F.lit("Infinity")) & ~F.contains(v, F.lit("<script"))


def scale_path(path: Column, factor: Column) -> Column:
    """A path with every length times factor, at three decimals without trailing zeros; an arc's angle and flags stay.
    factor 1 leaves the text alone."""
    token = r"[A-Za-z]|[-+]?(?:\d*\.\d+|\d+\.?)(?:[eE][-+]?\d+)?"
    start = F.struct(F.lit("").alias("command"), F.lit(0).alias("place"), F.array().cast("array<string>").alias("out"))

    def put(state: Column, t: Column) -> Column:
        letter = t.rlike("^[A-Za-z]$")
        # of an arc's seven parameters the third to fifth are an angle and two flags
        kept = state["command"].isin("A", "a") & (state["place"] % 7).isin(2, 3, 4)
        scaled = coordinate(t.try_cast("double") * factor, 3)
        text = F.when(letter | kept, t).otherwise(scaled)
        return F.struct(F.when(letter, t).otherwise(state["command"]).alias("command"), F.when(letter, 0).otherwise(state["place"] + 1).alias("place"), F.concat(state["out"], F.array(text)).alias("out"))

    folded = F.aggregate(F.regexp_extract_all(path, F.lit(f"({token})"), 1), start, put, lambda s: F.array_join(s["out"], " "))
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(factor == 1.0, path).otherwise(folded)


def parse_hex(v: Column) -> Column:
    """#RRGGBBAA of #RGB, #RGBA, #RRGGBB and #RRGGBBAA, upper case; null otherwise."""
    digits = F.upper(F.regexp_extract(v, "^#([0-9A-Fa-f]+)$", 1))
    twice = F.concat(*[F.repeat(F.substring(digits, k, 1), 2) for k in (1, 2, 3, 4)])
    size = F.length(digits)
    return F.concat(F.lit("#"), F.when(size == 3, F.concat(F.substring(twice, 1, 6), F.lit("FF"))).when(size == 4, twice).when(size == 6, F.concat(digits, F.lit("FF"))).when(size == 8, digits))


def export_name(image: Column) -> Column:
    """The name suggested for a result: the image's, without its last suffix."""
    stem = F.regexp_replace(F.when(F.coalesce(image, F.lit("")) == "", "palette-trace").otherwise(image), r"\.[^.]*$", "")
    return F.concat(F.when(stem == "", "palette-trace").otherwise(stem), F.lit(".palette-trace.svg"))


def island_summary(holes: Column, layers: Column) -> Column:
    """One sentence on what became of the backdrop's patches, empty if there are none."""
    total = holes + layers
    one = F.concat(F.lit("One patch of the backdrop colour sits in the foreground \u2014 "), F.when(holes > 0, "it became a hole").otherwise("it got a layer of its own"), F.lit("."))
    many = F.concat(total.cast("string"), F.lit(" patches of the backdrop colour sit in the foreground \u2014 "))
    of_holes = F.when(holes == 1, "1 became a hole").otherwise(F.concat(holes.cast("string"), F.lit(" became holes")))
    of_layers = F.when(layers == 1, "1 got a layer of its own").otherwise(F.concat(layers.cast("string"), F.lit(" got layers of their own")))
    outcome = F.when((holes > 0) & (layers > 0), F.concat(of_holes, F.lit(", "), of_layers)).when(holes > 0, "they became holes").otherwise("they got layers of their own")
    return F.when(total == 0, "").when(total == 1, one).otherwise(F.concat(many, outcome, F.lit(".")))


def opened(name: Column, suffixes: tuple) -> Column:
    """Whether a path ends in one of the suffixes, in whatever case."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*suffixes)


def linked(href: Column, folder: Column) -> Column:
    """Where a link leads: "data", a path (relative ones from the document's folder), or why it is refused."""
    path = F.regexp_replace(href, "^file://", "")
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "refused: missing").when(F.startswith(F.lower(href), F.lit("data:")), "data").when(F.lower(href).rlike("^https?:"), "refused: remote")
        .when(F.startswith(path, F.lit("/")), path).when(folder.isNull(), "refused: unsaved").otherwise(F.concat(folder, F.lit("/"), path))
    )
