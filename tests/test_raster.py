import pytest

from tessera.operators import masks as K
from tessera.operators.matching import Entry, tolerances
from tessera.sources.raster import decode_netpbm, read_netpbm


def test_netpbm_both_kinds(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"P6 # note\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.pam").write_bytes(b"P7\nWIDTH 1\nHEIGHT 2\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + bytes(range(8)))
    got = read_netpbm(spark, str(tmp_path)).orderBy("image_id", "pixel_id").collect()
    assert sorted((r.x, r.y, r.r, r.g, r.b, r.a) for r in got) == sorted([(0, 0, 1, 2, 3, 255), (1, 0, 4, 5, 6, 255), (0, 0, 0, 1, 2, 3), (0, 1, 4, 5, 6, 7)])


@pytest.mark.parametrize("raw", [b"P5 1 1 255\n\0", b"P6 2 2 255\n\0", b"P6 0 1 255\n", b"P6 1 1 65535\n\0\0\0"])
def test_netpbm_refuses(raw):
    with pytest.raises(ValueError):
        decode_netpbm(raw)


def test_small_disc_changes_nothing():
    assert K.disc(0.5) == [(0, 0)] == K.disc(0.945)
    assert len(K.disc(1)) == 5


def test_reach_anchors():
    assert tolerances(25) == pytest.approx((10.0, 0.035, 0.06))
    assert tolerances(-3) == tolerances(0) and tolerances(900) == tolerances(100)
    assert Entry("n", "#808080").lch()[1] < 0.02


PICTURE = ["XX..X", ".X.XX", "X...X", "XXX.X"]


def planes(spark, *pictures):
    """(mask, all pixels) of pictures drawn with X, an image for each."""
    cells = [(k, x, y, c) for k, rows in enumerate(pictures) for y, row in enumerate(rows) for x, c in enumerate(row)]
    px = spark.createDataFrame(cells, "image_id long, x long, y long, c string")
    return px.where("c = 'X'").select("image_id", "x", "y"), px


def test_components_join_across_rows_and_stay_apart_diagonally(spark):
    mask, px = planes(spark, PICTURE)
    got = {(r.x, r.y): r.component for r in K.components(mask, px).collect()}
    assert {v for v in got.values()} == {0, 4, 10}
    assert got[(1, 1)] == 0 and got[(3, 1)] == 4 and got[(4, 3)] == 4 and got[(2, 3)] == 10


def test_images_do_not_mix(spark):
    """Two images with pixels at the same places: each has its own components, and its own frame."""
    mask, px = planes(spark, ["XX.", "..."], ["XX", "..", "..", ".X"])
    got = sorted((r.image_id, r.x, r.y, r.component) for r in K.components(mask, px).collect())
    assert got == [(0, 0, 0, 0), (0, 1, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (1, 1, 3, 7)]
    assert {(r.image_id, r.x, r.y) for r in K.dilate(mask, 1, px).collect()} == {(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1), (1, 1, 3), (1, 0, 3), (1, 1, 2)}
    assert {(r.image_id, r.component, r.area, r.touches_frame) for r in K.sizes(K.components(mask, px), px).collect()} == {(0, 0, 2, True), (1, 0, 2, True), (1, 7, 1, True)}


def square(size, *blocks):
    return ["".join("X" if any(a <= x <= b and c <= y <= e for a, b, c, e in blocks) else "." for x in range(size)) for y in range(size)]


def cells(df):
    return {(r.x, r.y) for r in df.collect()}


def test_speckles_holes_and_closing(spark):
    mask, px = planes(spark, square(10, (1, 1, 1, 1), (4, 7, 4, 7)))
    assert cells(K.remove_speckles(mask, 4, px)) == {(x, y) for x in range(4, 8) for y in range(4, 8)}
    ring = [row if y != 4 else row[:4] + "." + row[5:] for y, row in enumerate(square(10, (1, 8, 1, 8)))]
    mask, px = planes(spark, ring)
    assert (4, 4) in cells(K.fill_holes(mask, 4, px)) and (4, 4) not in cells(mask)
    mask, px = planes(spark, square(10, (4, 5, 4, 5)))
    assert cells(K.erode(K.dilate(mask, 1, px), 1, px)) == cells(mask)


def test_islands(spark):
    """White, a blue and a green field on it, and white patches: the one inside blue is its hole, the one across both a layer."""
    from pyspark.sql import functions as F

    inside = lambda x, y, a, b, c, d: a <= x <= b and c <= y <= d
    rows = []
    for y in range(60):
        for x in range(60):
            label = 1 if inside(x, y, 10, 29, 10, 49) else 2 if inside(x, y, 30, 49, 10, 49) else 0
            island = inside(x, y, 15, 20, 20, 25) or inside(x, y, 25, 35, 34, 39)
            rows.append((0, x, y, label, island))
    px = spark.createDataFrame(rows, "image_id long, x long, y long, label long, island boolean")
    got = K.islands(px.where("island").select(*K.AT), px.where("NOT island").select(*K.AT, "label"), px).collect()
    assert {(r.verdict, r.owner, r.area) for r in got} == {("hole", 1, 36), ("layer", None, 66)}
    assert K.islands(px.where("island").select(*K.AT), px.where("NOT island").select(*K.AT, "label"), px, "ignore").count() == 0
    assert {r.verdict for r in K.islands(px.where("island").select(*K.AT), px.where("NOT island").select(*K.AT, "label"), px, "layer").select(F.col("verdict")).collect()} == {"layer"}


def test_empty_mask(spark):
    mask, px = planes(spark, ["..", ".."])
    assert K.components(mask, px).count() == 0
