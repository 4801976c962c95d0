"""Contours of drawn masks, and saved presets."""

import pytest

from tessera.operators import documents as D
from tessera.operators import tracing as V
from tests.test_raster import planes, square


def test_contours_of_a_block_and_a_ring(spark):
    mask, px = planes(spark, square(8, (1, 4, 1, 4)), [row if not 3 <= y <= 4 else row[:3] + ".." + row[5:] for y, row in enumerate(square(8, (1, 6, 1, 6)))])
    got = {}
    for r in V.trace_contours(mask, px).collect():
        got.setdefault(r.image_id, []).append(r)
    assert [r.nodes for r in got[0]] == [13] and got[0][0].path.startswith("M 1.500 1.500 L 2.500 1.500 L 3.500 1.500") and got[0][0].path.endswith("Z")
    ring = {(r.y, r.x) for r in mask.where("image_id = 1").collect()}
    border = [(y, x) for y, x in ring if not {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} <= ring]
    assert len(border) == 20 + 8 and sorted(r.nodes - 1 for r in got[1]) == sorted(len(x) for x in V.walk(border))
    assert V.trace_contours(mask, px, 40).count() == 0
    assert {r.passed for r in V.conformance(V.trace_contours(mask, px), V.trace_contours(mask, px)).collect()} == {True}


def test_walk_takes_every_pixel_once():
    loops = V.walk([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (9, 9)])
    assert loops == [[(0, 0), (0, 1), (0, 2), (1, 2), (2, 2)]]


def test_backends_are_chosen():
    assert V.chosen_backend("auto") == V.chosen_backend("potrace") == "python_contour"
    with pytest.raises(ValueError):
        V.chosen_backend("potrace", exact=True)


def test_presets_are_saved_and_read(spark, tmp_path):
    folder = str(tmp_path / "presets")
    rows = [(1, "a", "one", "2026-01-02", "full"), (2, "b", "later version", "2026-01-03", "full"), (1, "c", "two", None, "palette")]
    df = spark.createDataFrame(rows, "schemaVersion int, presetUuid string, name string, updatedAt string, scope string")
    D.save_presets(df, folder)
    for k, path in enumerate(sorted((tmp_path / "presets").glob("part-*.txt"))):
        path.rename(tmp_path / "presets" / f"{k}.json")
    (tmp_path / "presets" / "bad.json").write_text("{broken")
    got = {(r.presetUuid, r.name, r.updatedAt) for r in D.load_presets(spark, folder).collect()}
    assert ("a", "one", "2026-01-02") in got and ("c", "two", "") in got and not any(p == "b" for p, _, _ in got)
