import numpy as np
import pytest

from tessera.operators import palettes as P
from tessera.plans.session import Session
from tessera.sources.raster import pixels
from tessera.streaming.histogram import binned

SF = "/root/testdata/sf0.001"


def test_seeds_ties_go_to_the_lowest_key():
    points = np.array([[0, 0, 0], [1, 0, 0], [-1, 0, 0]], float)
    got = P.seeds(np.array([5, 9, 7]), points, np.array([3.0, 1.0, 1.0]), 2)
    assert got[0].tolist() == [0, 0, 0] and got[1].tolist() == [-1, 0, 0]
    assert len(P.seeds(np.array([1, 2]), np.array([[0, 0, 0], [0.001, 0, 0]]), np.ones(2), 2, 0.02)) == 1


@pytest.mark.parametrize("make", [P.kmeans, P.engine_palette])
def test_palettes_cover_all_pixels(spark, make):
    px = pixels(spark, SF)
    got = make(px, 4)
    rounded = lambda rows: [tuple(round(v, 9) for v in r) for r in rows]
    assert len(got) == 4 and sum(r[3] for r in got) == px.count() and rounded(got) == rounded(make(px.orderBy("r"), 4))
    assert make(px.limit(0), 4) == []


def test_stream_keeps_the_batch_histogram(spark, tmp_path):
    px = pixels(spark, SF)
    px.where("y < 5").write.parquet(str(tmp_path / "in"))
    px.where("y >= 5").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(px.schema).parquet(str(tmp_path / "in"))
    q = binned(stream).writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("bins").collect()} == {tuple(r) for r in binned(px).collect()}


def test_session_only_redoes_what_changed(spark):
    done = []

    def stage(name):
        def run(settings, frame):
            done.append(name)
            return frame

        return run

    s = Session(spark.range(3), {n: stage(n) for n in ("analysis", "segmentation", "geometry", "serialization")}, {"colours": "analysis", "tolerance": "geometry"})
    s.update({"colours": 4, "tolerance": 1})
    done.clear()
    assert s.update({"colours": 4, "tolerance": 2}).count() == 3
    assert done == ["geometry", "serialization"]
    s.close()
