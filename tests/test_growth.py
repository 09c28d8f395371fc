"""Plans that hold when tables grow: nothing that was exploded is broadcast, and what is made of one row stays where it was dealt."""

import re

import pytest
from pyspark.sql import functions as F

from terrapyr.fixtures import dem, fixture
from terrapyr.operators import mesh, raster, tiling
from terrapyr.registry import SQL

from .compare import assert_same

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def copies(df, n: int = 2):
    """Every row n times."""
    out = df
    for _ in range(n - 1):
        out = out.union(df)
    return out


@pytest.mark.parametrize("f", [mesh.culling_cone, mesh.local_frame, mesh.outline_edges, mesh.drape_vertices, mesh.place_features])
def test_posts_are_never_broadcast(spark, f):
    assert "BroadcastExchange" not in plan(f(spark, SF))


@pytest.mark.parametrize("f", [mesh.culling_cone, mesh.local_frame, mesh.outline_edges])
def test_posts_stay_where_their_tile_was_dealt(spark, f):
    """The only shuffles are of tiles, before they become posts."""
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(f(spark, SF)))
    assert keys and all(re.fullmatch(r"tx#\d+, ty#\d+, \d+", k) for k in keys), keys


def test_posts_come_from_many_tasks(spark):
    assert dem(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


SAMPLED = {"R2_bilinear_resample": raster.bilinear_resample, "R3_nearest_sample": raster.nearest_sample, "R4_dem_bilinear": raster.dem_bilinear, "G16_raster_warp": raster.raster_warp}


@pytest.mark.parametrize("name", SAMPLED)
def test_rasters_are_sampled_where_they_lie(spark, name):
    """A raster moves once, as one row; none of its cells or posts does."""
    p = plan(SAMPLED[name](spark, SF))
    assert "Join" not in p and "BroadcastExchange" not in p
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    assert len(keys) == 1 and keys[0].startswith("source_id#"), keys


@pytest.mark.parametrize("name", SAMPLED)
def test_odd_rasters_are_sampled_as_in_sql(spark, tmp_path, name):
    """Rows of one source twice and three times, gaps, rasters that are short, empty, null or without an id."""
    import duckdb

    full = [float(k % 7 - 2) for k in range(64)]
    rows = [(1, full, 0), (2, [None if k % 3 else v for k, v in enumerate(full)], 0), (2, full[::-1], 0), (3, full, 1), (3, full, 1), (3, [None] * 64, 1), (4, full[:40], 0), (5, None, 0), (6, [], 0), (None, full, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert_same(SAMPLED[name](spark, str(tmp_path)), con.execute(SQL[name]))


TILED = [tiling.source_attachment, tiling.contributing_sources, tiling.contributing_semi, tiling.need_to_divide, tiling.tile_sizes_as_posts]


@pytest.mark.parametrize("f", TILED)
def test_sources_and_tiles_are_never_broadcast(spark, f):
    assert "BroadcastExchange" not in plan(f(spark, SF))


def _odd_sources(spark):
    """One id on several rows: the same place twice, a place in another, apart, at other levels; two without an id."""
    rows = [
        (1, "IMAGE", -20.0, -20.0, 20.0, 20.0, 64, 64, 0, 9), (1, "IMAGE", -20.0, -20.0, 20.0, 20.0, 64, 64, 0, 9), (1, "IMAGE", -5.0, -5.0, 5.0, 5.0, 512, 512, 0, 9),
        (2, "IMAGE", 0.0, 0.0, 3.0, 3.0, 256, 256, 0, 9), (2, "HEIGHT_FIELD", 100.0, 10.0, 103.0, 13.0, 16, 16, 0, 9), (3, "IMAGE", 1.0, 1.0, 4.0, 2.0, 128, 128, 0, 5),
        (4, "HEIGHT_FIELD", -180.0, -90.0, 180.0, 90.0, 8, 8, 0, 9), (4, "IMAGE", 2.0, 2.0, 4.0, 4.0, 256, 256, 0, 9), (None, "IMAGE", 50.0, 50.0, 52.0, 52.0, 64, 64, 0, 9), (None, "IMAGE", 50.0, 50.0, 52.0, 52.0, 64, 64, 0, 9),
    ]
    return spark.createDataFrame(rows, "source_id long, source_type string, x_min double, y_min double, x_max double, y_max double, num_x int, num_y int, min_level int, max_level int")


def test_counted_attachments_are_those_that_are_listed(spark):
    s = _odd_sources(spark)
    tiles = tiling.complete(tiling.tile_sources(s).select(*tiling.KEY).distinct()).cache()
    pairs = tiling.attach(tiles, s).cache()
    listed = pairs.groupBy(*tiling.KEY).agg(F.count_distinct("source_id").alias("n_sources"), F.min("source_id").alias("first_source"), F.max("source_id").alias("last_source"))
    rows = lambda d: sorted(map(tuple, d.select(*listed.columns).collect()), key=repr)
    assert rows(tiling.contributions(tiles, s)) == rows(listed)
    placed, places = tiling.attachments(tiles, s)
    counted = {r["level"]: r["n"] for r in places.groupBy("level").agg(F.sum(F.col("sources") * F.col("n")).alias("n")).collect()}
    assert counted == {r["level"]: r["n"] for r in pairs.groupBy("level").agg(F.count("*").alias("n")).collect()}
    bits = {r["source_id"]: r["bits"] for r in tiling.levels_of(placed, places).collect()}
    assert bits == {r["source_id"]: r["b"] for r in pairs.where("source_id is not null").groupBy("source_id").agg(F.bit_or(F.expr("shiftleft(1L, level)")).alias("b")).collect()}


def test_sources_alike_count_once_for_resolutions(spark):
    """Three times the sources make no more pairs, and the same steps."""
    s = fixture(spark, SF, "source")
    tiles = tiling.complete(tiling.tile_sources(s).select(*tiling.KEY).distinct()).cache()
    one, three = tiling.resolutions(tiles, s), tiling.resolutions(tiles, copies(s, 3))
    assert one.count() == three.count() and one.exceptAll(three).count() == 0
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\), REPARTITION_BY_NUM", plan(three))
    assert any("source_type#" in k and "set_name#" in k for k in dealt), dealt
