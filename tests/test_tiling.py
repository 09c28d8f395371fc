"""Anchors, hand-made cases and invariants of the pyramid."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapyr.fixtures import dem, fixture
from terrapyr.functions import extents as E
from terrapyr.operators import catalog, mesh, raster, tiling
from terrapyr.options import BuildOptions
from terrapyr.sources import sinks

SF = "/root/testdata/sf0.01"
COLUMNS = "source_id long, source_type string, x_min double, y_min double, x_max double, y_max double, num_x int, num_y int, min_level int, max_level int"


def one(spark, x0, y0, x1, y1, n=256, max_level=9):
    return spark.createDataFrame([(1, "IMAGE", x0, y0, x1, y1, n, n, 0, max_level)], COLUMNS)


def test_regression_anchors(spark):
    cover = tiling.tile_sources(fixture(spark, SF, "source"))
    tiles = cover.select(*tiling.KEY).distinct()
    assert tiles.count() == 14_428
    top = {(r["level"], r["tile_x"], r["tile_y"]): r["n"] for r in cover.where("level <= 1").groupBy(*tiling.KEY).agg(F.count("*").alias("n")).collect()}
    assert top[0, 0, 0] == 1_750
    assert top[1, 0, 0] == 877
    whole = tiling.complete(tiles)
    assert whole.count() == 18_667


def test_every_parent_is_complete_and_there(spark):
    tiles = tiling.complete(tiling.tile_sources(fixture(spark, SF, "source")).select(*tiling.KEY).distinct())
    rows = {tuple(r) for r in tiles.collect()}
    kids = {}
    for level, x, y in rows:
        if level:
            parent = (level - 1, 0, 0) if level == 1 else (level - 1, x >> 1, y >> 1)
            assert parent in rows
            kids[parent] = kids.get(parent, 0) + 1
    assert all(n == (2 if p[0] == 0 else 4) for p, n in kids.items())


def test_a_source_that_ends_on_a_grid_line_takes_no_tile_beyond(spark):
    got = tiling.coverage(one(spark, -90.0, -90.0, 0.0, 0.0), F.lit(2)).select("tile_x", "tile_y").collect()
    assert sorted(map(tuple, got)) == [(1, 0)]


def test_a_source_outside_takes_nothing(spark):
    assert tiling.coverage(one(spark, 200.0, 0.0, 210.0, 10.0), F.lit(3)).count() == 0


def test_empty_catalog(spark):
    assert tiling.complete(tiling.tile_sources(one(spark, 0.0, 0.0, 1.0, 1.0).limit(0)).select(*tiling.KEY).distinct()).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.tuples(st.floats(-170, 160), st.floats(-85, 70), st.floats(0.1, 20), st.floats(0.1, 15)))
def test_coverage_refines(spark, box):
    x, y, w, h = box
    s = one(spark, x, y, x + w, y + h)
    coarse = {tuple(r) for r in tiling.coverage(s, F.lit(3)).select("tile_x", "tile_y").collect()}
    fine = {tuple(r) for r in tiling.coverage(s, F.lit(4)).select("tile_x", "tile_y").collect()}
    assert fine and {(a >> 1, b >> 1) for a, b in fine} <= coarse


def test_neighbours_are_mutual(spark):
    t = tiling.complete(tiling.tile_sources(fixture(spark, SF, "source")).select(*tiling.KEY).distinct())
    bits = {(r["level"], r["tile_x"], r["tile_y"]): r["neighbour_bits"] for r in tiling.neighbours(t).collect()}
    assert len(bits) == t.count()
    for (level, x, y), b in bits.items():
        for p, (dx, dy) in enumerate(tiling.AROUND):
            there = (level, x + dx, y + dy) in bits
            assert there == bool(b >> p & 1)
            if there:
                assert bits[level, x + dx, y + dy] >> ((p + 4) % 8) & 1


def test_no_tile_takes_its_resolution_from_a_source_that_misses_it(spark):
    s = fixture(spark, SF, "source")
    tiles = tiling.complete(tiling.tile_sources(s).select(*tiling.KEY).distinct())
    res = tiling.resolutions(tiles, s)
    assert res.count() == 27_742
    pairs = tiling.touching(tiles, s).withColumns(tiling.tile_box())
    assert pairs.where("x_min > tx1 or x_max < tx0 or y_min > ty1 or y_max < ty0 or max_level < level").count() == 0
    attached = tiling.attach(tiles, s).join(s, "source_id").withColumns(tiling.tile_box()).where("x_min <= tx1 and x_max >= tx0 and y_min <= ty1 and y_max >= ty0 and max_level >= level")
    assert pairs.count() == attached.count() == pairs.select(*tiling.KEY, "source_id").distinct().count()


def test_sizes_follow_the_finest_source(spark):
    r = spark.createDataFrame([(100.0, 1.0, 64), (100.0, 30.0, 64), (100.0, None, 64), (100.0, 0.0, 64), (101.0, 2.0, 1000)], "w double, r double, n int")
    got = lambda *a, **k: [x[0] for x in r.where("n = 64").select(tiling.image_size(F.col("w"), F.col("r"), 64, *a, **k)).collect()]
    assert got() == [64, 4, None, None]
    assert got(False) == [64, 4, None, None]
    assert [x[0] for x in r.select(tiling.image_size(F.col("w"), F.col("r"), 1000, False, ".dds", True)).collect()] == [104, 8, None, None, 52]
    assert [x[0] for x in r.select(tiling.terrain_size(F.col("w"), F.col("r"), 64)).collect()] == [64, 5, None, None, 52]


def test_grid_of_the_whole_globe(spark):
    c, r = E.grid_shape(F.lit(360.0), F.lit(180.0))
    assert tuple(spark.range(1).select(c, r).first()) == (2, 1)


def test_touching_extents_meet_and_cross_the_date_line(spark):
    box = tuple(F.lit(v) for v in (170.0, 0.0, 180.0, 10.0))
    ask = lambda b, geo=True: spark.range(1).select(E.intersects(box, b, geo)).first()[0]
    assert ask((180.0, 10.0, 190.0, 20.0))
    assert ask((-185.0, 0.0, -180.0, 5.0))
    assert not ask((-185.0, 0.0, -180.0, 5.0), False)
    assert not ask((0.0, 0.0, 10.0, 10.0))


def test_plan_has_no_nested_loop(spark):
    df = tiling.tile_coverage(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan


def test_equalization_is_idempotent_and_agrees(spark):
    once = raster.equalize(dem(spark, SF))
    twice = raster.equalize(once)
    assert once.join(twice.withColumnRenamed("h", "again"), ["tx", "ty", "c", "r", "gx", "gy"]).where("h <> again").count() == 0
    assert once.groupBy("gx", "gy").agg(F.count_distinct("h").alias("n")).where("n > 1").count() == 0


def test_overview_keeps_the_mean(spark):
    g = raster.cells(spark, SF).where("source_id = 3").select("source_id", "c", "r", "v")
    half = raster.overview(g, ["source_id"], 2)
    assert g.agg(F.avg("v")).first()[0] == pytest.approx(half.agg(F.avg("v")).first()[0])


def test_diff_of_equal_revisions(spark):
    r = fixture(spark, SF, "rev")
    assert [x["patch_status"] for x in catalog.diff(r, r, ["file_name", "source_type"]).select("patch_status").distinct().collect()] == ["UNCHANGED"]
    changed = catalog.diff(r, r.withColumn("size", F.col("size") + 1), ["file_name", "source_type"], "size")
    assert {x[0] for x in changed.select("patch_status").distinct().collect()} == {"MODIFIED"}


def test_fold_draws_in_order(spark):
    s = spark.createDataFrame([(1, 1, 10.0, 1.0), (1, 2, 20.0, 0.5), (1, 3, 99.0, 0.0)], "p int, o int, v double, a double")
    assert tuple(raster.blend(s, ["p"], ["o"], "v", "a").first()) == (1, 15.0, 1.0)


def plain_clip(ring, box):
    """The part of a polygon inside a box, cut at one side after the other."""
    for axis, limit, above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        inside = lambda p: p[axis] >= limit if above else p[axis] <= limit  # noqa: B023, E731
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if inside(p):
                out.append(p)
            if inside(p) != inside(q):
                t = (limit - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
    return ring


def test_clip_of_any_ring(spark):
    r = random.Random(3)
    rows = [(i, [(r.uniform(0, 20), r.uniform(0, 20)) for _ in range(r.randrange(3, 9))]) for i in range(40)] + [(99, [(-5.0, -5.0), (30.0, -5.0), (30.0, 30.0), (-5.0, 30.0)])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring]) for i, ring in rows], "id int, ring array<struct<x:double,y:double>>")
    got = {(x["id"], x["tx"], x["ty"]): [(p["x"], p["y"]) for p in x["ring"]] for x in mesh.clip(df, 8.0, 2, 2).collect()}
    area = lambda c: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(c, c[1:] + c[:1]))) / 2
    for i, ring in rows:
        for tx in range(3):
            for ty in range(3):
                want = plain_clip(ring, (tx * 8.0, ty * 8.0, tx * 8.0 + 8, ty * 8.0 + 8))
                if area(want) > 1e-9:
                    assert [v for p in got[i, tx, ty] for v in p] == pytest.approx([v for p in want for v in p])


def test_extrusion_of_any_ring(spark):
    df = spark.createDataFrame([([{"x": float(k), "y": float(k * k), "z": 1.0} for k in range(6)],)], "ring array<struct<x:double,y:double,z:double>>")
    got = [tuple(v) for v in df.select(mesh.extrude(F.col("ring"), F.lit(4.0), True)).first()[0]]
    assert [v for v in got if v[0] == "roof"] == [("roof", k, k, k * k, 5.0) for k in range(6)]
    assert [v for v in got if v[0] == "floor"] == [("floor", k, k, k * k, 1.0) for k in range(6)]
    assert [v for v in got if v[0] == "wall"] == [("wall", 2 * k + up, k % 6, (k % 6) ** 2, 1.0 + 4 * up) for k in range(7) for up in (0, 1)]


def test_dates_carry_over(spark):
    ask = lambda t: str(spark.range(1).select(catalog.parse_date(F.lit(t))).first()[0])
    assert ask("2020/0/1 0:0:0") == "2020-01-01 00:00:00"
    assert ask("2020/12/32 25:61:5") == "2021-02-02 02:01:05"
    assert ask("2020/1/1") == "None"


def test_places_within_groups(spark):
    rows = [(r % 3, (r * 7) % 50, r) for r in range(400)] + [(None, 1, 999)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = {x["id"]: x["position"] for x in catalog.positions(df, [F.desc("v"), F.col("id")], ["g"]).collect()}
    for g in (0, 1, 2, None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in own] == list(range(1, len(own) + 1))


def test_attributes_and_paths_of_any_length(spark):
    long = "v" * 5000
    ask = lambda c: spark.range(1).select(c).first()[0]
    assert ask(catalog.attribute(F.array(F.lit("HGTX 1"), F.lit("HGT " + long)), "HGT")) == long
    assert ask(sinks.simple_path(F.lit("/o/a/b/c/../../../t.dds"))) == "/o/t.dds"
    assert ask(sinks.simple_path(F.lit("../a/./b//../c"))) == "../a/c"


def test_options_store_only_what_differs():
    assert BuildOptions().changed() == {}
    assert BuildOptions(image_tile=128).changed() == {"image_tile": 128}


def test_split_levels(spark):
    p, s = tiling.split_levels(F.lit(12))
    assert tuple(spark.range(1).select(p, s).first()) == (4, 8)
