"""Meshes and features: frames, triangles, normals, skirts, draping, clipping, extrusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import cte, dem, fixture
from ..functions import extents as E
from ..options import BuildOptions
from ..registry import query
from . import tiling
from .raster import bilinear, equalize

D, FE = cte("dem"), cte("feature")
O = BuildOptions()
A, B = O.equator_radius, O.polar_radius
#: Degrees between the posts of the query's grids.
STEP = 0.005
#: Posts along a side of a tile of the query's grids.
SIDE = 9
_LL = "select tx, ty, c, r, h, gy * 0.005::double as lat, gx * 0.005::double as lon from dem"
_N = f"({A} / sqrt(1 - (1 - ({B}::double ** 2) / ({A}::double ** 2)) * sin(radians(lat)) ** 2))"
_XYZ = f"({_N} + h) * cos(radians(lat)) * cos(radians(lon)) as x, ({_N} + h) * cos(radians(lat)) * sin(radians(lon)) as y, ({_N} * (({B}::double ** 2) / ({A}::double ** 2)) + h) * sin(radians(lat)) as z"


def _globe(posts: DataFrame) -> DataFrame:
    x, y, z = E.geocentric(F.col("gy") * STEP, F.col("gx") * STEP, F.col("h"), A, B)
    return posts.withColumns({"x": x, "y": y, "z": z})


@query("P14_geocentric", D + f"select tx, ty, c, r, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from (select *, {_XYZ} from ({_LL}))")
def geocentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _globe(dem(spark, sf_dir)).select("tx", "ty", "c", "r", *[F.round(a, 3).alias(a) for a in "xyz"])


@query("P15_local_frame", D + f"select tx, ty, c, r, round(-sin(l) * (x - ox) + cos(l) * (y - oy), 3) + 0.0::double as east, round(-sin(p) * cos(l) * (x - ox) - sin(p) * sin(l) * (y - oy) + cos(p) * (z - oz), 3) + 0.0::double as north, round(cos(p) * cos(l) * (x - ox) + cos(p) * sin(l) * (y - oy) + sin(p) * (z - oz), 3) + 0.0::double as up from (select *, {_XYZ} from ({_LL})) join (select tx, ty, x as ox, y as oy, z as oz, radians(lat) as p, radians(lon) as l from (select *, {_XYZ} from (select * replace (0.0::double as h) from ({_LL}) where c = 4 and r = 4))) using (tx, ty)")
def local_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """East, north and up at the tile's centre; its transpose leads back. Sides of this join are estimated by the few rows that they come from: neither must be broadcast."""
    posts = _globe(dem(spark, sf_dir))
    mid = _globe(dem(spark, sf_dir).where("c = 4 and r = 4").withColumn("h", F.lit(0.0))).select("tx", "ty", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.radians(F.col("gy") * STEP).alias("phi"), F.radians(F.col("gx") * STEP).alias("lam"))
    j = posts.join(mid.hint("merge"), ["tx", "ty"])
    dx, dy, dz, p, l = F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z") - F.col("oz"), F.col("phi"), F.col("lam")
    east = -F.sin(l) * dx + F.cos(l) * dy
    north = -F.sin(p) * F.cos(l) * dx - F.sin(p) * F.sin(l) * dy + F.cos(p) * dz
    up = F.cos(p) * F.cos(l) * dx + F.cos(p) * F.sin(l) * dy + F.sin(p) * dz
    return j.select("tx", "ty", "c", "r", *[(F.round(v, 3) + 0.0).alias(n) for v, n in ((east, "east"), (north, "north"), (up, "up"))])


_DELTA = "e as (select tx, ty, c, r, gx, gy, avg(h) over (partition by gx, gy) as h from dem), d as (select *, lead(h) over (partition by tx, ty, r order by c) - h as dr, h - lag(h) over (partition by tx, ty, r order by c) as dl, lead(h) over (partition by tx, ty, c order by r) - h as du, h - lag(h) over (partition by tx, ty, c order by r) as dd from e)"


@query("P20_vertex_normals", D[:-1] + f", {_DELTA}, n as (select *, (coalesce(dr, dl) + coalesce(dl, dr)) / 2 as sx, (coalesce(du, dd) + coalesce(dd, du)) / 2 as sy from d) select tx, ty, c, r, round(-sx / sqrt(sx * sx + sy * sy + 1), 9) + 0.0::double as nx, round(-sy / sqrt(sx * sx + sy * sy + 1), 9) + 0.0::double as ny, round(1 / sqrt(sx * sx + sy * sy + 1), 9) as nz from n")
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: slopes from both sides, from one at an edge."""
    across, along = W.partitionBy("tx", "ty", "r").orderBy("c"), W.partitionBy("tx", "ty", "c").orderBy("r")
    e = equalize(dem(spark, sf_dir))
    h = F.col("h")
    e = e.withColumns({"dr": F.lead("h").over(across) - h, "dl": h - F.lag("h").over(across), "du": F.lead("h").over(along) - h, "dd": h - F.lag("h").over(along)})
    both = lambda a, b: (F.coalesce(a, b) + F.coalesce(b, a)) / 2
    e = e.withColumns({"sx": both("dr", "dl"), "sy": both("du", "dd")})
    n = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + 1)
    return e.select("tx", "ty", "c", "r", (F.round(-F.col("sx") / n, 9) + 0.0).alias("nx"), (F.round(-F.col("sy") / n, 9) + 0.0).alias("ny"), F.round(1 / n, 9).alias("nz"))


@query("P34_skirt_length", D + "select tx, ty, round(sqrt((max(gx) - min(gx)) ** 2 + (max(gy) - min(gy)) ** 2) / 2 * 0.02, 9) as skirt, round(2 * 6378137.0 * sin(radians((max(gx) - min(gx)) * 0.005::double / 2)) * 0.02, 3) as round_skirt from dem group by all")
def skirt_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the tile's radius; on the globe, of a chord."""
    w, h = F.max("gx") - F.min("gx"), F.max("gy") - F.min("gy")
    return dem(spark, sf_dir).groupBy("tx", "ty").agg(F.round(F.sqrt(w * w + h * h) / 2 * O.skirt_ratio, 9).alias("skirt"), F.round(2 * F.lit(A) * F.sin(F.radians(w * STEP / 2)) * O.skirt_ratio, 3).alias("round_skirt"))


@query("A15_culling_cone", D[:-1] + f", v as (select *, {_XYZ} from ({_LL})), m as (select tx, ty, avg(x) as ax, avg(y) as ay, avg(z) as az from v group by all), u as (select v.*, ax / sqrt(ax * ax + ay * ay + az * az) as cx, ay / sqrt(ax * ax + ay * ay + az * az) as cy, az / sqrt(ax * ax + ay * ay + az * az) as cz, sqrt(x * x + y * y + z * z) as len from v join m using (tx, ty)) select tx, ty, case when min((x * cx + y * cy + z * cz) / len) >= 0 then round(min((x * cx + y * cy + z * cz) / len), 9) end as min_dot, max(h) as max_height, round(max(len), 3) as max_radius, bool_or((x * cx + y * cy + z * cz) / len < 0) as wraps from u group by all")
def culling_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cone of directions that a tile covers; null if it wraps around. Posts are dealt out by tile, so a tile's mean is a window over its own posts."""
    over = W.partitionBy("tx", "ty")
    v = _globe(dem(spark, sf_dir).where("tx is not null and ty is not null"))
    n = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    u = v.withColumns({"a" + a: F.avg(a).over(over) for a in "xyz"}).withColumn("len", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    dot = (F.col("x") * F.col("ax") + F.col("y") * F.col("ay") + F.col("z") * F.col("az")) / n / F.col("len")
    return u.withColumn("dot", dot).groupBy("tx", "ty").agg(F.when(F.min("dot") >= 0, F.round(F.min("dot"), 9)).alias("min_dot"), F.max("h").alias("max_height"), F.round(F.max("len"), 3).alias("max_radius"), F.bool_or(F.col("dot") < 0).alias("wraps"))


@query("G5_grid_triangles", D[:-1] + ", q as (select tx, ty, c, r, h as a, lead(h) over (partition by tx, ty, r order by c) as b, lead(h) over (partition by tx, ty, c order by r) as d from dem), s as (select *, lead(d) over (partition by tx, ty, r order by c) as e from q), t as (select tx, ty, c, r, abs(a - e) < abs(b - d) as up from s where b is not null and d is not null) select tx, ty, r * 9 + c as v0, case when up then r * 9 + c + 1 else r * 9 + c + 1 end as v1, case when up then (r + 1) * 9 + c + 1 else (r + 1) * 9 + c end as v2, 0 as half from t union all select tx, ty, case when up then r * 9 + c else r * 9 + c + 1 end, (r + 1) * 9 + c + 1, (r + 1) * 9 + c, 1 from t")
def grid_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell is cut along the diagonal with the smaller difference in height."""
    across, along = W.partitionBy("tx", "ty", "r").orderBy("c"), W.partitionBy("tx", "ty", "c").orderBy("r")
    q = dem(spark, sf_dir).withColumns({"b": F.lead("h").over(across), "d": F.lead("h").over(along)}).withColumn("e", F.lead("d").over(across)).where("b is not null and d is not null")
    i = F.col("r") * SIDE + F.col("c")
    a, b, d, e = i, i + 1, i + SIDE, i + SIDE + 1
    tri = lambda v0, v1, v2, half: F.struct(v0.alias("v0"), v1.alias("v1"), v2.alias("v2"), F.lit(half).alias("half"))
    cut = F.abs(F.col("h") - F.col("e")) < F.abs(F.col("b") - F.col("d"))
    return q.select("tx", "ty", F.explode(F.when(cut, F.array(tri(a, b, e, 0), tri(a, e, d, 1))).otherwise(F.array(tri(a, b, d, 0), tri(b, e, d, 1)))).alias("t")).select("tx", "ty", "t.*")


@query("G6_grid_vertices", D + "select tx, ty, r * 9 + c as v, gx * 1.0::double as x, gy * 1.0::double as y, h as z, c / 8.0::double as s, r / 8.0::double as t from dem")
def grid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dem(spark, sf_dir).select("tx", "ty", (F.col("r") * SIDE + F.col("c")).alias("v"), F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), F.col("h").alias("z"), (F.col("c") / (SIDE - 1)).alias("s"), (F.col("r") / (SIDE - 1)).alias("t"))


@query("G7_skirt_ring", D + "select tx, ty, cast(case when r = 0 then c when c = 8 then 8 + r when r = 8 then 24 - c else 32 - r end as int) as ordinal, gx, gy, h - 2.5::double as z from dem where r in (0, 8) or c in (0, 8)")
def skirt_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border posts in order around the tile, dropped."""
    c, r = F.col("c"), F.col("r")
    e = SIDE - 1
    at = F.when(r == 0, c).when(c == e, e + r).when(r == e, 3 * e - c).otherwise(4 * e - r)
    return dem(spark, sf_dir).where(f"r in (0, {e}) or c in (0, {e})").select("tx", "ty", at.alias("ordinal"), "gx", "gy", (F.col("h") - 2.5).alias("z"))


@query("G8_grid_decimation", D[:-1] + ", s as (select *, lag(h) over (partition by tx, ty, r order by c) as a, lead(h) over (partition by tx, ty, r order by c) as b from dem) select tx, ty, count(*) as posts, count(*) filter (where a is null or b is null or r in (0, 8) or abs(h - (a + b) / 2) > 3) as kept from s group by all")
def grid_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that the line between their neighbours stands for may go; borders stay."""
    w = W.partitionBy("tx", "ty", "r").orderBy("c")
    s = dem(spark, sf_dir).withColumns({"a": F.lag("h").over(w), "b": F.lead("h").over(w)})
    keep = F.col("a").isNull() | F.col("b").isNull() | F.col("r").isin(0, 8) | (F.abs(F.col("h") - (F.col("a") + F.col("b")) / 2) > 3)
    return s.groupBy("tx", "ty").agg(F.count("*").alias("posts"), F.count_if(keep).alias("kept"))


@query("G19_default_grid", D + "select tx, ty, c.c as c, r.r as r, tx * 8 + c.c * 8.0::double / 7 as x, ty * 8 + r.r * 8.0::double / 7 as y, 0.0::double as h from (select distinct tx, ty from dem), range(0, 8) c(c), range(0, 8) r(r)")
def default_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 flat posts where there is no terrain."""
    side = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    g = dem(spark, sf_dir).select("tx", "ty").distinct().withColumn("c", side).withColumn("r", side)
    return g.select("tx", "ty", "c", "r", (F.col("tx") * 8 + F.col("c") * F.lit(8.0) / 7).alias("x"), (F.col("ty") * 8 + F.col("r") * F.lit(8.0) / 7).alias("y"), F.lit(0.0).alias("h"))


@query("G9_scene_manifest", tiling.SRC + tiling.TILES + f", b as (select *, {tiling.TILE_BOX} from tiles), d as (select *, sqrt((tx1 - tx0) ** 2 + (ty1 - ty0) ** 2) * 0.5 * 7.0 as own from b), c as (select level - 1 as level, case when level = 1 then 0 else tile_x >> 1 end as tile_x, case when level = 1 then 0 else tile_y >> 1 end as tile_y, count(*) as children, max(own) as far, string_agg('world_L' || level || '_X' || tile_x || '_Y' || tile_y, ',' order by tile_x, tile_y) as files from d where level > 0 group by all) select d.level, d.tile_x, d.tile_y, coalesce(children, 0) as children, files, case when children is null then 'LEAF' else 'PAGED' end as node, case when children is null then 0.0::double else round(greatest(c.far, own / 2), 6) end as near, case when d.level = 0 then 1e10::double else 1e30::double end as far from d left join c using (level, tile_x, tile_y)")
def scene_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(tiling.all_tiles(spark, sf_dir))


def manifest(tiles: DataFrame, o: BuildOptions = O) -> DataFrame:
    """A row for each tile: a leaf, always shown, or a paged level that gives way to its children's files nearer than the cut-off. That is the farthest of the children's own distances (A20), but no less than half the tile's. A tile has four children at most (C1 x R1 under the root), so their list is bounded."""
    key = tiling.KEY
    t = tiles.select(*key).withColumns(tiling.tile_box())
    dx, dy = F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0")
    t = t.select(*key, (F.sqrt(dx * dx + dy * dy) * 0.5 * o.distance_ratio).alias("own"))
    up = [tiling._half("tile_x"), tiling._half("tile_y")]
    kids = t.where("level > 0").select((F.col("level") - 1).alias("level"), *up, F.struct("tile_x", "tile_y", F.format_string("world_L%d_X%d_Y%d", *key).alias("file")).alias("kid"), "own")
    kids = kids.groupBy(*key).agg(F.count("*").alias("children"), F.max("own").alias("away"), F.array_join(F.transform(F.array_sort(F.collect_list("kid")), lambda k: k["file"]), ",").alias("files"))
    j = t.join(kids, key, "left")
    leaf = F.col("children").isNull()
    return j.select(*key, F.coalesce("children", F.lit(0)).alias("children"), "files", F.when(leaf, "LEAF").otherwise("PAGED").alias("node"), F.when(leaf, 0.0).otherwise(F.round(F.greatest("away", F.col("own") / 2), 6)).alias("near"), F.when(F.col("level") == 0, o.top_distance).otherwise(1e30).alias("far"))


# --- features ------------------------------------------------------------------------------


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, sf_dir, "feature")
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("z")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    return f.select("feature_id", "kind", "hgt", ring.alias("ring"))


@query("A16_centroid", FE + "select feature_id, x0 + w / 2 as cx, y0 + h / 2 as cy from feature")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda a: F.aggregate(F.transform("ring", lambda p: p[a]), F.lit(0.0), lambda s, v: s + v) / F.size("ring")
    return rings(spark, sf_dir).select("feature_id", mean("x").alias("cx"), mean("y").alias("cy"))


@query("A17_geometry_bounds", FE + "select feature_id, x0 as x_min, y0 as y_min, x0 + w as x_max, y0 + h as y_max from feature")
def geometry_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda a: F.transform("ring", lambda p: p[a])
    return rings(spark, sf_dir).select("feature_id", F.array_min(v("x")).alias("x_min"), F.array_min(v("y")).alias("y_min"), F.array_max(v("x")).alias("x_max"), F.array_max(v("y")).alias("y_max"))


_POSTS = "post as (select gx, gy, avg(h) as h from dem group by all)"
_DRAPED = "vtx as (select feature_id, kind, hgt, i, case i when 0 then x0 when 1 then x0 + w when 2 then x0 + w else x0 end as x, case when i < 2 then y0 else y0 + h end as y from feature, range(0, 4) t(i)), near as (select v.*, q.gx as qx, q.gy as qy, q.w from vtx v, lateral (select cast(floor(x) as bigint) + dx as gx, cast(floor(y) as bigint) + dy as gy, (case when dx = 0 then 1 - (x - floor(x)) else x - floor(x) end) * (case when dy = 0 then 1 - (y - floor(y)) else y - floor(y) end) as w from (values (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)) q where q.w > 0), draped as (select n.feature_id, n.kind, n.hgt, n.i, n.x, n.y, sum(n.w * p.h) / sum(case when p.h is not null then n.w end) as z from near n left join post p on p.gx = n.qx and p.gy = n.qy group by all)"


def drape(vertices: DataFrame, keys: list[str], posts: DataFrame) -> DataFrame:
    """The height under every vertex, from the corners that are there; null outside."""
    grid = posts.groupBy(F.col("gx").cast("int").alias("c"), F.col("gy").cast("int").alias("r")).agg(F.avg("h").alias("h"))
    return bilinear(vertices, keys, "x", "y", grid, ["c", "r"], "h").withColumnRenamed("sampled", "z")


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings(spark, sf_dir).select("feature_id", "kind", "hgt", F.posexplode("ring").alias("i", "p")).select("feature_id", "kind", "hgt", F.col("i").cast("long").alias("i"), "p.x", "p.y")


@query("J8_drape", "with " + D[5:-1] + ", " + FE[5:-1] + f", {_POSTS}, {_DRAPED} select feature_id, i, round(z, 9) as z from draped")
def drape_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drape(_vertices(spark, sf_dir), ["feature_id", "i"], dem(spark, sf_dir)).withColumn("z", F.round("z", 9))


@query("G11_convexity", FE + "select feature_id, feature_id % 5 <> 0 as convex, case when feature_id % 3 = 0 then -1 else 1 end as turn from feature")
def convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the outline have one sign; the sign says which way is up."""
    r = rings(spark, sf_dir)
    dent = F.struct((F.col("ring")[3]["x"] + 0.5).alias("x"), (F.col("ring")[3]["y"] - 0.25).alias("y"), F.lit(0.0).alias("z"))
    shape = F.when(F.col("feature_id") % 5 == 0, F.array_append("ring", dent)).otherwise(F.col("ring"))
    shape = F.when(F.col("feature_id") % 3 == 0, F.reverse(shape)).otherwise(shape)
    t = turns(F.col("s"))
    total = F.aggregate(t, F.lit(0.0), lambda a, v: a + v)
    return r.select("feature_id", shape.alias("s")).select("feature_id", (F.forall(t, lambda v: v >= 0) | F.forall(t, lambda v: v <= 0)).alias("convex"), F.when(total < 0, -1).otherwise(1).alias("turn"))


def turns(ring: Column) -> Column:
    """Cross products of consecutive edges."""
    at = lambda i: F.get(ring, i % F.size(ring))
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: (at(i + 1)["x"] - at(i)["x"]) * (at(i + 2)["y"] - at(i + 1)["y"]) - (at(i + 1)["y"] - at(i)["y"]) * (at(i + 2)["x"] - at(i + 1)["x"]))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of four corners, and some of five with a dent."""
    r = rings(spark, sf_dir)
    dent = F.struct((F.col("ring")[3]["x"] + 0.5).alias("x"), (F.col("ring")[3]["y"] - 0.25).alias("y"), F.lit(0.0).alias("z"))
    return r.withColumn("ring", F.when(F.col("feature_id") % 5 == 0, F.array_append("ring", dent)).otherwise(F.col("ring")))


_SHAPES = FE[:-1] + ", vtx as (select feature_id, kind, hgt, 4 + (feature_id % 5 = 0)::int as n, i, case i when 0 then x0 when 1 then x0 + w when 2 then x0 + w when 3 then x0 else x0 + 0.5 end as x, case i when 0 then y0 when 1 then y0 when 2 then y0 + h when 3 then y0 + h else y0 + h - 0.25 end as y from feature, range(0, 5) t(i) where i < 4 + (feature_id % 5 = 0)::int)"


def extrude(ring: Column, height: Column, merge: bool = False) -> Column:
    """G13 for a ring of any size: the roof is the raised outline, walls are a closed strip of lower and upper vertices; merge keeps the outline below as a floor. An array of (part, i, x, y, z)."""
    n = F.size(ring)
    at = lambda part, i, k, up: F.struct(F.lit(part).alias("part"), i.cast("long").alias("i"), F.get(ring, k)["x"].alias("x"), F.get(ring, k)["y"].alias("y"), (F.get(ring, k)["z"] + up).alias("z"))
    flat = lambda part, up: F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(part, k, k, up))
    wall = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.array(at("wall", k * 2, k % n, F.lit(0.0)), at("wall", k * 2 + 1, k % n, height))))
    return F.concat(flat("roof", height), wall, *([flat("floor", F.lit(0.0))] if merge else []))


@query("G13_extrude_buildings", _SHAPES + ", b as (select * from vtx where kind = 'Building') select feature_id, part, i, x, y, z from (select feature_id, 'roof' as part, i, x, y, hgt as z from b union all select feature_id, 'floor', i, x, y, 0.0::double from b union all select b.feature_id, 'wall', 2 * k + up, x, y, case when up = 1 then hgt else 0.0::double end from b, range(0, 6) s(k), (values (0), (1)) u(up) where k <= n and i = k % n)")
def extrude_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shapes(spark, sf_dir).where("kind = 'Building'")
    return r.select("feature_id", F.explode(extrude(F.col("ring"), F.col("hgt"), merge=True)).alias("v")).select("feature_id", "v.*")


@query("G13_extrude_forest", _SHAPES + " select feature_id, i, top, x, y, case when top then hgt else 0.0::double end as z from vtx, (values (false), (true)) b(top) where kind = 'Forest'")
def extrude_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex becomes an upright line."""
    r = shapes(spark, sf_dir).where("kind = 'Forest'").select("feature_id", "hgt", F.posexplode("ring").alias("i", "v"))
    return r.withColumn("top", F.explode(F.array(F.lit(False), F.lit(True)))).select("feature_id", F.col("i").cast("long").alias("i"), "top", "v.x", "v.y", F.when(F.col("top"), F.col("hgt")).otherwise(0.0).alias("z"))


@query("G14_place_features", "with " + D[5:-1] + ", " + FE[5:-1] + f", {_POSTS}, {_DRAPED}, inside as (select * from draped where z is not null) select feature_id, kind, count(*) as vertices, round(min(z), 6) as ground, round(max(z) + coalesce(any_value(hgt), 10), 6) as top from inside where x between 4 and 36 and y between 0 and 12 group by 1, 2")
def place_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, attributes (a height of 10 where there is none), drape and the top of the extrusion in one plan."""
    v = _vertices(spark, sf_dir)
    z = drape(v, ["feature_id", "i"], dem(spark, sf_dir))
    j = v.join(z.hint("merge"), ["feature_id", "i"]).where("z is not null and x between 4 and 36 and y between 0 and 12")
    return j.groupBy("feature_id", "kind").agg(F.count("*").alias("vertices"), F.round(F.min("z"), 6).alias("ground"), F.round(F.max("z") + F.coalesce(F.first("hgt"), F.lit(10.0)), 6).alias("top"))


@query("G15_reproject_vertices", FE + "select feature_id, i, round(radians(x) * 6378137.0, 3) as x, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, 3) as y from (select feature_id, i, case i when 0 then x0 when 1 then x0 + w when 2 then x0 + w else x0 end as x, case when i < 2 then y0 else y0 + h end as y from feature, range(0, 4) t(i))")
def reproject_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import mercator

    x, y = mercator(F.col("x"), F.col("y"), A)
    return _vertices(spark, sf_dir).select("feature_id", "i", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("G12_outline_edges", D[:-1] + ", tri as (select r * 9 + c as a, r * 9 + c + 1 as b, (r + 1) * 9 + c as d, tx, ty from dem where c < 8 and r < 8 union all select r * 9 + c + 1, (r + 1) * 9 + c + 1, (r + 1) * 9 + c, tx, ty from dem where c < 8 and r < 8), edge as (select tx, ty, least(a, b) u, greatest(a, b) v from tri union all select tx, ty, least(b, d), greatest(b, d) from tri union all select tx, ty, least(a, d), greatest(a, d) from tri) select tx, ty, u, v from edge group by all having count(*) = 1")
def outline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that bound one triangle only are the outline."""
    i = F.col("r") * SIDE + F.col("c")
    cells_ = dem(spark, sf_dir).where(f"c < {SIDE - 1} and r < {SIDE - 1}").select("tx", "ty", F.explode(F.array(F.array(i, i + 1, i + SIDE), F.array(i + 1, i + SIDE + 1, i + SIDE))).alias("t"))
    pair = lambda a, b: F.struct(F.least(F.col("t")[a], F.col("t")[b]).alias("u"), F.greatest(F.col("t")[a], F.col("t")[b]).alias("v"))
    return cells_.select("tx", "ty", F.explode(F.array(pair(0, 1), pair(1, 2), pair(0, 2))).alias("e")).select("tx", "ty", "e.*").groupBy("tx", "ty", "u", "v").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def clip_ring(ring: Column, box: tuple) -> Column:
    """The part of a ring inside a box, cut at one side after the other: a fold over the four sides."""
    none = F.array().cast("array<struct<x:double,y:double>>")
    side = lambda along_x, limit, above: F.struct(F.lit(along_x).alias("along_x"), limit.cast("double").alias("limit"), F.lit(above).alias("above"))
    sides = F.array(side(True, box[0], True), side(True, box[2], False), side(False, box[1], True), side(False, box[3], False))

    def cut(r: Column, s: Column) -> Column:
        on = lambda p: F.when(s["along_x"], p["x"]).otherwise(p["y"])
        inside = lambda p: F.when(s["above"], on(p) >= s["limit"]).otherwise(on(p) <= s["limit"])

        def edge(i: Column) -> Column:
            p, q = F.get(r, i), F.get(r, (i + 1) % F.size(r))
            t = (s["limit"] - on(p)) / F.nullif(on(q) - on(p), F.lit(0.0))
            cross = F.struct(*[(p[a] + t * (q[a] - p[a])).alias(a) for a in "xy"])
            return F.concat(F.when(inside(p), F.array(p)).otherwise(none), F.when(inside(p) != inside(q), F.array(cross)).otherwise(none))

        return F.when(F.size(r) == 0, r).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(r) - 1), edge)))

    return F.aggregate(sides, ring.cast("array<struct<x:double,y:double>>"), cut)


def ring_area(ring: Column) -> Column:
    """The signed area of a ring."""
    cross = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % F.size(ring))["y"] - F.get(ring, (i + 1) % F.size(ring))["x"] * F.get(ring, i)["y"])
    return F.when(F.size(ring) > 2, F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2).otherwise(0.0)


def clip(features: DataFrame, size: float, last_x: int, last_y: int) -> DataFrame:
    """Features (with `ring`) cut to the tiles of a grid that they touch: (.., tx, ty, ring). Tiles come from index ranges of the ring's bounds."""
    at = lambda a: F.transform("ring", lambda p: p[a])
    span = lambda a, last: F.sequence(F.greatest(F.floor(F.array_min(at(a)) / size), F.lit(0)), F.least(F.floor(F.array_max(at(a)) / size), F.lit(last)))
    t = features.withColumn("ring", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    t = t.withColumn("tx", F.explode(span("x", last_x))).withColumn("ty", F.explode(span("y", last_y)))
    box = (F.col("tx") * size, F.col("ty") * size, F.col("tx") * size + size, F.col("ty") * size + size)
    t = t.withColumn("ring", clip_ring(F.col("ring"), box))
    return t.where(F.abs(ring_area(F.col("ring"))) > 0)


@query("G10_clip_polygons", FE + "select feature_id, tx, ty, round((least(x0 + w, tx * 8 + 8) - greatest(x0, tx * 8)) * (least(y0 + h, ty * 8 + 8) - greatest(y0, ty * 8)), 9) as area, greatest(x0, tx * 8)::double as x_min, least(y0 + h, ty * 8 + 8)::double as y_max from feature, range(0, 5) a(tx), range(0, 3) b(ty) where greatest(x0, tx * 8) < least(x0 + w, tx * 8 + 8) and greatest(y0, ty * 8) < least(y0 + h, ty * 8 + 8)")
def clip_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clip(rings(spark, sf_dir).select("feature_id", "ring"), 8.0, 4, 2)
    return c.select("feature_id", "tx", "ty", F.round(ring_area(F.col("ring")), 9).alias("area"), F.array_min(F.transform("ring", lambda p: p["x"])).alias("x_min"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("y_max"))
