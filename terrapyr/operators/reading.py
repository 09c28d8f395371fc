"""Tile reads end to end: from sources' cells to the pixels and posts of tiles, in one plan each.

A tile meets its sources by keys (`tiling.touching`), a pair becomes a window of cells and a
window of pixels by arithmetic, pixels look up their cells by an equi-join, and a pixel's few
sources are drawn in order. No raster is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import CELL_SQL, cells, cte, fixture
from ..functions import extents as E
from ..registry import query
from . import tiling
from .tiling import KEY, TILE_BOX

#: Fixed value: how much larger a window must become for its cells to be mixed.
TOLERANCE = 1.1
IMAGE_PIXELS, TERRAIN_POSTS, SIDE = 16, 9, 8
ORDER = ["layer", "coarse", "source_id"]


def gated(tiles: DataFrame, sources: DataFrame) -> DataFrame:
    """the pairs of a tile and a source that is read into it, with the tile's box and the common one."""
    p = tiling.touching(tiles, sources).where("min_level <= level").withColumns(tiling.tile_box())
    common = dict(zip(("ix0", "iy0", "ix1", "iy1"), E.intersection(E.BOX, ("tx0", "ty0", "tx1", "ty1"))))
    return p.withColumns(common).where(E.has_area(("ix0", "iy0", "ix1", "iy1")))


def window(low: str, high: str, origin: str, end: str, n: Column) -> tuple[Column, Column]:
    """The first of n cells between origin and end that [low, high] touches, and how many it does."""
    at = lambda v: n * (F.col(v) - F.col(origin)) / (F.col(end) - F.col(origin))
    first = F.greatest(F.floor(at(low)), F.lit(0))
    return first, F.least(F.ceil(at(high)), n) - first


def windows(pairs: DataFrame, pixels: int) -> DataFrame:
    """Sx, sy, sw, sh: cells of the source; dx, dy, dw, dh: pixels of the tile."""
    out = {}
    for a, n in (("x", "num_x"), ("y", "num_y")):
        size = "w" if a == "x" else "h"
        out[f"s{a}"], out[f"s{size}"] = window(f"i{a}0", f"i{a}1", f"{a}_min", f"{a}_max", F.col(n))
        out[f"d{a}"], out[f"d{size}"] = window(f"i{a}0", f"i{a}1", f"t{a}0", f"t{a}1", F.lit(pixels))
    return pairs.withColumns(out).where("sw > 0 and sh > 0 and dw > 0 and dh > 0")


def read_images(tiles: DataFrame, sources: DataFrame, raster: DataFrame, pixels: int) -> DataFrame:
    """(tile, layer, px, py, v). raster: (source_id, c, r, v) with r from below; 0 is clear. Where a window grows by more than a tenth its cells are mixed, else each pixel takes the cell under its middle; the sources of a layer are drawn coarsest first."""
    p = windows(gated(tiles, sources), pixels)
    grows = ((F.col("dw") > TOLERANCE * F.col("sw")) | (F.col("dh") > TOLERANCE * F.col("sh"))) & (F.col("sw") >= 2) & (F.col("sh") >= 2)
    p = p.select(*KEY, "layer", "source_id", (-(F.col("x_max") - F.col("x_min")) / F.col("num_x")).alias("coarse"), "sx", "sy", "sw", "sh", "dx", "dy", "dw", "dh", grows.alias("grows"))
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dw") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dh") - 1)))
    mixed = lambda i, d, s: F.when(F.col(d) > 1, F.col(i) * (F.col(s) - 1) / (F.col(d) - 1)).otherwise(0.0)
    middle = lambda i, d, s: F.floor((F.col(i) + 0.5) * F.col(s) / F.col(d)).cast("double")
    p = p.withColumns({"x": F.when(F.col("grows"), mixed("i", "dw", "sw")).otherwise(middle("i", "dw", "sw")), "y": F.when(F.col("grows"), mixed("j", "dh", "sh")).otherwise(middle("j", "dh", "sh"))})
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corner = lambda a, b, w: F.struct((F.col("sx") + F.floor("x") + a).cast("int").alias("c"), (F.col("sy") + F.floor("y") + b).cast("int").alias("r"), w.alias("w"))
    p = p.withColumn("q", F.explode(F.filter(F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy)), lambda q: q["w"] > 0)))
    p = p.select(*KEY, *ORDER, (F.col("dx") + F.col("i")).cast("int").alias("px"), (F.col("dy") + F.col("j")).cast("int").alias("py"), "q.c", "q.r", "q.w")
    seen = p.join(raster.select("source_id", "c", "r", "v"), ["source_id", "c", "r"]).groupBy(*KEY, *ORDER, "px", "py").agg(F.floor(F.round(F.sum(F.col("w") * F.col("v")), 6)).cast("int").alias("v"))
    # Black is clear where a source has no alpha.
    return seen.where("v <> 0").groupBy(*KEY, "layer", "px", "py").agg(F.max_by("v", F.struct("coarse", "source_id")).alias("v"))


def read_heights(tiles: DataFrame, sources: DataFrame, raster: DataFrame, posts: int, offset: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(tile, px, py, h). Every post of a tile takes the mix of the four posts around it, of one source after the other, coarsest first; where a source has no data, the height so far stands in. What a source adds is a + m * (height so far), so a post folds pairs of numbers."""
    p = gated(tiles, sources)
    p = p.withColumns(dict(zip(("dx", "dw"), window("ix0", "ix1", "tx0", "tx1", F.lit(posts))))).withColumns(dict(zip(("dy", "dh"), window("iy0", "iy1", "ty0", "ty1", F.lit(posts)))))
    p = p.where("dw > 0 and dh > 0")
    p = p.withColumn("px", F.explode(F.sequence(F.col("dx"), F.col("dx") + F.col("dw") - 1))).withColumn("py", F.explode(F.sequence(F.col("dy"), F.col("dy") + F.col("dh") - 1)))
    area = F.col("data_type") != "VECTOR"

    def at(i: str, lo: str, hi: str, s: str, e: str, n: str) -> Column:
        x = F.col(lo) + (F.col(hi) - F.col(lo)) / (posts - 1) * F.col(i)
        step = (F.col(e) - F.col(s)) / (F.col(n) - F.when(area, 0).otherwise(1))
        return (x - F.col(s)) / step - F.when(area, 0.5).otherwise(0.0)

    p = p.select(*KEY, "layer", "source_id", (-(F.col("x_max") - F.col("x_min")) / F.col("num_x")).alias("coarse"), "px", "py", "num_x", "num_y", at("px", "tx0", "tx1", "x_min", "x_max", "num_x").alias("x"), at("py", "ty0", "ty1", "y_min", "y_max", "num_y").alias("y"))

    def ends(v: str, n: str) -> tuple[Column, Column, Column]:
        past = F.greatest(F.least(F.ceil(v), F.col(n) - 1), F.lit(0))
        return F.least(F.greatest(F.floor(v), F.lit(0)), past), past, F.col(v) - F.col(v).cast("long")

    (c0, c1, fx), (r0, r1, fy) = ends("x", "num_x"), ends("y", "num_y")
    corner = lambda c, r, w: F.struct(c.cast("int").alias("c"), r.cast("int").alias("r"), w.alias("w"))
    p = p.withColumn("q", F.explode(F.filter(F.array(corner(c0, r0, (1 - fx) * (1 - fy)), corner(c1, r0, fx * (1 - fy)), corner(c0, r1, (1 - fx) * fy), corner(c1, r1, fx * fy)), lambda q: q["w"] != 0)))
    p = p.select(*KEY, *ORDER, F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "q.c", "q.r", "q.w")
    seen = p.join(raster.select("source_id", "c", "r", "v"), ["source_id", "c", "r"], "left").groupBy(*KEY, *ORDER, "px", "py").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("a"), F.sum(F.when(F.col("v").isNull(), F.col("w")).otherwise(0.0)).alias("m"))
    drawn = F.aggregate(F.array_sort(F.collect_list(F.struct(*ORDER, "a", "m"))), F.lit(0.0), lambda h, s: F.lit(offset) + F.lit(scale) * s["a"] + s["m"] * h)
    return seen.groupBy(*KEY, "px", "py").agg(drawn.alias("h"))


def _levels(tiles: DataFrame) -> DataFrame:
    return tiles.where("level in (4, 7)")


def _rasters(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Sources of a kind that have cells, as rasters of 8 x 8, and the cells."""
    c = cells(spark, sf_dir)
    s = fixture(spark, sf_dir, "source").where(F.col("source_type") == kind).withColumns({"num_x": F.lit(SIDE), "num_y": F.lit(SIDE)})
    return s.join(c.select("source_id").distinct(), "source_id", "left_semi"), c


_HAVE = ", " + CELL_SQL + ", have as (select distinct source_id from cell), src8 as (select * replace (8 as num_x, 8 as num_y) from source where source_id in (select source_id from have) and source_type = '{kind}')"
def _pairs_sql(kind: str) -> str:
    """Every tile of the two levels against every source of the kind: that it lies under one of the source's tiles of level k (or above), then the gates, written as plain comparisons."""
    shift = "case when a.level >= p.k then case when p.k = 0 then true else (a.tile_x >> (a.level - p.k)) between kx0 and kx1 and (a.tile_y >> (a.level - p.k)) between ky0 and ky1 end else true end"
    return (
        tiling.SRC + tiling.TILES + _HAVE.format(kind=kind)
        + ", k8 as (select source_id, cast(greatest(0, least(cast(greatest(ceil(1 + ln(360.0::double / (2 * ((x_max - x_min) / num_x) * t)) / ln(2::double)), ceil(1 + ln(180.0::double / (((y_max - y_min) / num_y) * t)) / ln(2::double))) as int), max_level, 9)) as int) as k from (select *, case when source_type = 'IMAGE' then 254 else 63 end as t from src8))"
        + ", p as (select s.*, k, case when k = 0 then 1 else 2 * (1 << (k - 1)) end as nx, case when k = 0 then 1 else 1 << (k - 1) end as ny from src8 s join k8 using (source_id))"
        + ", q as (select *, greatest(0, floor((x_min + 180) / 360 * nx))::int as kx0, least(nx, ceil((x_max + 180) / 360 * nx))::int - 1 as kx1, greatest(0, floor((y_min + 90) / 180 * ny))::int as ky0, least(ny, ceil((y_max + 90) / 180 * ny))::int - 1 as ky1 from p)"
        + f", pair as (select a.*, p.source_id, p.layer, p.data_type, p.x_min, p.x_max, p.y_min, p.y_max, greatest(x_min, tx0) as ix0, least(x_max, tx1) as ix1, greatest(y_min, ty0) as iy0, least(y_max, ty1) as iy1 from (select *, {TILE_BOX} from tiles where level in (4, 7)) a join q p on a.level between p.min_level and p.max_level and {shift} where greatest(x_min, tx0) < least(x_max, tx1) and greatest(y_min, ty0) < least(y_max, ty1))"
    )


def _win(a: str, b: str, lo: str, hi: str, n: int) -> str:
    return f"greatest(floor({n} * ({a} - {lo}) / ({hi} - {lo})), 0)::int as {{0}}, (least(ceil({n} * ({b} - {lo}) / ({hi} - {lo})), {n}) - greatest(floor({n} * ({a} - {lo}) / ({hi} - {lo})), 0))::int as {{1}}"


_IMAGES = (
    _pairs_sql("IMAGE")
    + ", win as (select *, " + ", ".join([_win("ix0", "ix1", "x_min", "x_max", 8).format("sx", "sw"), _win("iy0", "iy1", "y_min", "y_max", 8).format("sy", "sh"), _win("ix0", "ix1", "tx0", "tx1", 16).format("dx", "dw"), _win("iy0", "iy1", "ty0", "ty1", 16).format("dy", "dh")]) + " from pair)"
    + ", px as (select *, (dw > 1.1::double * sw or dh > 1.1::double * sh) and sw >= 2 and sh >= 2 as grows from win, range(0, 16) a(i), range(0, 16) b(j) where i < dw and j < dh and sw > 0 and sh > 0)"
    + ", spot as (select *, case when grows then case when dw > 1 then i * (sw - 1)::double / (dw - 1) else 0.0::double end else floor((i + 0.5::double) * sw / dw) end as x, case when grows then case when dh > 1 then j * (sh - 1)::double / (dh - 1) else 0.0::double end else floor((j + 0.5::double) * sh / dh) end as y from px)"
    + ", near as (select *, sx + floor(x)::int + a as c, sy + floor(y)::int + b as r, (case when a = 0 then 1 - (x - floor(x)) else x - floor(x) end) * (case when b = 0 then 1 - (y - floor(y)) else y - floor(y) end) as w from spot, (values (0, 0), (1, 0), (0, 1), (1, 1)) o(a, b))"
    + ", seen as (select level, tile_x, tile_y, layer, source_id, -(x_max - x_min) / 8 as coarse, dx + i as px, dy + j as py, floor(round(sum(w * (floor(abs(v) * 1000)::int % 256)), 6))::int as v from near join cell using (source_id, c, r) where w > 0 group by all)"
    + " select level, tile_x, tile_y, layer, px::int as px, py::int as py, v from seen where v <> 0 qualify row_number() over (partition by level, tile_x, tile_y, layer, px, py order by coarse desc, source_id desc) = 1"
)


@query("S11_tile_images", _IMAGES)
def tile_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of every tile of two levels, one where windows shrink and one where they grow."""
    s, c = _rasters(spark, sf_dir, "IMAGE")
    byte = c.withColumn("v", F.floor(F.abs("v") * 1000).cast("int") % 256)
    return read_images(_levels(tiling.all_tiles(spark, sf_dir)), s, byte, IMAGE_PIXELS)


_HEIGHTS = (
    _pairs_sql("HEIGHT_FIELD")
    + ", win as (select *, " + ", ".join([_win("ix0", "ix1", "tx0", "tx1", 9).format("dx", "dw"), _win("iy0", "iy1", "ty0", "ty1", 9).format("dy", "dh")]) + " from pair)"
    + ", post as (select *, (tx0 + (tx1 - tx0) / 8 * px - x_min) / ((x_max - x_min) / case when data_type = 'VECTOR' then 7 else 8 end) - case when data_type = 'VECTOR' then 0.0::double else 0.5::double end as x, (ty0 + (ty1 - ty0) / 8 * py - y_min) / ((y_max - y_min) / case when data_type = 'VECTOR' then 7 else 8 end) - case when data_type = 'VECTOR' then 0.0::double else 0.5::double end as y from win, range(0, 9) a(px), range(0, 9) b(py) where px >= dx and px < dx + dw and py >= dy and py < dy + dh)"
    + ", e as (select *, greatest(least(ceil(x), 7), 0)::int as c1, greatest(least(ceil(y), 7), 0)::int as r1, x - trunc(x) as fx, y - trunc(y) as fy from post)"
    + ", f as (select *, least(greatest(floor(x), 0), c1)::int as c0, least(greatest(floor(y), 0), r1)::int as r0 from e)"
    + ", near as (select *, case when a = 0 then c0 else c1 end as c, case when b = 0 then r0 else r1 end as r, (case when a = 0 then 1 - fx else fx end) * (case when b = 0 then 1 - fy else fy end) as w from f, (values (0, 0), (1, 0), (0, 1), (1, 1)) o(a, b))"
    + ", seen as (select level, tile_x, tile_y, layer, source_id, -(x_max - x_min) / 8 as coarse, px, py, sum(w * coalesce(case when v >= 0 then v end, 0)) as a, sum(case when v >= 0 then 0 else w end) as m from near left join cell using (source_id, c, r) where w <> 0 group by all)"
    + ", line as (select level, tile_x, tile_y, px, py, list({'a': a, 'm': m} order by layer, coarse, source_id) as s from seen group by all)"
    + " select level, tile_x, tile_y, px::int as px, py::int as py, round(list_reduce(list_prepend({'a': 0.0::double, 'm': 0.0::double}, s), lambda h, x: {'a': 2.0::double * x.a + x.m * h.a, 'm': 0.0::double}).a, 6) + 0.0::double as h from line"
)


@query("S12_tile_heights", _HEIGHTS)
def tile_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _rasters(spark, sf_dir, "HEIGHT_FIELD")
    found = c.withColumn("v", F.when(F.col("v") >= 0, F.col("v")))
    return read_heights(_levels(tiling.all_tiles(spark, sf_dir)), s, found, TERRAIN_POSTS, scale=2.0).withColumn("h", F.round("h", 6) + 0.0)


# --- bytes with alpha -------------------------------------------------------------------------


def blend_bytes(stack: DataFrame, keys: list[str], order: list[str], channels: list[str], alpha: str) -> DataFrame:
    """R1 on bytes, over zero: with an alpha (not null) 0 leaves, 255 replaces and the rest mixes, cut to whole numbers, while alpha grows to the larger; without one black leaves and all else replaces, with full alpha. A pixel's sources are few and folded in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c).cast("int").alias(f"__v{i}") for i, c in enumerate(channels)], F.col(alpha).cast("int").alias("__a"))))
    n = range(len(channels))
    pixel = lambda v, a: F.struct(*[x.cast("int").alias(f"v{i}") for i, x in enumerate(v)], a.cast("int").alias("a"))

    def draw(d: Column, s: Column) -> Column:
        black = F.lit(True)
        for i in n:
            black = black & (s[f"__v{i}"] == 0)
        share = s["__a"].cast("double") / F.lit(255).cast("double")
        mix = [((F.lit(1).cast("double") - share) * d[f"v{i}"].cast("double") + share * s[f"__v{i}"].cast("double")).cast("int") for i in n]
        own = [s[f"__v{i}"] for i in n]
        return F.when(s["__a"].isNull(), F.when(black, d).otherwise(pixel(own, F.lit(255)))).when(s["__a"] == 0, d).when(s["__a"] == 255, pixel(own, s["__a"])).otherwise(pixel(mix, F.greatest(d["a"], s["__a"])))

    zero = pixel([F.lit(0)] * len(channels), F.lit(0))
    return stack.groupBy(*keys).agg(F.aggregate(ordered, zero, draw).alias("__drawn")).select(*keys, *[F.col(f"__drawn.v{i}").alias(c) for i, c in enumerate(channels)], F.col("__drawn.a").alias(alpha))


_MIX = "((1::double - x.a::double / 255::double) * d.{0}::double + x.a::double / 255::double * x.{0}::double)"


@query("R1_composite_bytes", cte("cell")[:-1] + ", b as (select source_id, source_id % 50 as grp, c, r, floor(abs(v) * 1000)::int % 256 as i, (source_id * 7 + c * 3 + r) % 5 as z from cell), l as (select grp, c, r, list({'red': case when z = 1 then 0 else i end, 'green': case when z = 1 then 0 else 255 - i end, 'a': case when source_id % 3 = 0 then null else case z when 0 then 0 when 4 then 255 else (z * 60)::int end end} order by source_id) as s from b group by all), f as (select grp, c, r, list_reduce(list_prepend({'red': 0, 'green': 0, 'a': 0}, s), lambda d, x: case when x.a is null then case when x.red = 0 and x.green = 0 then d else {'red': x.red, 'green': x.green, 'a': 255} end when x.a = 0 then d when x.a = 255 then x else {'red': trunc(" + _MIX.format("red") + ")::int, 'green': trunc(" + _MIX.format("green") + ")::int, 'a': greatest(d.a, x.a)} end) as p from l) select grp, c, r, p.red as red, p.green as green, p.a as alpha from f")
def composite_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with an alpha of several kinds and sources without one, in two channels."""
    i, z, k = F.floor(F.abs("v") * 1000).cast("int") % 256, (F.col("source_id") * 7 + F.col("c") * 3 + F.col("r")) % 5, F.col("source_id")
    alpha = F.when(k % 3 != 0, F.when(z == 0, 0).when(z == 4, 255).otherwise(z * 60)).cast("int")
    s = cells(spark, sf_dir).select("source_id", (k % 50).alias("grp"), "c", "r", F.when(z == 1, 0).otherwise(i).alias("red"), F.when(z == 1, 0).otherwise(255 - i).alias("green"), alpha.alias("alpha"))
    return blend_bytes(s, ["grp", "c", "r"], ["source_id"], ["red", "green"], "alpha")
