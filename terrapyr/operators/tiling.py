"""Tiles: coverage of sources, completion, attachment, neighbours, resolutions, tasks.

A source meets tiles by index arithmetic, never by comparing extents pair by pair: every
level's column and row ranges are computed per source and exploded, which leaves an
equi-keyed table. Coarse tiles collect many sources; aggregates combine before the shuffle.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import cte, fixture, spread
from ..functions import extents as E
from ..options import BuildOptions
from ..registry import query

WORLD = BuildOptions()
C1, R1, CAP = 2, 1, 9
KEY = ["level", "tile_x", "tile_y"]
#: What decides which tiles a source belongs to.
PLACE = [*E.BOX, "k"]
#: Fixed value: how much finer than its own step a source must be for a tile to divide.
SENSITIVITY = 0.9


def across(level: Column, first: int) -> Column:
    """Columns (rows) of a level: one at level 0, then `first` doubled."""
    return F.when(level == 0, 1).otherwise(F.lit(first) * F.call_function("shiftleft", F.lit(1), F.greatest(level - 1, F.lit(0)).cast("int")))


def placed(sources: DataFrame, o: BuildOptions = WORLD, cap: int = CAP) -> DataFrame:
    """Raster sources that can be placed, with their optimum level k."""
    box = (o.x_min, o.y_min, o.x_max, o.y_max)
    usable = sources.where(F.col("source_type").isin("IMAGE", "HEIGHT_FIELD") & (F.col("min_level") <= cap) & E.intersects(E.BOX, box, False))
    return usable.withColumn("k", E.optimum_level(o, C1, R1, cap, E.usable_tile(o)))


def coverage(sources: DataFrame, level: Column, o: BuildOptions = WORLD) -> DataFrame:
    """A row for every tile of `level` (a column expression, exploded if an array) that a source touches. No sequence is empty here; the outer explode keeps the optimizer from asking that, at length, as early as in the scan."""
    leveled = sources.withColumn("level", level)
    nx, ny = across(F.col("level"), C1), across(F.col("level"), R1)

    def span(low: str, high: str, origin: float, size: float, n: Column) -> tuple[Column, Column]:
        first = F.greatest(F.floor((F.col(low) - origin) / size * n), F.lit(0))
        past = F.least(F.ceil((F.col(high) - origin) / size * n), n)
        top = F.col("level") == 0
        return F.when(top, 0).otherwise(first), F.when(top, 1).otherwise(past)

    i0, i1 = span("x_min", "x_max", o.x_min, o.width, nx)
    j0, j1 = span("y_min", "y_max", o.y_min, o.height, ny)
    ranged = leveled.withColumns({"i0": i0, "i1": i1, "j0": j0, "j1": j1}).where("i0 < i1 and j0 < j1")  # sequence() would run backwards
    out = ranged.withColumn("tile_x", F.explode_outer(F.sequence("i0", F.col("i1") - 1))).withColumn("tile_y", F.explode_outer(F.sequence("j0", F.col("j1") - 1)))
    return out.drop("i0", "i1", "j0", "j1").withColumns({c: F.col(c).cast("int") for c in ("tile_x", "tile_y")})


def tile_sources(sources: DataFrame, o: BuildOptions = WORLD) -> DataFrame:
    """Coverage of all levels up to each source's optimum."""
    return coverage(placed(sources, o), F.explode_outer(F.sequence(F.lit(0), F.col("k"))), o)


# The oracle's coverage, in its own words.
PLACED = "placed as (select *, cast(greatest(0, least(cast(greatest(ceil(1 + ln(360.0::double / (2 * ((x_max - x_min) / num_x) * t)) / ln(2::double)), ceil(1 + ln(180.0::double / (((y_max - y_min) / num_y) * t)) / ln(2::double))) as int), max_level, 9)) as int) as k from (select *, case when source_type = 'IMAGE' then 254 else 63 end as t from source where source_type in ('IMAGE', 'HEIGHT_FIELD') and min_level <= 9 and x_max >= -180 and x_min <= 180 and y_max >= -90 and y_min <= 90))"
_RANGE = "select *, case when level = 0 then 0 else cast(greatest(floor((x_min + 180) / 360 * nx), 0) as int) end i0, case when level = 0 then 1 else cast(least(ceil((x_max + 180) / 360 * nx), nx) as int) end i1, case when level = 0 then 0 else cast(greatest(floor((y_min + 90) / 180 * ny), 0) as int) end j0, case when level = 0 then 1 else cast(least(ceil((y_max + 90) / 180 * ny), ny) as int) end j1 from (select *, case when level = 0 then 1 else 2 * (1 << (level - 1)) end nx, case when level = 0 then 1 else (1 << (level - 1)) end ny from ({leveled}))"


def covered_sql(leveled: str) -> str:
    return f"select * exclude (tile_y), cast(tile_y as int) as tile_y from (select *, unnest(range(j0, j1)) as tile_y from (select * exclude (tile_x), cast(tile_x as int) as tile_x from (select *, unnest(range(i0, i1)) as tile_x from ({_RANGE.format(leveled=leveled)}) where i0 < i1 and j0 < j1)))"


COVER = PLACED + ", cover as (" + covered_sql("select *, cast(unnest(range(0, k + 1)) as int) as level from placed") + ")"
SRC = cte("source")[:-1] + ", "


@query("P8_optimum_level", SRC + PLACED + " select source_id, k as optimum_level from placed")
def optimum_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(fixture(spark, sf_dir, "source")).select("source_id", F.col("k").alias("optimum_level"))


@query("J1_tile_coverage", SRC + COVER + " select level, tile_x, tile_y, count(*) as n_sources, min((x_max - x_min) / num_x) as finest_res from cover group by all")
def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tiles must be built, from how many sources, at what finest resolution."""
    return tile_sources(fixture(spark, sf_dir, "source")).groupBy(*KEY).agg(F.count("*").alias("n_sources"), F.min((F.col("x_max") - F.col("x_min")) / F.col("num_x")).alias("finest_res"))


TILE_BOX = "-180 + 360.0::double * tile_x / (case when level = 0 then 1 else 2 * (1 << (level - 1)) end) as tx0, -180 + 360.0::double * (tile_x + 1) / (case when level = 0 then 1 else 2 * (1 << (level - 1)) end) as tx1, -90 + 180.0::double * tile_y / (case when level = 0 then 1 else (1 << (level - 1)) end) as ty0, -90 + 180.0::double * (tile_y + 1) / (case when level = 0 then 1 else (1 << (level - 1)) end) as ty1"


def tile_box(o: BuildOptions = WORLD) -> dict[str, Column]:
    nx, ny = across(F.col("level"), C1), across(F.col("level"), R1)
    return {"tx0": o.x_min + F.lit(o.width) * F.col("tile_x") / nx, "tx1": o.x_min + F.lit(o.width) * (F.col("tile_x") + 1) / nx, "ty0": o.y_min + F.lit(o.height) * F.col("tile_y") / ny, "ty1": o.y_min + F.lit(o.height) * (F.col("tile_y") + 1) / ny}


@query("J2_exact_intersection", SRC + COVER + f" select level, tile_x, tile_y, count(*) as n from (select *, {TILE_BOX} from cover) where greatest(x_min, tx0) <= least(x_max, tx1) and greatest(y_min, ty0) <= least(y_max, ty1) and level between min_level and max_level group by all")
def exact_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 after J1, with the read gate F3."""
    hit = tile_sources(fixture(spark, sf_dir, "source")).withColumns(tile_box())
    return hit.where(E.intersects(E.BOX, ("tx0", "ty0", "tx1", "ty1"), False) & F.col("level").between(F.col("min_level"), F.col("max_level"))).groupBy(*KEY).agg(F.count("*").alias("n"))


@query("F3_read_gate", SRC + COVER + " select source_id, count(*) filter (where level between min_level and max_level) as readable, count(*) as placed from cover group by 1")
def read_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = F.col("level").between(F.col("min_level"), F.col("max_level"))
    return tile_sources(fixture(spark, sf_dir, "source")).groupBy("source_id").agg(F.count_if(gate).alias("readable"), F.count("*").alias("placed"))


def complete(tiles: DataFrame) -> DataFrame:
    """A parent with some children gets all (four; C1 x R1 under the root). One pass is enough: new tiles are leaves."""
    parents = tiles.where("level > 0").select((F.col("level") - 1).alias("pl"), F.when(F.col("level") == 1, 0).otherwise(F.expr("shiftright(tile_x, 1)")).alias("px"), F.when(F.col("level") == 1, 0).otherwise(F.expr("shiftright(tile_y, 1)")).alias("py")).distinct()
    dx = F.explode(F.sequence(F.lit(0), F.when(F.col("pl") == 0, C1 - 1).otherwise(1)))
    kids = parents.withColumn("dx", dx).withColumn("dy", F.explode(F.sequence(F.lit(0), F.when(F.col("pl") == 0, R1 - 1).otherwise(1))))
    kids = kids.select((F.col("pl") + 1).alias("level"), (F.col("px") * 2 + F.col("dx")).cast("int").alias("tile_x"), (F.col("py") * 2 + F.col("dy")).cast("int").alias("tile_y"))
    return tiles.select(*KEY).union(kids).distinct()


TILES = COVER + ", base as (select distinct level, tile_x, tile_y from cover), parents as (select distinct level - 1 as pl, case when level = 1 then 0 else tile_x >> 1 end as px, case when level = 1 then 0 else tile_y >> 1 end as py from base where level > 0), tiles as (select level, tile_x, tile_y from base union select pl + 1, cast(px * 2 + dx as int), cast(py * 2 + dy as int) from parents, range(0, 2) a(dx), range(0, 2) b(dy) where pl > 0 or dy = 0)"


def all_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spread(placed(fixture(spark, sf_dir, "source")).select(*PLACE), *PLACE).distinct()  # sources of one place have the same tiles
    return complete(coverage(places, F.explode_outer(F.sequence(F.lit(0), F.col("k")))).select(*KEY).distinct())


@query("G2_sibling_completion", SRC + TILES + " select * from tiles")
def sibling_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_tiles(spark, sf_dir)


@query("A22_children_count", SRC + TILES + ", kids as (select level - 1 as level, case when level = 1 then 0 else tile_x >> 1 end as tile_x, case when level = 1 then 0 else tile_y >> 1 end as tile_y from tiles where level > 0) select level, tile_x, tile_y, children, children = case when level = 0 then 2 else 4 end as complete from (select level, tile_x, tile_y, count(*) as children from kids group by all)")
def children_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = all_tiles(spark, sf_dir).where("level > 0").select(_half("tile_x"), _half("tile_y"), (F.col("level") - 1).alias("level"))
    return kids.groupBy(*KEY).agg(F.count("*").alias("children")).withColumn("complete", F.col("children") == F.when(F.col("level") == 0, C1 * R1).otherwise(4))


def _half(c: str) -> Column:
    return F.when(F.col("level") == 1, 0).otherwise(F.shiftright(c, 1)).alias(c)


#: Coarse ancestors hold many tiles; each is dealt over so many parts, with its sources repeated.
PARTS, COARSE = 16, 3


def attach(tiles: DataFrame, sources: DataFrame, o: BuildOptions = WORLD) -> DataFrame:
    """Below its optimum level a source belongs to the tiles that it covers; at that level, to them and all their descendants. Each tile finds its ancestor at level k by a shift, so both are equi-joins."""
    cover = tile_sources(sources, o).select(*KEY, "source_id", "k")
    upper = cover.where("level < k").select(*KEY, "source_id")
    return upper.union(beneath(tiles, cover.where("level >= k").select(*KEY, "source_id")).select(*KEY, "source_id"))


def ancestors(tiles: DataFrame) -> DataFrame:
    """Each tile with every tile (k, ax, ay) that it is or lies under."""
    shift = lambda c: F.when(F.col("k") == 0, 0).otherwise(F.expr(f"shiftright({c}, level - k)"))
    return tiles.withColumn("k", F.explode(F.sequence(F.lit(0), "level"))).withColumns({"ax": shift("tile_x"), "ay": shift("tile_y")})


def beneath(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tiles with the other columns of every node (a tile's key and more) that they are or lie under. Both sides are estimated by the few sources behind them, so neither is broadcast."""
    parts = F.when(F.col("level") < COARSE, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    at = nodes.withColumn("part", F.explode(parts)).withColumnsRenamed({"level": "k", "tile_x": "ax", "tile_y": "ay"})
    up = ancestors(tiles).withColumn("part", F.when(F.col("k") < COARSE, F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int")).otherwise(0))
    return up.join(at.hint("merge"), ["k", "ax", "ay", "part"]).drop("k", "ax", "ay", "part")


def attachments(tiles: DataFrame, sources: DataFrame, o: BuildOptions = WORLD) -> tuple[DataFrame, DataFrame]:
    """G3 counted, not listed: the placed sources (source_id, place), and for each place the tiles of each level that its sources are attached to: (place, sources, level, n). A tile tells its ancestors that it is there, and a place reads it off its tiles of level k (asked by >=, as from an equality the optimizer would infer long filters for the scan): rows grow with the places' own tiles, not with all tiles under them."""
    s = spread(placed(sources, o).select("source_id", *PLACE), *PLACE)
    nodes = coverage(s.groupBy(*PLACE).agg(F.count("*").alias("sources")), F.explode_outer(F.sequence(F.lit(0), F.col("k"))), o)
    who = [*PLACE, "sources"]
    upper = nodes.where("level < k").groupBy(*who, "level").agg(F.count("*").alias("n"))
    held = ancestors(tiles).groupBy("k", "ax", "ay", "level").agg(F.count("*").alias("n")).groupBy("k", "ax", "ay").agg(F.collect_list(F.struct("level", "n")).alias("held"))
    at = nodes.where("level >= k").select(*who, F.col("tile_x").alias("ax"), F.col("tile_y").alias("ay"))
    lower = at.join(held.hint("merge"), ["k", "ax", "ay"]).select(*who, F.explode("held").alias("h")).groupBy(*who, "h.level").agg(F.sum("h.n").alias("n"))
    return s, upper.union(lower)


def levels_of(sources: DataFrame, places: DataFrame) -> DataFrame:
    """(source_id, bits): a bit for every level that a source's place is attached to."""
    bits = places.groupBy(*PLACE).agg(F.bit_or(F.expr("shiftleft(1L, level)")).alias("bits"))
    return sources.where("source_id is not null").join(bits.hint("merge"), PLACE).groupBy("source_id").agg(F.bit_or("bits").alias("bits"))


ATTACH = TILES + ", attached as (select level, tile_x, tile_y, source_id from cover where level < k union all select t.level, t.tile_x, t.tile_y, c.source_id from tiles t join cover c on c.level = c.k and t.level >= c.k and case when c.k = 0 then true else (t.tile_x >> (t.level - c.k)) = c.tile_x and (t.tile_y >> (t.level - c.k)) = c.tile_y end)"


@query("G3_source_attachment", SRC + ATTACH + " select level, count(*) as attached, count(distinct source_id) as sources from attached group by 1")
def source_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, places = attachments(all_tiles(spark, sf_dir), fixture(spark, sf_dir, "source"))
    rows = places.groupBy("level").agg(F.sum(F.col("sources") * F.col("n")).alias("attached"))
    level = F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda l: F.getbit("bits", l) == 1))
    ids = levels_of(s, places).groupBy("bits").agg(F.count("*").alias("sources")).select(level.alias("level"), "sources").groupBy("level").agg(F.sum("sources").alias("sources"))
    return rows.join(ids.hint("merge"), "level", "left").select("level", "attached", F.coalesce("sources", F.lit(0)).alias("sources"))


#: Under its optimum level a source is dealt out to tiles of this level at least, so that no coarse tile is a key for all below it.
DEAL = 6


def touching(tiles: DataFrame, sources: DataFrame, o: BuildOptions = WORLD) -> DataFrame:
    """The attached pairs (G3) of a tile and a source whose closed extents meet and whose levels go deep enough: (tile key, source columns).

    Down to level D, the larger of k and DEAL, a source's tiles are index ranges, widened by
    the tiles that it only touches and kept inside the ranges of level k. Tiles beneath look
    up their ancestor at level D. Both are equi-joins; extents are compared on what meets.
    """
    deal = F.greatest("k", F.least(F.lit(DEAL), F.col("max_level")))
    s = placed(sources, o).withColumn("deal", deal).withColumn("level", F.explode(F.sequence(F.lit(0), F.least("deal", "max_level"))))
    deep, root = F.col("level") > F.col("k"), F.col("k") == 0  # everything lies under the root
    under = lambda v: v * F.expr("shiftleft(1, greatest(level - k, 0))")

    def tiles_of(low: str, high: str, origin: float, size: float, first: int) -> Column:
        n, nk = across(F.col("level"), first), across(F.col("k"), first)
        a, b = (F.col(low) - origin) / size, (F.col(high) - origin) / size
        begin = F.greatest(F.when(deep, F.ceil(a * n) - 1).otherwise(F.floor(a * n)), F.when(deep & ~root, under(F.floor(a * nk))).otherwise(0), F.lit(0))
        past = F.least(F.when(deep, F.floor(b * n) + 1).otherwise(F.ceil(b * n)), F.when(deep & ~root, under(F.ceil(b * nk))).otherwise(n), n)
        begin, past = F.when(F.col("level") == 0, 0).otherwise(begin), F.when(F.col("level") == 0, 1).otherwise(past)
        return F.filter(F.sequence(begin, F.greatest(begin, past)), lambda i: i < past)  # an empty range gives no tile

    s = s.withColumn("tile_x", F.explode(tiles_of("x_min", "x_max", o.x_min, o.width, C1)))
    s = s.withColumn("tile_y", F.explode(tiles_of("y_min", "y_max", o.y_min, o.height, R1))).withColumns({c: F.col(c).cast("int") for c in KEY})
    direct = tiles.join(s.hint("merge"), KEY)
    held = s.where("level = deal and max_level > deal").withColumnsRenamed({"level": "d", "tile_x": "ax", "tile_y": "ay"})
    below = tiles.withColumn("d", F.explode(F.sequence(F.lit(0), "level"))).where("d < level")
    shift = lambda c: F.when(F.col("d") == 0, 0).otherwise(F.expr(f"shiftright({c}, level - d)")).cast("int")
    lower = below.withColumns({"ax": shift("tile_x"), "ay": shift("tile_y")}).join(held.hint("merge"), ["d", "ax", "ay"]).where("max_level >= level")
    both = direct.unionByName(lower.drop("d", "ax", "ay")).drop("deal")
    return both.withColumns(tile_box(o)).where(E.intersects(E.BOX, ("tx0", "ty0", "tx1", "ty1"), False)).drop("tx0", "ty0", "tx1", "ty1")


_RES = "(x_max - x_min) / (case when data_type = 'VECTOR' then num_x - 1 else num_x end) as rx, (y_max - y_min) / (case when data_type = 'VECTOR' then num_y - 1 else num_y end) as ry"


def resolutions(tiles: DataFrame, sources: DataFrame, o: BuildOptions = WORLD) -> DataFrame:
    """A3: finest steps of every tile, by layer and optional set for imagery, in one group for terrain, from the sources that reach its level and meet its extents."""
    n = lambda c: F.col(c) - F.when(F.col("data_type") == "VECTOR", 1).otherwise(0)
    image = F.col("source_type") == "IMAGE"
    own = sources.where("num_x <> 0 and num_y <> 0")
    # Sources alike in all that is asked here are one; what is left is dealt out, as each has many tiles.
    own = own.select("source_type", *E.BOX, "num_x", "num_y", "data_type", "layer", "set_name", "min_level", "max_level")
    own = spread(own, *own.columns).distinct()
    s = touching(tiles, own, o).select(*KEY, "max_level", F.when(image, F.col("layer")).otherwise(-1).alias("layer"), F.when(image, F.col("set_name")).otherwise("").alias("set_name"), ((F.col("x_max") - F.col("x_min")) / n("num_x")).alias("rx"), ((F.col("y_max") - F.col("y_min")) / n("num_y")).alias("ry"))
    return s.groupBy(*KEY, "layer", "set_name").agg(F.min("rx").alias("res_x"), F.min("ry").alias("res_y"), F.max("max_level").alias("max_source_level"))


# Each tile and each source attached to it: a source that ends above the tile's level is skipped, then one that does not overlap it; what is left gives its steps.
_MEET = ", boxed as (select *, {box} from attached), meet as (select b.*, s.* exclude (source_id), {res} from boxed b join source s using (source_id) where not s.max_level < b.level and not (least(s.x_max, b.tx1) < greatest(s.x_min, b.tx0)) and not (least(s.y_max, b.ty1) < greatest(s.y_min, b.ty0)) and s.num_x <> 0 and s.num_y <> 0)"
A3 = "select level, tile_x, tile_y, case when source_type = 'IMAGE' then layer else -1 end as layer, case when source_type = 'IMAGE' then set_name else '' end as set_name, min(rx) as res_x, min(ry) as res_y, max(max_level) as max_source_level from meet group by all"
MEET = _MEET.format(box=TILE_BOX, res=_RES)


@query("A3_finest_resolution", SRC + ATTACH + MEET + " " + A3)
def finest_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolutions(all_tiles(spark, sf_dir), fixture(spark, sf_dir, "source"))


@query("G1_new_pyramid", SRC + ATTACH + MEET + f", res as ({A3}) select level, count(*) as groups, count(distinct (tile_x, tile_y)) as tiles, min(res_x) as finest, max(max_source_level) as deepest from res group by 1")
def new_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, completion, attachment and resolutions in one plan."""
    r = resolutions(all_tiles(spark, sf_dir), fixture(spark, sf_dir, "source"))
    return r.groupBy("level").agg(F.count("*").alias("groups"), F.count_distinct("tile_x", "tile_y").alias("tiles"), F.min("res_x").alias("finest"), F.max("max_source_level").alias("deepest"))


_ASKED = "asked as (select distinct l.l as level, cast(greatest(0, least(floor(((x_min + x_max) / 2 + 180) / 360 * 2 * (1 << (l.l - 1))), 2 * (1 << (l.l - 1)) - 1)) as int) as tile_x, cast(greatest(0, least(floor(((y_min + y_max) / 2 + 90) / 180 * (1 << (l.l - 1))), (1 << (l.l - 1)) - 1)) as int) as tile_y from source, (values (5), (8)) l(l))"


@query("J3_quadmap_lookup", SRC + TILES + f", {_ASKED} select a.level, a.tile_x, a.tile_y, t.level is not null as present from asked a left join tiles t on a.level = t.level and a.tile_x = t.tile_x and a.tile_y = t.tile_y")
def quadmap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the tiles under the sources' centres are there, at two levels."""
    o, s = WORLD, fixture(spark, sf_dir, "source").withColumn("level", F.explode(F.array(F.lit(5), F.lit(8))))

    def at(low: str, high: str, origin: float, size: float, first: int) -> Column:
        n = across(F.col("level"), first)
        return F.greatest(F.lit(0), F.least(F.floor(((F.col(low) + F.col(high)) / 2 - origin) / size * n), n - 1)).cast("int")

    asked = s.select("level", at("x_min", "x_max", o.x_min, o.width, C1).alias("tile_x"), at("y_min", "y_max", o.y_min, o.height, R1).alias("tile_y")).distinct()
    return asked.join(all_tiles(spark, sf_dir).withColumn("present", F.lit(True)), KEY, "left").withColumn("present", F.coalesce("present", F.lit(False)))


#: Neighbours 0 to 7, counter-clockwise from the left.
AROUND = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]


def neighbours(tiles: DataFrame) -> DataFrame:
    """Which of the eight neighbours of every tile exist. Each tile reports itself to the tiles around it, so one aggregate does without a join; what has no row of its own is dropped."""
    told = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("bit"), F.lit(True).alias("own")), *[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(1 << p).alias("bit"), F.lit(False).alias("own")) for p, (dx, dy) in enumerate(AROUND)])
    said = tiles.select(*KEY, F.explode(told).alias("t")).select("level", (F.col("tile_x") + F.col("t.dx")).alias("tile_x"), (F.col("tile_y") + F.col("t.dy")).alias("tile_y"), "t.bit", "t.own").where("tile_x >= 0 and tile_y >= 0")
    met = said.groupBy(*KEY).agg(F.bool_or("own").alias("own"), F.bit_or("bit").alias("bits"))
    return met.where("own").select(*KEY, F.col("bits").cast("long").alias("neighbour_bits"), F.bit_count("bits").cast("long").alias("n_neighbours"))


_OFF = "(values " + ", ".join(f"({p}, {dx}, {dy})" for p, (dx, dy) in enumerate(AROUND)) + ") o(p, dx, dy)"


@query("J4_neighbours", SRC + TILES + f", hit as (select t.level, t.tile_x, t.tile_y, p from tiles t, {_OFF} where exists (select 1 from tiles u where u.level = t.level and u.tile_x = t.tile_x + dx and u.tile_y = t.tile_y + dy)) select t.level, t.tile_x, t.tile_y, cast(coalesce(sum(1 << p), 0) as bigint) as neighbour_bits, count(p) as n_neighbours from tiles t left join hit using (level, tile_x, tile_y) group by all")
def neighbour_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(all_tiles(spark, sf_dir))


@query("J5_parent_link", SRC + TILES + " select c.level, c.tile_x, c.tile_y, p.tile_x as parent_x, p.tile_y as parent_y, (c.tile_x & 1) + 2 * (c.tile_y & 1) as quadrant from tiles c join tiles p on p.level = c.level - 1 and p.tile_x = case when c.level = 1 then 0 else c.tile_x >> 1 end and p.tile_y = case when c.level = 1 then 0 else c.tile_y >> 1 end")
def parent_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = all_tiles(spark, sf_dir)
    half = lambda c: F.when(F.col("level") == 1, 0).otherwise(F.shiftright(c, 1))
    c = tiles.where("level > 0").withColumns({"up": F.col("level") - 1, "parent_x": half("tile_x"), "parent_y": half("tile_y")})
    p = tiles.select(F.col("level").alias("up"), F.col("tile_x").alias("parent_x"), F.col("tile_y").alias("parent_y"))
    return c.join(p, ["up", "parent_x", "parent_y"]).select(*KEY, "parent_x", "parent_y", (F.col("tile_x").bitwiseAND(1) + 2 * F.col("tile_y").bitwiseAND(1)).alias("quadrant"))


@query("P10_tile_extents", SRC + TILES + f" select level, tile_x, tile_y, tx0, ty0, tx1, ty1, 'world_L' || level || '_X' || tile_x || '_Y' || tile_y as name from (select *, {TILE_BOX} from tiles)")
def tile_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_tiles(spark, sf_dir).withColumns(tile_box()).select(*KEY, "tx0", "ty0", "tx1", "ty1", F.format_string("world_L%d_X%d_Y%d", *KEY).alias("name"))


@query("P11_visible_distance", SRC + TILES + f" select level, tile_x, tile_y, round(sqrt((tx1 - tx0) ** 2 + (ty1 - ty0) ** 2) * 0.5 * 7.0, 3) as flat_distance, round(radians(tx1 - tx0) * 6378137.0 * 7.0 + (tx1 - tx0) / 360.0 * 6378137.0, 3) as round_distance from (select *, {TILE_BOX} from tiles)")
def visible_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, t = WORLD, all_tiles(spark, sf_dir).withColumns(tile_box())
    dx, dy = F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0")
    return t.select(*KEY, F.round(F.sqrt(dx * dx + dy * dy) * 0.5 * o.distance_ratio, 3).alias("flat_distance"), F.round(F.radians(dx) * o.equator_radius * o.distance_ratio + dx / 360.0 * o.equator_radius, 3).alias("round_distance"))


def image_size(extent: Column, res: Column, limit: int, power_of_two: bool = True, extension: str = "", posts: bool = False) -> Column:
    """As many pixels as the finest source asks for (one more where pixels are posts), at most `limit`, at least four; null without a source or a limit. Sizes that are no powers of two are multiples of four for `.dds`."""
    n = F.least(F.ceil(extent / res) + (1 if posts else 0), F.lit(limit)).cast("int")
    if power_of_two:
        size, step = F.lit(4), 4
        while step < limit:
            size = F.when(n > step, step * 2).otherwise(size)
            step *= 2
    else:
        size = F.greatest(F.lit(4), n)
        if extension == ".dds":
            size = F.when(size % 4 != 0, F.floor(size / 4) * 4 + 4).otherwise(size)
    return F.when(res.isNotNull() & (res != 0) & F.lit(limit != 0), size.cast("int"))


def terrain_size(extent: Column, res: Column, limit: int, posts: bool = True) -> Column:
    """P12 for heights: no rounding; null without a source or a limit."""
    return F.when(res.isNotNull() & (res != 0) & F.lit(limit != 0), F.least(F.ceil(extent / res) + (1 if posts else 0), F.lit(limit)).cast("int"))


def sized(res: DataFrame, o: BuildOptions = WORLD, image_posts: bool = False, terrain_posts: bool = True) -> DataFrame:
    """Rows of A3 with size_x, size_y and the steps that follow."""
    r = res.withColumns(tile_box(o))
    image = F.col("layer") >= 0
    out = {}
    for a, lo, hi in (("x", "tx0", "tx1"), ("y", "ty0", "ty1")):
        w, step = F.col(hi) - F.col(lo), F.col(f"res_{a}")
        out[f"size_{a}"] = F.when(image, image_size(w, step, o.image_tile, o.power_of_two, o.image_extension, image_posts)).otherwise(terrain_size(w, step, o.terrain_tile, terrain_posts))
    r = r.withColumns(out)
    less = F.when(image, 1 if image_posts else 0).otherwise(1 if terrain_posts else 0)
    r = r.withColumns({f"step_{a}": (F.col(hi) - F.col(lo)) / F.nullif(F.col(f"size_{a}") - less, F.lit(0)) for a, lo, hi in (("x", "tx0", "tx1"), ("y", "ty0", "ty1"))})
    return r.drop("tx0", "ty0", "tx1", "ty1")


_LADDER = "case " + " ".join(f"when n{{a}} <= {p} then {p}" for p in (4, 8, 16, 32, 64, 128)) + " else 256 end"
_P12 = f", res as ({A3}), sized as (select *, {TILE_BOX} from res), n as (select *, cast(least(ceil((tx1 - tx0) / res_x), 256) as int) nx, cast(least(ceil((ty1 - ty0) / res_y), 256) as int) ny, cast(least(1 + ceil((tx1 - tx0) / res_x), 64) as int) px, cast(least(1 + ceil((ty1 - ty0) / res_y), 64) as int) py from sized), p12 as (select *, case when layer >= 0 then {_LADDER.format(a='x')} else px end as size_x, case when layer >= 0 then {_LADDER.format(a='y')} else py end as size_y from n), steps as (select *, case when layer >= 0 then (tx1 - tx0) / size_x else (tx1 - tx0) / nullif(size_x - 1, 0) end as step_x, case when layer >= 0 then (ty1 - ty0) / size_y else (ty1 - ty0) / nullif(size_y - 1, 0) end as step_y from p12)"


@query("P12_tile_sizes", SRC + ATTACH + MEET + _P12 + " select level, tile_x, tile_y, layer, set_name, size_x, size_y, step_x, step_y from steps")
def tile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolutions(all_tiles(spark, sf_dir), fixture(spark, sf_dir, "source"))
    return sized(r).select(*KEY, "layer", "set_name", "size_x", "size_y", "step_x", "step_y")


_FOUR = "case when {n} % 4 = 0 then {n} else {n} - {n} % 4 + 4 end"


@query("P12_sizes_as_posts", SRC + ATTACH + MEET + f", res as ({A3}), n as (select *, greatest(4, least(100, 1 + ceil((tx1 - tx0) / res_x)))::int nx, greatest(4, least(100, 1 + ceil((ty1 - ty0) / res_y)))::int ny, least(50, ceil((tx1 - tx0) / res_x))::int px, least(50, ceil((ty1 - ty0) / res_y))::int py from (select *, {TILE_BOX} from res)) select level, tile_x, tile_y, layer, set_name, case when layer >= 0 then {_FOUR.format(n='nx')} else px end as size_x, case when layer >= 0 then {_FOUR.format(n='ny')} else py end as size_y from n")
def tile_sizes_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 where images are posts, sizes need not be powers of two, and heights are cells."""
    o = replace(WORLD, image_tile=100, terrain_tile=50, power_of_two=False)
    r = resolutions(all_tiles(spark, sf_dir), fixture(spark, sf_dir, "source"))
    return sized(r, o, image_posts=True, terrain_posts=False).select(*KEY, "layer", "set_name", "size_x", "size_y")


@query("P13_need_to_divide", SRC + ATTACH + MEET + _P12 + " select level, tile_x, tile_y, bool_or(step_x * 0.9::double > res_x) as divide_x, bool_or(step_y * 0.9::double > res_y) as divide_y from steps group by all")
def need_to_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile divides along an axis if its own step, less a tenth, is coarser than the finest source of one of its images or of its heights."""
    r = sized(resolutions(all_tiles(spark, sf_dir), fixture(spark, sf_dir, "source")))
    return r.groupBy(*KEY).agg(*[F.bool_or(F.col(f"step_{a}") * SENSITIVITY > F.col(f"res_{a}")).alias(f"divide_{a}") for a in "xy"])


@query("A2_maximum_level", SRC + PLACED + " select max(k) as max_level from placed")
def maximum_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(fixture(spark, sf_dir, "source")).agg(F.max("k").alias("max_level"))


def tile_map(sources: DataFrame, level: int) -> DataFrame:
    """A4: deepest level under each tile of one level; F12: only sources that reach deeper count."""
    return coverage(placed(sources).where(F.col("k") > level), F.lit(level)).groupBy("tile_x", "tile_y").agg(F.max("k").alias("max_level"))


@query("A4_tile_map", SRC + PLACED + ", cover as (" + covered_sql("select *, 3 as level from placed where k > 3") + ") select tile_x, tile_y, max(k) as max_level from cover group by all")
def tile_map_at_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_map(fixture(spark, sf_dir, "source"), 3)


def split_levels(deepest: Column, primary: Column | int = 0, secondary: Column | int = 0) -> tuple[Column, Column]:
    """Where to split a build into tasks once or twice. Levels that are given (not 0) stay as far as they can be used; a missing one follows from the other or from the deepest level."""
    p, s = (F.lit(x) if isinstance(x, int) else x for x in (primary, secondary))
    deep = deepest >= 10
    first = F.when(p != 0, p).when(s != 0, F.floor(s / 2)).when(deep, F.floor(deepest / 3)).otherwise(F.floor(deepest / 2))
    second = F.when(s != 0, s).when(~deep, 0).when(p != 0, p + F.floor((deepest - p) / 2)).otherwise(F.floor(2 * deepest / 3))
    first = F.when(first >= deepest, 0).otherwise(first).cast("int")
    second = F.when((second >= deepest) | (second <= first), 0).otherwise(second).cast("int")
    return first, second


@query("P33_split_levels", "select m as max_level, gp as given_primary, gs as given_secondary, p as primary_split, case when s >= m or (s <> 0 and s <= p) then 0 else s end as secondary_split from (select m, gp, gs, case when p >= m then 0 else p end as p, s from (select m, gp, gs, case when gp <> 0 then gp when gs <> 0 then gs // 2 when m < 10 then m // 2 else m // 3 end as p, case when gp = 0 and gs = 0 then case when m < 10 then 0 else (2 * m) // 3 end when gp <> 0 and gs = 0 and m >= 10 then gp + (m - gp) // 2 else gs end as s from (select cast(m as int) as m, gp, gs from range(0, 31) r(m), (values (0), (2), (5)) a(gp), (values (0), (3), (9)) b(gs))))")
def split_level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.range(31).select(F.col("id").cast("int").alias("max_level"), F.explode(F.array(*map(F.lit, (0, 2, 5)))).alias("given_primary")).withColumn("given_secondary", F.explode(F.array(*map(F.lit, (0, 3, 9)))))
    p, s = split_levels(F.col("max_level"), F.col("given_primary"), F.col("given_secondary"))
    return m.select("max_level", "given_primary", "given_secondary", p.alias("primary_split"), s.alias("secondary_split"))


@query("F7_subtile_crop", SRC + TILES + " select level, tile_x, tile_y from tiles where case when level < 4 then tile_x = 5 >> (4 - level) and tile_y = 3 >> (4 - level) else tile_x >> (level - 4) = 5 and tile_y >> (level - 4) = 3 end")
def subtile_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop(all_tiles(spark, sf_dir), 4, 5, 3)


def crop(tiles: DataFrame, level: int, x: int, y: int) -> DataFrame:
    """the tiles above and below one tile, by ranges on the key so that partitions are pruned."""
    up = F.col("level") < level
    low = lambda v: F.when(up, F.expr(f"shiftright({v}, greatest({level} - level, 0))")).otherwise(F.expr(f"shiftleft({v}, greatest(level - {level}, 0))"))
    past = lambda v: F.when(up, low(v) + 1).otherwise(F.expr(f"shiftleft({v} + 1, greatest(level - {level}, 0))"))
    return tiles.where((F.col("tile_x") >= low(x)) & (F.col("tile_x") < past(x)) & (F.col("tile_y") >= low(y)) & (F.col("tile_y") < past(y)))


@query("F11_skip_levels", SRC + TILES + ", kids as (select distinct level - 1 as level, case when level = 1 then 0 else tile_x >> 1 end as tile_x, case when level = 1 then 0 else tile_y >> 1 end as tile_y from tiles where level > 0) select t.level, t.tile_x, t.tile_y from tiles t anti join kids k on t.level = k.level and t.tile_x = k.tile_x and t.tile_y = k.tile_y where t.level >= 4")
def skip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves at or under the subtile level: what a bottom task records."""
    tiles = all_tiles(spark, sf_dir)
    kids = tiles.where("level > 0").select(_half("tile_x"), _half("tile_y"), (F.col("level") - 1).alias("level")).distinct()
    return tiles.where("level >= 4").join(kids, KEY, "left_anti")


@query("G18_build_tasks", SRC + PLACED + ", c2 as (" + covered_sql("select *, 1 as level from placed where k > 1") + "), c5 as (" + covered_sql("select *, 4 as level from placed where k > 4") + ") select 'root' as kind, 0 as level, 0 as tile_x, 0 as tile_y, 'world_root_L0_X0_Y0' as task_file union all select distinct 'intermediate', 2, tile_x, tile_y, 'world_subtile_L1_X' || tile_x || '_Y' || tile_y from c2 union all select distinct 'bottom', 5, tile_x, tile_y, 'world_subtile_L1_X' || (tile_x >> 3) || '_Y' || (tile_y >> 3) || '/world_subtile_L4_X' || tile_x || '_Y' || tile_y from c5")
def build_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(fixture(spark, sf_dir, "source"), 2, 5)


def tasks(sources: DataFrame, primary: int, secondary: int) -> DataFrame:
    """One task for the root, one for each tile above the splits; bottom tasks nest under their intermediate tile. Without a primary split the root's task is the whole build."""
    spark = sources.sparkSession
    if not primary:
        return spark.sql("select 'all' as kind, 0 as level, 0 as tile_x, 0 as tile_y, 'world_root_L0_X0_Y0' as task_file")
    out = spark.sql("select 'root' as kind, 0 as level, 0 as tile_x, 0 as tile_y, 'world_root_L0_X0_Y0' as task_file")
    first = tile_map(sources, primary - 1)
    own = lambda l: F.format_string(f"world_subtile_L{l}_X%d_Y%d", "tile_x", "tile_y")
    if not secondary:
        return out.union(first.select(F.lit("bottom"), F.lit(primary), "tile_x", "tile_y", own(primary - 1)))
    d = secondary - primary
    nested = F.concat(F.format_string(f"world_subtile_L{primary - 1}_X%d_Y%d/", F.shiftright("tile_x", d), F.shiftright("tile_y", d)), own(secondary - 1))
    return out.union(first.select(F.lit("intermediate"), F.lit(primary), "tile_x", "tile_y", own(primary - 1))).union(tile_map(sources, secondary - 1).select(F.lit("bottom"), F.lit(secondary), "tile_x", "tile_y", nested))


@query("A9_contributing_sources", SRC + ATTACH + " select level, tile_x, tile_y, count(distinct source_id) as n_sources, min(source_id) as first_source, max(source_id) as last_source from attached group by all")
def contributing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(all_tiles(spark, sf_dir), fixture(spark, sf_dir, "source"))


def contributions(tiles: DataFrame, sources: DataFrame, o: BuildOptions = WORLD) -> DataFrame:
    """The size and ends of each tile's set of attached sources (G3), which is never listed.

    A source belongs to a tile because it covers it above its level k, or because it covers
    the tile's ancestor at level k. Both are first summed up by tile, then every tile adds up
    its ancestors. That counts a source once, unless its id has several rows: of these each
    tile is kept once, and none that lies under another that the id has with all beneath it.
    """
    s = placed(sources, o).select("source_id", *PLACE).withColumn("rows", F.count("*").over(W.partitionBy("source_id")))
    told = [F.count("source_id").alias("n"), F.min("source_id").alias("lo"), F.max("source_id").alias("hi")]
    levels = F.explode_outer(F.sequence(F.lit(0), F.col("k")))
    once = spread(s.where("rows = 1 or source_id is null"), *PLACE).groupBy(*PLACE).agg(*told)
    once = coverage(once, levels, o).select(*KEY, (F.col("level") == F.col("k")).alias("whole"), "n", "lo", "hi")
    many = coverage(s.where("rows > 1 and source_id is not null"), levels, o).groupBy(*KEY, "source_id").agg(F.bool_or(F.col("level") == F.col("k")).alias("whole"))
    top = many.where("whole").select(F.col("level").alias("k"), F.col("tile_x").alias("ax"), F.col("tile_y").alias("ay"), "source_id")
    inner = ancestors(many).where("k < level").join(top.hint("merge"), ["k", "ax", "ay", "source_id"], "left_semi").select(*KEY, "source_id").distinct()
    many = many.join(inner.hint("merge"), [*KEY, "source_id"], "left_anti").select(*KEY, "whole", F.lit(1).cast("long").alias("n"), F.col("source_id").alias("lo"), F.col("source_id").alias("hi"))
    total = [F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    nodes = once.unionByName(many).groupBy(*KEY, "whole").agg(*total)
    both = nodes.where("not whole").drop("whole").unionByName(beneath(tiles, nodes.where("whole").drop("whole")))
    return both.groupBy(*KEY).agg(*total).withColumnsRenamed({"n": "n_sources", "lo": "first_source", "hi": "last_source"})


def contributors(tiles: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (tile, source) rows: A9's sets themselves."""
    return attach(tiles, sources).distinct()


@query("J15_contributing_semi", SRC + ATTACH + " select source_id, file_name from source where source_id in (select source_id from attached where level = 5)")
def contributing_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "source")
    ids = levels_of(*attachments(all_tiles(spark, sf_dir), s)).where(F.getbit("bits", F.lit(5)) == 1)
    return s.join(ids.hint("merge"), "source_id", "left_semi").select("source_id", "file_name")


@query("J12_dateline_pass", "with s as (select p_partkey as source_id, 178 + p_partkey % 4 + x as x0, 179 + p_partkey % 4 + x as x1, x from part, (values (-360), (0), (360)) v(x)) select source_id, x as turn, greatest(x0, -180) as x_from, least(x1, 180) as x_to from s where greatest(x0, -180) < least(x1, 180)")
def dateline_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted copies join like any other source; copies without area go."""
    s = fixture(spark, sf_dir, "source").select("source_id", F.explode(F.array(*[F.lit(x) for x in (-360, 0, 360)])).alias("turn"))
    x0, x1 = 178 + F.col("source_id") % 4 + F.col("turn"), 179 + F.col("source_id") % 4 + F.col("turn")
    return s.select("source_id", "turn", F.greatest(x0, F.lit(-180)).alias("x_from"), F.least(x1, F.lit(180)).alias("x_to")).where("x_from < x_to")


def subdivide(attached_roots: DataFrame, levels: int) -> DataFrame:
    """The older division, level by level, of (level, tile_x, tile_y, res, width): a tile divides while its step is too coarse. The loop is bounded by the number of levels."""
    out, front = attached_roots, attached_roots
    for _ in range(levels):
        front = front.where(F.col("width") / WORLD.image_tile * 0.9 > F.col("res")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
        front = front.select((F.col("level") + 1).alias("level"), (F.col("tile_x") * 2 + F.col("q") % 2).alias("tile_x"), (F.col("tile_y") * 2 + F.shiftright("q", 1)).alias("tile_y"), "res", (F.col("width") / 2).alias("width"))
        out = out.union(front)
    return out


@query("G4_recursive_division", "with recursive t as (select 0 as level, 0 as tile_x, 0 as tile_y, 0.05::double as res, 90.0::double as width union all select level + 1, tile_x * 2 + cast(q % 2 as int), tile_y * 2 + cast(q // 2 as int), res, width / 2 from t, range(0, 4) r(q) where width / 256 * 0.9::double > res and level < 6) select level, tile_x, tile_y, width from t")
def recursive_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.sql("select 0 as level, 0 as tile_x, 0 as tile_y, 0.05D as res, 90.0D as width")
    return subdivide(root, 6).select(*KEY, "width")
