"""Whole builds: a new pyramid, a patch of one, cache maintenance, and what they report.

Each is one lazy plan over the operators; there is no loop over rows of tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import cte, fixture
from ..operators import catalog, ops, raster, tiling
from ..operators.tiling import KEY, PLACED, SRC, TILES, covered_sql
from ..options import BuildOptions
from ..registry import query


def build(sources: DataFrame, o: BuildOptions = tiling.WORLD) -> dict[str, DataFrame]:
    """Entry A: from sources to the tables of a build."""
    first = tiling.tile_sources(sources, o)
    tiles = tiling.complete(first.select(*KEY).distinct())
    return {"tile": tiles, "tile_source": tiling.attach(tiles, sources, o), "tile_layer": tiling.sized(tiling.resolutions(tiles, sources, o), o)}


def dirty_tiles(old: DataFrame, new: DataFrame, o: BuildOptions = tiling.WORLD) -> DataFrame:
    """Entry D: the tiles that a changed source touches in either revision; only they are built again."""
    status = catalog.diff(old, new, ["file_name", "source_type"], "layer").where("patch_status <> 'UNCHANGED'")
    both = old.union(new).join(status, ["file_name", "source_type"], "left_semi")
    return tiling.tile_sources(both, o).select(*KEY).distinct()


def maintain(requests: DataFrame, variants: DataFrame, local: int) -> DataFrame:
    """Entry C: for each original, the variant to read and whether a new one is worth making (the best is twice too coarse or fine)."""
    best = ops.best_variant(requests, variants, local)
    j = requests.join(best, "original", "left")
    q = F.col("asked") / F.col("ratio")
    return j.select("original", "variant_id", (F.col("variant_id").isNull() | (q > 2) | (q < 0.5)).alias("rebuild"))


@query("D_patch_dirty_tiles", SRC + PLACED + ", old as (select distinct file_name, source_type, layer from source where source_id % 3 <> 0), new as (select distinct file_name, source_type, layer from source where source_id % 5 <> 0), o1 as (select file_name, source_type, any_value(layer) as layer from old group by 1, 2), n1 as (select file_name, source_type, any_value(layer) as layer from new group by 1, 2), changed as (select coalesce(o1.file_name, n1.file_name) as file_name, coalesce(o1.source_type, n1.source_type) as source_type from o1 full join n1 on o1.file_name = n1.file_name and o1.source_type = n1.source_type where o1.file_name is null or n1.file_name is null), hit as (select p.* from placed p join changed using (file_name, source_type) where source_id % 3 <> 0 or source_id % 5 <> 0) select distinct level, tile_x, tile_y from (" + covered_sql("select *, cast(unnest(range(0, k + 1)) as int) as level from hit") + ")")
def patch_dirty_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "source").withColumn("layer", F.lit(0))
    return dirty_tiles(s.where("source_id % 3 <> 0"), s.where("source_id % 5 <> 0"))


@query("C_cache_maintenance", cte("variant")[:-1] + ", r as (select original, variant_id, ratio, asked from (select *, row_number() over (partition by original order by asked / ratio < 1, case when asked / ratio >= 1 then asked / ratio else -asked / ratio end, host <> 0, variant_id) as rn from (select *, 1.5::double + (original % 3) * 0.5::double as asked from variant)) where rn = 1) select original, variant_id, asked / ratio > 2 or asked / ratio < 0.5 as rebuild from r")
def cache_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixture(spark, sf_dir, "variant")
    return maintain(v.select("original").distinct().withColumn("asked", 1.5 + (F.col("original") % 3) * 0.5), v, 0)


@query("A_build_summary", SRC + TILES + " select 'tile' as table_name, count(*) as rows from tiles union all select 'covered', count(*) from cover")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "source")
    out = tiling.tile_sources(s).agg(F.count("*").alias("rows")).select(F.lit("covered").alias("table_name"), "rows")
    return out.union(build(s)["tile"].agg(F.count("*").alias("rows")).select(F.lit("tile"), "rows"))


@query("F12_split_contribution", SRC + PLACED + " select source_id, k > 4 as contributes from placed")
def split_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a source counts for a task only if it reaches beneath the split."""
    return tiling.placed(fixture(spark, sf_dir, "source")).select("source_id", (F.col("k") > 4).alias("contributes"))


@query("J9_options_by_layer", cte("source") + "select layer, case when layer = 1 then 128 else 256 end as image_tile, count(*) as sources from source group by 1, 2")
def options_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.layer_options(spark, sf_dir).groupBy("layer", "image_tile").agg(F.count("*").alias("sources"))


@query("O1_draw_order", cte("source") + "select layer, arg_min(source_id, draw) as first_drawn, arg_max(source_id, draw) as last_drawn from (select layer, source_id, row_number() over (partition by layer order by round(sqrt(((x_max - x_min) / (num_x - 1)) ** 2 + ((y_max - y_min) / (num_y - 1)) ** 2), 12) desc, source_id) as draw from source) group by 1")
def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the ends of the order, by extremes of its key instead of a sort."""
    from ..functions.extents import post_resolution

    key = F.struct(-F.round(post_resolution(), 12), "source_id")
    return fixture(spark, sf_dir, "source").groupBy("layer").agg(F.min_by("source_id", key).alias("first_drawn"), F.max_by("source_id", key).alias("last_drawn"))


@query("O4_highest_revision", "select o_custkey % 9 as base, max(o_orderkey % 37) as revision from orders group by 1")
def highest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import revision_discovery

    return revision_discovery(spark, sf_dir).select(F.regexp_extract("base", "[0-9]+", 0).cast("long").alias("base"), F.col("revision").cast("long").alias("revision"))


@query("K4_archive_members", cte("source") + "select distinct layer, file_name as member from source where source_type = 'IMAGE'")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: what an archive of each layer would hold, a row for each member; a table's partition of a layer is its archive."""
    return fixture(spark, sf_dir, "source").where("source_type = 'IMAGE'").select("layer", F.col("file_name").alias("member")).distinct()


@query("K11_mirror_list", cte("variant")[:-1] + ", f as (select *, original * 1000 + variant_id % 997 as file_key from variant) select host, count(*) as files from (select file_key, arg_min(host, (host <> 0)::int * 1e12 + host * 1e10 + variant_id) as host from f where file_key not in (select file_key from f where host = 3) group by 1) group by 1")
def mirror_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixture(spark, sf_dir, "variant")
    chosen = ops.mirror(spark, sf_dir).join(v.select("variant_id", "host"), "variant_id")
    return chosen.groupBy("host").agg(F.count("*").alias("files"))


@query("C9_build_options", "select * from (values ('image_tile', '256'), ('terrain_tile', '64'), ('max_levels', '30'), ('distance_ratio', '7.0'), ('skirt_ratio', '0.02'), ('vertical_scale', '1.0'), ('database_type', 'PagedLOD'), ('geometry_type', 'TERRAIN'), ('revision', '0')) t(name, value)")
def build_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("image_tile", "terrain_tile", "max_levels", "distance_ratio", "skirt_ratio", "vertical_scale", "database_type", "geometry_type", "revision")
    return BuildOptions().frame(spark).where(F.col("name").isin(*names))


def apply_stages(df: DataFrame, *stages) -> DataFrame:
    """Visitors, build operations and placers of a build are functions from table to table; they chain in order."""
    for stage in stages:
        df = df.transform(stage)
    return df


@query("X_extension_hooks", cte("dem")[:-1] + ", e as (select tx, ty, c, r, avg(h) over (partition by gx, gy) as h from dem) select tx, ty, round(avg(h), 6) as mean, max(h) as top from e group by 1, 2")
def extension_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..fixtures import dem

    summary = lambda d: d.groupBy("tx", "ty").agg(F.round(F.avg("h"), 6).alias("mean"), F.max("h").alias("top"))
    return apply_stages(dem(spark, sf_dir), raster.equalize, summary)
