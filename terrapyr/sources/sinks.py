"""Sinks: manifests, paths, text reports, revision lists, dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import cte, fixture, table
from ..operators import tiling
from ..operators.tiling import PLACED, SRC, covered_sql
from ..options import BuildOptions
from ..registry import query


def write_tiles(tiles: DataFrame, path: str) -> None:
    """K1: tile rows by level; only levels that are in the table are overwritten."""
    tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level").parquet(path)


def tile_changes(tiles: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """K1: tiles of a build, added or modified by whether the last build had them."""
    had = before.select(*keys).distinct().withColumn("had", F.lit(True))
    return tiles.select(*keys).distinct().join(had, keys, "left").select(*keys, F.when(F.col("had"), "modified").otherwise("added").alias("change"))


#: Tiles of two revisions of a catalog.
_TWO = SRC + PLACED + ", o as (select distinct level, tile_x, tile_y from (" + covered_sql("select *, cast(unnest(range(0, k + 1)) as int) as level from placed where source_id % 3 <> 0") + ")), n as (select distinct level, tile_x, tile_y from (" + covered_sql("select *, cast(unnest(range(0, k + 1)) as int) as level from placed where source_id % 5 <> 0") + "))"


@query("K1_tile_manifest", _TWO + " select n.level, n.tile_x, n.tile_y, case when o.level is null then 'added' else 'modified' end as change from n left join o using (level, tile_x, tile_y)")
def tile_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "source")
    tiles = lambda cond: tiling.tile_sources(s.where(cond)).select(*tiling.KEY).distinct()
    return tile_changes(tiles("source_id % 5 <> 0"), tiles("source_id % 3 <> 0"), tiling.KEY)


def simple_path(path: Column) -> Column:
    """K2: without empty and `.` parts, and with `name/..` taken out, however deep; a `..` with nothing before it stays."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & (F.size(done) > 0) & (last != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


@query("K2_image_paths", "select n_nationkey as id, '/out/L' || n_regionkey || '/t_' || n_nationkey || '.dds' as path from nation")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    raw = F.concat(F.lit("/out/./tmp/..//L"), "n_regionkey", F.lit("/a/b/c/../../../d/../.././L"), "n_regionkey", F.lit("/t_"), "n_nationkey", F.lit(".dds"))
    return n.select(F.col("n_nationkey").alias("id"), simple_path(raw).alias("path"))


@query("K3_external_images", cte("source") + "select source_id, file_name from source where source_type = 'IMAGE' and source_id % 3 <> 0")
def external_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: images whose write hint is not to store them inline."""
    hint = F.when(F.col("source_id") % 3 == 0, "STORE_INLINE").otherwise("EXTERNAL_FILE")
    return fixture(spark, sf_dir, "source").withColumn("hint", hint).where("source_type = 'IMAGE' and hint = 'EXTERNAL_FILE'").select("source_id", "file_name")


@query("K5_definition_text", "select n_nationkey as id, case when n_nationkey % 3 = 0 then 'BuildOptions {}' else 'BuildOptions {' || chr(10) || '  image_tile ' || (256 + n_nationkey) || chr(10) || '}' end as body from nation")
def definition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: only what differs from the defaults is written."""
    n = table(spark, sf_dir, "nation")
    default = BuildOptions().image_tile
    value = F.when(F.col("n_nationkey") % 3 == 0, default).otherwise(default + F.col("n_nationkey"))
    return n.select(F.col("n_nationkey").alias("id"), block("BuildOptions", {"image_tile": F.when(value != default, value.cast("string"))}).alias("body"))


def block(name: str, fields: dict[str, Column]) -> Column:
    """A bracketed block of the fields that are not null."""
    lines = F.filter(F.array(*[F.concat(F.lit(f"  {k} "), v) for k, v in fields.items()]), lambda l: l.isNotNull())
    return F.when(F.size(lines) == 0, F.lit(f"{name} {{}}")).otherwise(F.concat(F.lit(f"{name} {{\n"), F.array_join(lines, "\n"), F.lit("\n}")))


@query("K6_cache_report", cte("variant") + "select original, 'f' || original || ': ' || count(*) || ' variants on ' || count(distinct host) || ' hosts, finest ' || min(ratio) as report from variant group by 1")
def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture(spark, sf_dir, "variant").groupBy("original").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.min("ratio").alias("finest"))
    return g.select("original", F.concat(F.lit("f"), "original", F.lit(": "), "n", F.lit(" variants on "), "hosts", F.lit(" hosts, finest "), "finest").alias("report"))


@query("K7_property_text", "select n_nationkey as id, 'host : ' || n_name || chr(10) || 'region : ' || n_regionkey as body from nation")
def property_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: properties as `key : value` lines, keys in order."""
    n = table(spark, sf_dir, "nation")
    props = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("host"), F.col("n_name"))
    return n.select(F.col("n_nationkey").alias("id"), property_lines(props).alias("body"))


def property_lines(props: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit(" : "), e["value"])), "\n")


@query("K8_revision_lists", _TWO + " select 1 as revision, case when n.level is null then 'removed' when o.level is null then 'added' else 'modified' end as change, count(*) as files, min('world_L' || level || '_X' || tile_x || '_Y' || tile_y) as first_path from n full join o using (level, tile_x, tile_y) group by 2")
def revision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: what each list of a revision holds; tiles that no source touches any more are removed."""
    s = fixture(spark, sf_dir, "source")
    tiles = lambda cond: tiling.tile_sources(s.where(cond)).select(*tiling.KEY).distinct()
    now, before = tiles("source_id % 5 <> 0"), tiles("source_id % 3 <> 0")
    lists = tile_changes(now, before, tiling.KEY).unionByName(before.join(now, tiling.KEY, "left_anti").withColumn("change", F.lit("removed")))
    return lists.withColumn("path", F.format_string("world_L%d_X%d_Y%d", *tiling.KEY)).groupBy(F.lit(1).alias("revision"), "change").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@query("K9_intermediate_catalog", cte("source") + "select source_id, source_type, layer, set_name, file_name, 'PREFER_FILE_SETTINGS' as policy from source where source_type <> 'SHAPEFILE'")
def intermediate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the catalog as layers of a new definition, with settled metadata."""
    s = fixture(spark, sf_dir, "source").where("source_type <> 'SHAPEFILE'")
    return s.select("source_id", "source_type", "layer", "set_name", "file_name", F.lit("PREFER_FILE_SETTINGS").alias("policy"))


@query("K10_dry_run", cte("source") + "select count(*) as rows from source")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but the write; the count is observed while the plan runs."""
    from pyspark.sql import Observation

    seen = Observation("dry run")
    fixture(spark, sf_dir, "source").observe(seen, F.count("*").alias("rows")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")
