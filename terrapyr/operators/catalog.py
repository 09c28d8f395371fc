"""The source catalog: layers, policies, filters, revisions, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..fixtures import cte, fixture, table
from ..functions import extents as E
from ..options import METRES_PER_DEGREE, BuildOptions
from ..registry import query

S = cte("source")


@query("P1_flatten_layers", S + "select 'terrain' || (source_id // 8) as terrain, cast(row_number() over (partition by source_id // 8 order by source_id) - 1 as int) as position, source_id, layer, set_name, min_level, max_level from source")
def flatten_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "source")
    nested = s.groupBy(F.concat(F.lit("terrain"), F.floor(F.col("source_id") / 8)).alias("terrain")).agg(F.array_sort(F.collect_list(F.struct("source_id", "layer", "set_name", "min_level", "max_level"))).alias("layers"))
    return flatten(nested)


def flatten(nested: DataFrame) -> DataFrame:
    """Nested layers to one row per source, in their order."""
    return nested.select("terrain", F.posexplode("layers").alias("position", "l")).select("terrain", "position", "l.*")


def by_policy(policy: Column, config: Column, file: Column, scaled: Column) -> Column:
    """Which affine term holds; a missing value on one side gives way to the other."""
    keep = F.coalesce(config, file)
    return F.when(policy == "PREFER_CONFIG_SETTINGS", keep).when(policy == "PREFER_CONFIG_SETTINGS_BUT_SCALE_BY_FILE_RESOLUTION", F.when(config.isNull(), file).otherwise(scaled)).otherwise(F.coalesce(file, config))


_POLICY = "case source_id % 3 when 0 then 'PREFER_CONFIG_SETTINGS' when 1 then 'PREFER_CONFIG_SETTINGS_BUT_SCALE_BY_FILE_RESOLUTION' else 'PREFER_FILE_SETTINGS' end"


@query("P2_parameter_policy", S + f"select source_id, policy, case policy when 'PREFER_CONFIG_SETTINGS' then coalesce(config, file) when 'PREFER_FILE_SETTINGS' then coalesce(file, config) else case when config is null then file else config * 100.0::double / num_x end end as g1 from (select *, {_POLICY} as policy, case when source_id % 5 = 0 then null else 0.25::double end as config, case when source_id % 7 = 0 then null else (x_max - x_min) / num_x end as file from source)")
def parameter_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("source_id")
    s = fixture(spark, sf_dir, "source").withColumns({"policy": F.element_at(F.array(*map(F.lit, ("PREFER_CONFIG_SETTINGS", "PREFER_CONFIG_SETTINGS_BUT_SCALE_BY_FILE_RESOLUTION", "PREFER_FILE_SETTINGS"))), (k % 3 + 1).cast("int")), "config": F.when(k % 5 != 0, 0.25), "file": F.when(k % 7 != 0, (F.col("x_max") - F.col("x_min")) / F.col("num_x"))})
    return s.select("source_id", "policy", by_policy(F.col("policy"), F.col("config"), F.col("file"), F.col("config") * 100.0 / F.col("num_x")).alias("g1"))


@query("P3_affine_extents", S + "select source_id, least(g0, g0 + 0.5 * n) as x_min, least(g3, g3 - 0.25 * n) as y_min, greatest(g0, g0 + 0.5 * n) as x_max, greatest(g3, g3 - 0.25 * n) as y_max from (select source_id, x_min::double as g0, y_max::double as g3, (num_x - case when data_type = 'VECTOR' then 1 else 0 end)::double as n from source)".replace("0.5 *", "0.5::double *").replace("0.25 *", "0.25::double *"))
def affine_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = E.affine_extents("x_min", F.lit(0.5), "y_max", F.lit(-0.25), "num_x", "num_y", "data_type")
    return fixture(spark, sf_dir, "source").select("source_id", *[c.alias(n) for c, n in zip(box, E.BOX)])


def crs_type(wkt: Column) -> Column:
    """By the root of the WKT; no CRS counts as projected."""
    root = F.upper(F.regexp_extract(F.coalesce(wkt, F.lit("")), r"^\s*([A-Za-z_]+)\s*\[", 1))
    return F.when(root.isin("GEOCCS", "GEODCRS"), "GEOCENTRIC").when(root.isin("GEOGCS", "GEOGCRS"), "GEOGRAPHIC").when(root.isin("LOCAL_CS", "ENGCRS"), "LOCAL").otherwise("PROJECTED")


def crs_normal(wkt: Column) -> Column:
    """White space outside of names does not count when CRS texts are compared."""
    return F.upper(F.regexp_replace(wkt, r"\s+", ""))


_WKT = "case p_partkey % 5 when 0 then 'GEOGCS[\"WGS 84\", UNIT[\"degree\", 0.0174532925199433]]' when 1 then 'PROJCS[\"UTM\",GEOGCS[\"WGS 84\"],UNIT[\"metre\",1]]' when 2 then 'geoccs[\"earth\",UNIT[\"metre\",1]]' when 3 then 'LOCAL_CS[\"site\",UNIT[\"foot\",0.3048]]' end"


@query("P4_crs_type", f"select p_partkey as source_id, case p_partkey % 5 when 0 then 'GEOGRAPHIC' when 2 then 'GEOCENTRIC' when 3 then 'LOCAL' else 'PROJECTED' end as crs_type, case when p_partkey % 5 = 4 then null else cast(regexp_extract({_WKT}, '.*UNIT.\"[a-z]+\", ?([0-9.]+)', 1) as double) end as linear_unit, p_partkey % 5 <> 4 and p_partkey % 5 = 0 as same_as_wgs84 from part".replace(".*UNIT.", ".*UNIT\\["))
def crs_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    wgs = 'GEOGCS["WGS 84",UNIT["degree",0.0174532925199433]]'
    t = table(spark, sf_dir, "part").selectExpr("p_partkey as source_id", f"{_WKT} as wkt")
    unit = F.regexp_extract("wkt", r'.*UNIT\["[a-z]+", ?([0-9.]+)', 1).try_cast("double")
    return t.select("source_id", crs_type(F.col("wkt")).alias("crs_type"), unit.alias("linear_unit"), F.coalesce(crs_normal(F.col("wkt")) == crs_normal(F.lit(wgs)), F.lit(False)).alias("same_as_wgs84"))


def mercator(lon: Column, lat: Column, radius: float) -> tuple[Column, Column]:
    """P5: the spherical Mercator of the web; other closed forms follow the same pattern."""
    return F.radians(lon) * radius, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * radius


@query("P5_project_mercator", S + "select source_id, round(radians(x_min) * 6378137.0, 3) as mx_min, round(ln(tan(pi() / 4 + radians(y_min) / 2)) * 6378137.0, 3) as my_min, round(radians(x_max) * 6378137.0, 3) as mx_max, round(ln(tan(pi() / 4 + radians(y_max) / 2)) * 6378137.0, 3) as my_max from source where abs(y_min) < 85")
def project_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, a = fixture(spark, sf_dir, "source").where("abs(y_min) < 85"), BuildOptions().equator_radius
    (x0, y0), (x1, y1) = mercator(F.col("x_min"), F.col("y_min"), a), mercator(F.col("x_max"), F.col("y_max"), a)
    return s.select("source_id", F.round(x0, 3).alias("mx_min"), F.round(y0, 3).alias("my_min"), F.round(x1, 3).alias("mx_max"), F.round(y1, 3).alias("my_max"))


_P6 = "sqrt(((x_max - x_min) / (num_x - 1)) ** 2 + ((y_max - y_min) / (num_y - 1)) ** 2)"


@query("P6_resolution", S + f"select source_id, round({_P6}, 12) as resolution, round(0.25::double / {_P6}, 9) as ratio from source")
def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.post_resolution()
    return fixture(spark, sf_dir, "source").select("source_id", F.round(r, 12).alias("resolution"), F.round(0.25 / r, 9).alias("ratio"))


@query("P7_sort_value", S + f"select source_id, layer, round({_P6}, 12) as sort_value, cast(row_number() over (partition by layer order by round({_P6}, 12) desc, source_id) as int) as draw_order from source")
def sort_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a layer the coarsest is drawn first; the id breaks ties. Layers are few and large, so places come from a parallel sort."""
    s = fixture(spark, sf_dir, "source").select("source_id", "layer", F.round(E.post_resolution(), 12).alias("sort_value"))
    return positions(s, [F.desc("sort_value"), F.col("source_id")], ["layer"]).withColumnRenamed("position", "draw_order").withColumn("draw_order", F.col("draw_order").cast("int"))


@query("P9_grid_shape", "select w, h, case when w >= h then n else 1 end as columns, case when w >= h then 1 else n end as rows from (select w, h, cast(case when r < sqrt(floor(r) * ceil(r)) then floor(r) else ceil(r) end as int) n from (select w::double w, h::double h, greatest(w, h) / least(w, h)::double r from range(1, 41) a(w), range(1, 41) b(h)))")
def grid_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.range(1, 41).select(F.col("id").cast("double").alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: x.cast("double"))).alias("h"))
    c, r = E.grid_shape(F.col("w"), F.col("h"))
    return g.select("w", "h", c.alias("columns"), r.alias("rows"))


@query("P17_texture_format", "select * from (values ('RGB_16', 'RGB', 'UNSIGNED_SHORT_5_6_5', 16), ('RGBA_16', 'RGBA', 'UNSIGNED_SHORT_5_5_5_1', 16), ('RGB_24', 'RGB', 'UNSIGNED_BYTE', 24), ('RGBA', 'RGBA', 'UNSIGNED_BYTE', 32), ('RGB32F', 'RGB', 'FLOAT', 96), ('RGBA32F', 'RGBA', 'FLOAT', 128), ('OTHER', 'RGB', 'UNSIGNED_BYTE', 24)) t(texture_type, pixel_format, pixel_type, bits)")
def texture_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("texture_type")
    names = spark.createDataFrame([(x,) for x in ("RGB_16", "RGBA_16", "RGB_24", "RGBA", "RGB32F", "RGBA32F", "OTHER")], "texture_type string")
    kind = F.when(t == "RGB_16", "UNSIGNED_SHORT_5_6_5").when(t == "RGBA_16", "UNSIGNED_SHORT_5_5_5_1").when(t.endswith("32F"), "FLOAT").otherwise("UNSIGNED_BYTE")
    channels = F.when(t.startswith("RGBA"), 4).otherwise(3)
    bits = F.when(kind.contains("SHORT"), 16).otherwise(channels * F.when(kind == "FLOAT", 32).otherwise(8))
    return names.select("texture_type", F.when(channels == 4, "RGBA").otherwise("RGB").alias("pixel_format"), kind.alias("pixel_type"), bits.alias("bits"))


@query("P21_derived_names", S + "select source_id, 'world_subtile_L3_X' || (source_id % 8) || '_Y' || (source_id % 4) as tile_path, 'world_subtile_L3_X' || (source_id % 8) || '_Y' || (source_id % 4) || '/world_L5_X' || (source_id % 32) || '_Y' || (source_id % 16) || '_subtile.ive' as subtile, 'world.' || (source_id % 5) || '.added' as revision_list, 'tasks/build_' || (source_id % 3) || '.task' as task_file from source")
def derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("source_id")
    folder = F.format_string("world_subtile_L3_X%d_Y%d", k % 8, k % 4)
    return fixture(spark, sf_dir, "source").select("source_id", folder.alias("tile_path"), F.concat(folder, F.format_string("/world_L5_X%d_Y%d_subtile.ive", k % 32, k % 16)).alias("subtile"), F.format_string("world.%d.added", k % 5).alias("revision_list"), F.format_string("tasks/build_%d.task", k % 3).alias("task_file"))


@query("P22_mask_parse", "select n_nationkey as id, cast(case n_nationkey % 3 when 0 then n_nationkey * 17 when 1 then n_nationkey * 9 else n_nationkey end as bigint) as mask from nation")
def mask_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "case n_nationkey % 3 when 0 then '0x' || lower(hex(n_nationkey * 17)) when 1 then '0' || conv(n_nationkey * 9, 10, 8) else cast(n_nationkey as string) end as text")
    return n.select("id", parse_mask(F.col("text")).alias("mask"))


def parse_mask(text: Column) -> Column:
    """0x hexadecimal, 0 octal, else decimal."""
    return F.when(F.lower(text).startswith("0x"), F.conv(F.substr(text, F.lit(3)), 16, 10)).when(text.startswith("0") & (F.length(text) > 1), F.conv(text, 8, 10)).otherwise(text).cast("long")


@query("P23_date_parse", "select o_orderkey, o_orderdate::timestamp as parsed, year(o_orderdate) || '/' || (month(o_orderdate) - 1) || '/' || day(o_orderdate) || ' 0:0:' || (o_orderkey % 60) as text, (o_orderdate::timestamp + to_seconds(o_orderkey % 60)) as moment from orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y/m/d h:m:s, where months count from zero and digits may be single."""
    moment = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 60)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", date_text(moment).alias("text"))
    return o.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("parsed"), "text", parse_date(F.col("text")).alias("moment"))


def date_text(moment: Column) -> Column:
    """A moment as text."""
    return F.concat_ws(" ", F.concat_ws("/", F.year(moment), F.month(moment) - 1, F.day(moment)), F.concat_ws(":", F.hour(moment), F.minute(moment), F.second(moment)))


def parse_date(text: Column) -> Column:
    """Text as a moment; parts beyond their range carry over (month 12 is next January), and a text without all six is null."""
    part = [F.regexp_extract(text, r"^\s*(\d+)/(\d+)/(\d+)\s+(\d+):(\d+):(\d+)", k).try_cast("int") for k in range(1, 7)]
    day = F.date_add(F.add_months(F.make_date(part[0], F.lit(1), F.lit(1)), part[1]), part[2] - 1)
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + part[3] * 3600 + part[4] * 60 + part[5]).cast("timestamp_ntz")


@query("P24_prefix_attribute", cte("feature") + "select feature_id, case when feature_id % 3 = 0 then null else cast(hgt as int) end as height, kind from feature")
def prefix_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, sf_dir, "feature").select("feature_id", F.array(F.concat(F.lit("NAME "), "kind"), F.when(F.col("feature_id") % 3 != 0, F.concat(F.lit("HGT "), F.col("hgt").cast("int"))).otherwise("HGTX 1")).alias("attrs"))
    return f.select("feature_id", attribute(F.col("attrs"), "HGT").cast("int").alias("height"), attribute(F.col("attrs"), "NAME").alias("kind"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of the first entry `name value`; a longer name does not match."""
    hit = F.filter(attrs, lambda a: a.startswith(name + " "))
    return F.when(F.size(hit) > 0, F.substr(F.get(hit, F.lit(0)), F.lit(len(name) + 2)))


@query("P25_presets", S + "select source_id, preset, x0 as g0, (x1 - x0) / num_x as g1, 90.0::double as g3, -180.0::double / num_y as g5 from (select *, case source_id % 3 when 0 then 'whole' when 1 then 'east' else 'west' end preset, case when source_id % 3 = 1 then 0.0::double else -180.0::double end x0, case when source_id % 3 = 2 then 0.0::double else 180.0::double end x1 from source)")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: ranges to affine terms, for the globe and its halves."""
    k = F.col("source_id") % 3
    s = fixture(spark, sf_dir, "source").withColumns({"preset": F.when(k == 0, "whole").when(k == 1, "east").otherwise("west"), "x0": F.when(k == 1, 0.0).otherwise(-180.0), "x1": F.when(k == 2, 0.0).otherwise(180.0)})
    return s.select("source_id", "preset", F.col("x0").alias("g0"), ((F.col("x1") - F.col("x0")) / F.col("num_x")).alias("g1"), F.lit(90.0).alias("g3"), (-180.0 / F.col("num_y")).alias("g5"))


@query("P27_vertical_scale", S + "select source_id, case when source_id % 4 = 0 then 1.0::double when source_id % 4 = 1 then 1.0::double / 111319.0 else 1.0::double end as vertical_scale from source")
def vertical_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres become degrees for geographic targets that stay flat."""
    k = F.col("source_id") % 4
    geographic, geocentric = k <= 1, k == 0
    return fixture(spark, sf_dir, "source").select("source_id", F.when(geographic & ~geocentric, 1.0 / METRES_PER_DEGREE).otherwise(1.0).alias("vertical_scale"))


@query("P31_layer_options", S + "select source_id, layer, case when layer = 1 then 128 else 256 end as image_tile, case when layer = 1 then '.png' else '.dds' end as extension from source")
def layer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's own options before the global ones. The option table is as small as the number of layers."""
    own = spark.createDataFrame([(1, 128, ".png")], "layer int, own_tile int, own_ext string")
    o = BuildOptions()
    return fixture(spark, sf_dir, "source").join(F.broadcast(own), "layer", "left").select("source_id", "layer", F.coalesce("own_tile", F.lit(o.image_tile)).alias("image_tile"), F.coalesce("own_ext", F.lit(o.image_extension)).alias("extension"))


@query("P32_option_compatibility", "select n_nationkey as id, n_nationkey % 3 <> 1 and n_nationkey % 5 <> 2 as compatible, cast((n_nationkey % 3 = 1)::int + (n_nationkey % 5 = 2)::int as int) as differences from nation")
def option_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = BuildOptions()
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    mine = F.create_map(F.lit("image_tile"), F.lit("256"), F.lit("geometry_type"), F.lit(base.geometry_type), F.lit("crs"), F.lit(None).cast("string"))
    other = F.create_map(F.lit("image_tile"), F.when(k % 3 == 1, "128").otherwise("256"), F.lit("geometry_type"), F.when(k % 5 == 2, "POLYGONAL").otherwise(base.geometry_type), F.lit("crs"), F.lit(None).cast("string"))
    d = differences(mine, other)
    return n.select(k.alias("id"), (F.size(d) == 0).alias("compatible"), F.size(d).alias("differences"))


def differences(a: Column, b: Column) -> Column:
    """The options in which two maps differ, nulls alike."""
    keys = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    return F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


@query("P35_optional_layer_files", S + "select source_id, case when set_name = '' then 'INLINE' when source_id % 2 = 0 then 'LOCAL_DIRECTORY' else 'SET_DIRECTORY' end as policy, case when set_name = '' then null when source_id % 2 = 0 then 'tile_' || source_id || '_' || set_name || '.dds' else set_name || '/tile_' || source_id || '.dds' end as file from source")
def optional_layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("source_id")
    s = fixture(spark, sf_dir, "source").withColumn("policy", F.when(F.col("set_name") == "", "INLINE").when(k % 2 == 0, "LOCAL_DIRECTORY").otherwise("SET_DIRECTORY"))
    return s.select("source_id", "policy", F.when(F.col("policy") == "LOCAL_DIRECTORY", F.concat(F.lit("tile_"), k, F.lit("_"), "set_name", F.lit(".dds"))).when(F.col("policy") == "SET_DIRECTORY", F.concat("set_name", F.lit("/tile_"), k, F.lit(".dds"))).alias("file"))


@query("P36_spherical_radius", "select (6378137.0::double + 6356752.3142::double) / 2 as radius")
def spherical_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = BuildOptions()
    return spark.range(1).select(((F.lit(o.equator_radius) + F.lit(o.polar_radius)) / 2).alias("radius"))


# --- filters ---------------------------------------------------------------------------

_NEAR = "greatest(x_min * 1.5::double{d}, 170.0) <= least(x_max * 1.5::double{d}, 190.0)"


@query("F1_intersects", S + f"select source_id from source where ({' or '.join(_NEAR.format(d=d) for d in ('', ' + 360', ' - 360'))}) and greatest(y_min, -20) <= least(y_max, 20)")
def intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sources stretched beyond the date line on either side, and a box across it."""
    wide = (F.col("x_min") * 1.5, F.col("y_min"), F.col("x_max") * 1.5, F.col("y_max"))
    return fixture(spark, sf_dir, "source").where(E.intersects(wide, (170.0, -20.0, 190.0, 20.0))).select("source_id")


@query("F2_intersection", S + "select source_id, greatest(x_min + 10, 0) as ix_min, greatest(y_min, 0) as iy_min, least(x_max + 10, 40) as ix_max, least(y_max, 40) as iy_max from source where greatest(x_min + 10, 0) < least(x_max + 10, 40) and greatest(y_min, 0) < least(y_max, 40)")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = E.intersection(E.BOX, tuple(F.lit(x) for x in (0.0, 0.0, 40.0, 40.0)), 10.0)
    names = ("ix_min", "iy_min", "ix_max", "iy_max")
    return fixture(spark, sf_dir, "source").select("source_id", *[c.alias(n) for c, n in zip(box, names)]).where(E.has_area(names))


@query("F4_source_skips", S + "select source_id, case when min_level > 2 then 'min level' when source_type = 'SHAPEFILE' then 'not raster' when source_id % 11 = 0 then 'no data' when not (x_max >= 0 and x_min <= 180) then 'no overlap' else 'used' end as reason from source")
def source_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first reason for which a source is skipped."""
    reason = F.when(F.col("min_level") > 2, "min level").when(~F.col("source_type").isin("IMAGE", "HEIGHT_FIELD"), "not raster").when(F.col("source_id") % 11 == 0, "no data").when(~E.overlap("x_min", "x_max", F.lit(0.0), F.lit(180.0)), "no overlap").otherwise("used")
    return fixture(spark, sf_dir, "source").select("source_id", reason.alias("reason"))


@query("F6_needs_reprojection", S + "select source_id, case when source_type = 'SHAPEFILE' then false when source_id % 10 = 0 then true when source_id % 3 = 0 then true else (x_max - x_min) / num_x < 0.005 or (x_max - x_min) / num_x > 0.1 end as needs from source")
def needs_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = (F.col("x_max") - F.col("x_min")) / F.col("num_x")
    needs = F.when(F.col("source_type") == "SHAPEFILE", False).when(F.col("source_id") % 10 == 0, True).when(F.col("source_id") % 3 == 0, True).otherwise((res < 0.005) | (res > 0.1))
    return fixture(spark, sf_dir, "source").select("source_id", needs.alias("needs"))


@query("F8_clamp_extents", S + "select source_id, greatest(x_min * 2 + t, -180) as cx_min, greatest(y_min * 2, -90) as cy_min, least(x_max * 2 + t, 180) as cx_max, least(y_max * 2, 90) as cy_max from (select *, case when x_min * 2 > 180 then -360 when x_max * 2 < -180 then 360 else 0 end as t from source)")
def clamp_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = E.clamp_geographic(tuple(F.col(c) * 2 for c in E.BOX))
    return fixture(spark, sf_dir, "source").select("source_id", *[c.alias("c" + n) for c, n in zip(box, E.BOX)])


@query("F13_ingest_gate", "select p_partkey as id, case p_partkey % 4 when 0 then 'file' when 1 then 'directory' when 2 then 'missing' else 'unsupported' end as kind from part")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by extension; a path without one is treated as a folder."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "case p_partkey % 4 when 0 then '/d/a.tif' when 1 then '/d/sub' when 2 then '' else '/d/a.exe' end as path")
    ext = F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1))
    return p.select("id", F.when(F.col("path") == "", "missing").when(ext == "", "directory").when(ext.isin("tif", "jpg", "ive", "shp"), "file").otherwise("unsupported").alias("kind"))


# --- revisions ----------------------------------------------------------------------


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """Patch status of every source of two revisions. value: a column whose change means MODIFIED."""
    side = lambda df, n: df.select(*keys, *([F.col(value).alias(f"v{n}")] if value else []), F.lit(True).alias(f"in{n}")).dropDuplicates(keys)
    j = side(old, 0).join(side(new, 1), keys, "full_outer")
    same = F.col("v0").eqNullSafe(F.col("v1")) if value else F.lit(True)
    return j.select(*keys, F.when(F.col("in0").isNull(), "ADDED").when(F.col("in1").isNull(), "REMOVED").when(same, "UNCHANGED").otherwise("MODIFIED").alias("patch_status"))


R = cte("rev")[:-1] + ", o as (select distinct file_name, source_type from rev where in_old), n as (select distinct file_name, source_type from rev where in_new), d as (select coalesce(o.file_name, n.file_name) as file_name, coalesce(o.source_type, n.source_type) as source_type, case when o.file_name is null then 'ADDED' when n.file_name is null then 'REMOVED' else 'UNCHANGED' end as patch_status from o full join n on o.file_name = n.file_name and o.source_type = n.source_type) "


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = fixture(spark, sf_dir, "rev")
    return r.where("in_old"), r.where("in_new").withColumn("size", F.col("new_size"))


@query("J6_revision_diff", R + "select * from d")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(*revisions(spark, sf_dir), ["file_name", "source_type"])


@query("F5_patch_filter", R + "select file_name, source_type, patch_status from d where patch_status <> 'UNCHANGED'")
def patch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_diff(spark, sf_dir).where("patch_status <> 'UNCHANGED'")


@query("A10_altered_sources", R + "select count(*) filter (where patch_status <> 'UNCHANGED') as altered, count(*) as sources from d")
def altered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_diff(spark, sf_dir).agg(F.count_if(F.col("patch_status") != "UNCHANGED").alias("altered"), F.count("*").alias("sources"))


@query("U1_catalog_union", cte("rev") + "select file_name, source_type, 0 as revision from rev where in_old union all select file_name, source_type, 1 from rev where in_new")
def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = revisions(spark, sf_dir)
    both = old.withColumn("revision", F.lit(0)).unionByName(new.withColumn("revision", F.lit(1)))
    return both.select("file_name", "source_type", "revision")


@query("U2_layer_operations", cte("rev")[:-1] + ", o as (select file_name, max(size) as size from rev where in_old group by 1), n as (select file_name, max(new_size) as size from rev where in_new group by 1), gone as (select distinct file_name from rev where size % 11 = 0) select file_name, coalesce(n.size, o.size) as size, case when o.file_name is null then 'added' when n.file_name is not null and n.size <> o.size then 'modified' else 'kept' end as op from o full join n using (file_name) where file_name not in (select file_name from gone)")
def layer_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers added, changed and removed by file name."""
    r = fixture(spark, sf_dir, "rev")
    side = lambda cond, size: r.where(cond).groupBy("file_name").agg(F.max(size).alias("size"))
    return edit_layers(side("in_old", "size"), side("in_new", "new_size"), r.where("size % 11 = 0").select("file_name"))


def edit_layers(old: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """(file_name, size, op) after `new` is put over `old` and `removed` is taken out."""
    j = old.select("file_name", F.col("size").alias("was")).join(new.select("file_name", F.col("size").alias("is")), "file_name", "full_outer").join(removed, "file_name", "left_anti")
    return j.select("file_name", F.coalesce("is", "was").alias("size"), F.when(F.col("was").isNull(), "added").when(F.col("is") != F.col("was"), "modified").otherwise("kept").alias("op"))


@query("U3_optional_sets", S + "select source_id, case when source_id % 3 = 0 then ['day', 'night', 'x'] else ['day', 'x'] end as inserted, case when source_id % 3 = 0 then ['night'] else [] end as erased, source_id % 3 = 0 as has_night from source")
def optional_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("source_id") % 3 == 0, F.array(F.lit("day"), F.lit("night"))).otherwise(F.array(F.lit("day")))
    return fixture(spark, sf_dir, "source").select("source_id", F.sort_array(F.array_union(base, F.array(F.lit("x")))).alias("inserted"), F.array_except(base, F.array(F.lit("day"))).alias("erased"), F.array_contains(base, "night").alias("has_night"))


@query("U4_file_list_append", cte("rev") + "select distinct 'added' as change, file_name as path from rev where in_old union select distinct 'added', file_name from rev where in_new union select distinct 'removed', file_name from rev where not in_new")
def file_list_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4, K8: lists of a revision grow by what tasks report; each path once a change."""
    r = fixture(spark, sf_dir, "rev")
    part = lambda cond, change: r.where(cond).select(F.lit(change).alias("change"), F.col("file_name").alias("path"))
    return part("in_old", "added").union(part("in_new", "added")).union(part("not in_new", "removed")).distinct()


@query("U5_dedupe_details", cte("variant") + "select original, host, cast(round(ratio * 1000000) as bigint) as ratio_key, count(*) as n from variant group by all")
def dedupe_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details that agree to a millionth are one."""
    return fixture(spark, sf_dir, "variant").groupBy("original", "host", F.round(F.col("ratio") * 1e6).cast("long").alias("ratio_key")).agg(F.count("*").alias("n"))


# --- ordering and totals -----------------------------------------------------------


@query("O2_detail_order", S + f"select source_id, cast(row_number() over (order by source_type, file_name, layer, round({_P6}, 12) desc, source_id) as int) as position from source")
def detail_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: a global order as positions. Ranges are sorted in parallel; each row's position is its partition's offset plus its place."""
    s = fixture(spark, sf_dir, "source").select("source_id", "source_type", "file_name", "layer", F.round(E.post_resolution(), 12).alias("sort_value"))
    return positions(s, [F.col("source_type"), F.col("file_name"), F.col("layer"), F.desc("sort_value"), F.col("source_id")]).select("source_id", F.col("position").cast("int").alias("position"))


def positions(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """`position` (a long, from 1) in an order, within groups if `by` names their columns. Rows are dealt by ranges of groups and order, so neither a large group nor the whole table meets in one task; a place is its range's offset and the row's place in it. The sorted ranges are kept on the executors' disks, so offsets and rows come from one sort; what is lost is made again from the shuffle."""
    from pyspark.sql import Window as W

    by, n = by or [], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *order]
    cut = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    ranked = cut.withColumn("__place", F.col("__row") - F.shiftleft(F.col("__part").cast("long"), 33) + 1).persist(StorageLevel.DISK_ONLY)
    # A row for every range and group in it: as many as ranges and groups, not rows.
    sizes = ranked.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = F.coalesce(F.sum("__n").over((W.partitionBy(*by) if by else W.partitionBy()).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col("__part").alias("__in"), *[F.col(c).alias(f"__{c}") for c in by], (before - F.col("__first") + 1).alias("__base"))
    same = F.col("__part") == F.col("__in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ranked.join(base, same).select(*df.columns, (F.col("__base") + F.col("__place")).alias("position"))


@query("O3_resolution_pairs", S + "select source_id, res_x, res_y, cast(rank() over (partition by layer order by least(res_x, res_y)) as int) as rank from (select *, (x_max - x_min) / num_x as res_x, (y_max - y_min) / num_y * 2 as res_y from source)")
def resolution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the rank is the place of the first of equal pairs, found by a sort and an aggregate."""
    s = fixture(spark, sf_dir, "source").withColumns({"res_x": (F.col("x_max") - F.col("x_min")) / F.col("num_x"), "res_y": (F.col("y_max") - F.col("y_min")) / F.col("num_y") * 2})
    placed = positions(s.select("source_id", "layer", "res_x", "res_y", F.least("res_x", "res_y").alias("least")), [F.col("least"), F.col("source_id")], ["layer"])
    first = placed.groupBy("layer", "least").agg(F.min("position").cast("int").alias("rank"))
    return placed.join(first, ["layer", "least"]).select("source_id", "res_x", "res_y", "rank")


@query("A1_extents_union", S + "select source_type, min(greatest(x_min, -180)) as x_min, min(greatest(y_min, -90)) as y_min, max(least(x_max, 180)) as x_max, max(least(y_max, 90)) as y_max from source group by 1")
def extents_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "source")
    box = dict(zip(E.BOX, E.clamp_geographic()))
    return s.select("source_type", *[c.alias(n) for n, c in box.items()]).groupBy("source_type").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


@query("A5_layer_count", S + "select set_name, max(layer) + 1 as layers from source where source_type = 'IMAGE' group by 1")
def layer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "source").where("source_type = 'IMAGE'").groupBy("set_name").agg((F.max("layer") + 1).alias("layers"))


@query("A11_required_resolutions", S + "select file_name, list_transform(range(0, 1 + greatest(0, ceil(round(ln(hi / lo) / ln(2::double), 9))::bigint)), lambda i: lo * 2 ** i) as ladder from (select file_name, min((x_max - x_min) / num_x) as lo, max((x_max - x_min) / num_x * (1 + layer * 4)) as hi from source group by 1)")
def required_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doublings from the finest resolution asked for to the coarsest."""
    res = (F.col("x_max") - F.col("x_min")) / F.col("num_x")
    g = fixture(spark, sf_dir, "source").groupBy("file_name").agg(F.min(res).alias("lo"), F.max(res * (1 + F.col("layer") * 4)).alias("hi"))
    steps = F.greatest(F.lit(0), F.ceil(F.round(F.log(F.col("hi") / F.col("lo")) / F.log(F.lit(2.0)), 9)).cast("int"))
    return g.select("file_name", F.transform(F.sequence(F.lit(0), steps), lambda i: F.col("lo") * F.pow(F.lit(2.0), i)).alias("ladder"))


@query("J13_lod_nearest", S + f"select file_name, arg_min(source_id, abs(round({_P6}, 12) - 0.02) * 1e6 + source_id * 1e-9) as source_id from source group by 1")
def lod_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each composite the source nearest to a target resolution, the first of equals."""
    s = fixture(spark, sf_dir, "source")
    return s.groupBy("file_name").agg(F.min_by("source_id", F.struct(F.abs(F.round(E.post_resolution(), 12) - 0.02), F.col("source_id"))).alias("source_id"))


@query("J10_attribute_upsert", cte("feature") + "select feature_id, case when feature_id % 2 = 0 then '99' else cast(cast(hgt as int) as string) end as replaced, cast(cast(hgt as int) as string) as kept_, case when feature_id % 2 = 0 then 'roof' end as extra from feature")
def attribute_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.create_map(F.lit("HGT"), F.col("hgt").cast("int").cast("string"))
    new = F.when(F.col("feature_id") % 2 == 0, F.create_map(F.lit("HGT"), F.lit("99"), F.lit("TOP"), F.lit("roof"))).otherwise(F.create_map().cast("map<string,string>"))
    f = fixture(spark, sf_dir, "feature").select("feature_id", own.alias("own"), new.alias("new"))
    r, k = upsert(F.col("own"), F.col("new"), True), upsert(F.col("own"), F.col("new"), False)
    return f.select("feature_id", r["HGT"].alias("replaced"), k["HGT"].alias("kept_"), F.try_element_at(r, F.lit("TOP")).alias("extra"))


def upsert(own: Column, new: Column, replace: bool) -> Column:
    """Attributes of a feature with new ones; equal names keep or give way."""
    first, second = (new, own) if replace else (own, new)
    return F.map_concat(first, F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)))
