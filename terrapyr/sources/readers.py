"""Readers of text formats and catalogs: metadata, properties, caches, tasks, machines, revisions."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import cte, fixture, table
from ..operators.catalog import positions
from ..options import BuildOptions
from ..registry import query


def raster_metadata(catalog: DataFrame) -> DataFrame:
    """Size and affine terms of each source; identity where a file has none (column georeferenced, if there is one). Posts step from the top left, down."""
    less = F.when(F.col("data_type") == "VECTOR", 1).otherwise(0)
    none = ~F.coalesce(F.col("georeferenced"), F.lit(True)) if "georeferenced" in catalog.columns else F.lit(False)
    return catalog.select(
        "source_id", "num_x", "num_y", "data_type",
        F.when(none, 0.0).otherwise(F.col("x_min")).alias("g0"),
        F.when(none, 1.0).otherwise((F.col("x_max") - F.col("x_min")) / (F.col("num_x") - less)).alias("g1"),
        F.when(none, 0.0).otherwise(F.col("y_max")).alias("g3"),
        F.when(none, 1.0).otherwise((F.col("y_min") - F.col("y_max")) / (F.col("num_y") - less)).alias("g5"),
    )


_META = "select source_id, num_x, num_y, data_type, case when source_id % 16 = 1 then 0 else x_min end as g0, case when source_id % 16 = 1 then 1 else (x_max - x_min) / (num_x - case when data_type = 'VECTOR' then 1 else 0 end) end as g1, case when source_id % 16 = 1 then 0 else y_max end as g3, case when source_id % 16 = 1 then 1 else (y_min - y_max) / (num_y - case when data_type = 'VECTOR' then 1 else 0 end) end as g5 from source"


@query("S1_raster_metadata", cte("source") + _META)
def raster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_metadata(fixture(spark, sf_dir, "source").withColumn("georeferenced", F.col("source_id") % 16 != 1))


@query("S2_height_field_scan", cte("source") + f"select source_id, g0 as origin_x, g3 as origin_y, g1 as step_x, g5 as step_y from ({_META}) where data_type = 'VECTOR'")
def height_field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_metadata(fixture(spark, sf_dir, "source").where("data_type = 'VECTOR'").withColumn("georeferenced", F.col("source_id") % 16 != 1)).selectExpr("source_id", "g0 as origin_x", "g3 as origin_y", "g1 as step_x", "g5 as step_y")


def fit_affine(points: DataFrame, key: str) -> DataFrame:
    """S3: least-squares affine from control points (px, py, x, y), by the normal equations of centred sums; one aggregate, then arithmetic."""
    n = F.count("*")
    cov = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    s = points.groupBy(key).agg(cov("px", "px").alias("pp"), cov("py", "py").alias("qq"), cov("px", "py").alias("pq"), cov("px", "x").alias("px_"), cov("py", "x").alias("qx"), cov("px", "y").alias("py_"), cov("py", "y").alias("qy"), F.avg("px").alias("mp"), F.avg("py").alias("mq"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    det = F.nullif(F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq"), F.lit(0.0))
    s = s.withColumns({"g1": (F.col("qq") * F.col("px_") - F.col("pq") * F.col("qx")) / det, "g2": (F.col("pp") * F.col("qx") - F.col("pq") * F.col("px_")) / det, "g4": (F.col("qq") * F.col("py_") - F.col("pq") * F.col("qy")) / det, "g5": (F.col("pp") * F.col("qy") - F.col("pq") * F.col("py_")) / det})
    return s.select(key, (F.col("mx") - F.col("g1") * F.col("mp") - F.col("g2") * F.col("mq")).alias("g0"), "g1", "g2", (F.col("my") - F.col("g4") * F.col("mp") - F.col("g5") * F.col("mq")).alias("g3"), "g4", "g5")


_GCP = "gcp as (select source_id, px, py, x_min + px * 0.25::double + py * 0.125::double as x, y_max - py * 0.5::double as y from source, (values (0, 0), (64, 0), (0, 32), (64, 32), (32, 8)) v(px, py))"


@query("S3_gcp_affine", cte("source")[:-1] + f", {_GCP}, fit as (select source_id, regr_slope(x, px) as bx, covar_samp(px, x) cx, covar_samp(py, x) dx, covar_samp(px, y) cy, covar_samp(py, y) dy, var_samp(px) p, var_samp(py) q, covar_samp(px, py) r, avg(px) mp, avg(py) mq, avg(x) mx, avg(y) my from gcp group by 1), g as (select *, (q * cx - r * dx) / (p * q - r * r) g1, (p * dx - r * cx) / (p * q - r * r) g2, (q * cy - r * dy) / (p * q - r * r) g4, (p * dy - r * cy) / (p * q - r * r) g5 from fit) select source_id, round(mx - g1 * mp - g2 * mq, 6) + 0.0::double as g0, round(g1, 6) + 0.0::double as g1, round(g2, 6) + 0.0::double as g2, round(my - g4 * mp - g5 * mq, 6) + 0.0::double as g3, round(g4, 6) + 0.0::double as g4, round(g5, 6) + 0.0::double as g5 from g")
def gcp_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(*[F.struct(F.lit(float(px)).alias("px"), F.lit(float(py)).alias("py")) for px, py in ((0, 0), (64, 0), (0, 32), (64, 32), (32, 8))])
    gcp = fixture(spark, sf_dir, "source").select("source_id", "x_min", "y_max", F.explode(points).alias("p")).select("source_id", "p.px", "p.py", (F.col("x_min") + F.col("p.px") * 0.25 + F.col("p.py") * 0.125).alias("x"), (F.col("y_max") - F.col("p.py") * 0.5).alias("y"))
    return fit_affine(gcp, "source_id").select("source_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("g0", "g1", "g2", "g3", "g4", "g5")])


@query("S4_model_scan", cte("feature") + "select feature_id, 'MODEL' as source_type, x0 as x_min, y0 as y_min, x0 + w as x_max, y0 + h as y_max from feature where kind = 'Building'")
def model_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models enter as features with bounds."""
    return fixture(spark, sf_dir, "feature").where("kind = 'Building'").selectExpr("feature_id", "'MODEL' as source_type", "x0 as x_min", "y0 as y_min", "x0 + w as x_max", "y0 + h as y_max")


@query("S5_shapefile_scan", cte("feature") + "select feature_id, 4 as n_vertices, kind as name_attr, coalesce(case when feature_id % 4 = 0 then null else hgt end, 10.0::double) as height, cast(1 << cast(feature_id % 8 as int) as int) as mask, cast(feature_id % 3 as int) as min_level from feature")
def shapefile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their attribute map: type and height by configurable names, 10 where absent."""
    f = fixture(spark, sf_dir, "feature")
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    attrs = F.map_filter(F.create_map(F.lit("NAME"), F.col("kind"), F.lit("HGT"), F.when(F.col("feature_id") % 4 != 0, F.col("hgt").cast("string"))), lambda k, v: v.isNotNull())
    g = f.select("feature_id", ring.alias("ring"), attrs.alias("attrs"))
    return g.select("feature_id", F.size("ring").alias("n_vertices"), F.col("attrs")["NAME"].alias("name_attr"), F.coalesce(F.try_element_at("attrs", F.lit("HGT")).cast("double"), F.lit(10.0)).alias("height"), F.expr("shiftleft(1, cast(feature_id % 8 as int))").alias("mask"), (F.col("feature_id") % 3).cast("int").alias("min_level"))


_FILES = "files as (select p_partkey as k, '/data/d' || (p_partkey % 7) || '/src_' || p_partkey || '.' || (case p_partkey % 6 when 0 then 'tif' when 1 then 'jpg' when 2 then 'ive' when 3 then 'shp' when 4 then 'xyz' else 'TIF' end) as path from part)"
FORMATS = [("tif", "RASTER", "GTiff"), ("jpg", "RASTER", "JPEG"), ("ive", "MODEL", "scene"), ("shp", "VECTOR", "shapefile")]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, ("tif", "jpg", "ive", "shp", "xyz", "TIF"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("/data/d"), k % 7, F.lit("/src_"), k, F.lit("."), ext).alias("path"))


def scan_directory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files under a folder, with size and time, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")


@query("S6_directory_scan", f"with {_FILES} select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, count(*) as n_files, count(*) filter (where lower(path) like '%.tif') as n_tif from files group by 1")
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n_files"), F.count_if(F.lower("path").endswith(".tif")).alias("n_tif"))


@query("S7_format_registry", f"with {_FILES}, fmt(ext, kind, driver) as (values ('tif', 'RASTER', 'GTiff'), ('jpg', 'RASTER', 'JPEG'), ('ive', 'MODEL', 'scene'), ('shp', 'VECTOR', 'shapefile')) select k, ext, coalesce(kind, 'UNKNOWN') as kind, driver, kind is null as probe from (select *, lower(regexp_extract(path, '[.]([^./]+)$', 1)) as ext from files) left join fmt using (ext)")
def format_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By extension, in any case; unknown ones are to be probed once and the answer kept."""
    formats = spark.createDataFrame(FORMATS, "ext string, kind string, driver string")
    files = _files(spark, sf_dir).withColumn("ext", F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1)))
    return files.join(F.broadcast(formats), "ext", "left").select("k", "ext", F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), "driver", F.col("kind").isNull().alias("probe"))


@query("S8_metadata_cache", cte("source", "variant")[:-1] + ", best as (select original, min(variant_id) as cached_id, min(ratio) as ratio from variant group by 1) select source_id, b.cached_id, case when b.original is null then num_x else cast(floor(num_x * b.ratio) as int) end as num_x, b.original is not null as hit from source s left join best b on s.source_id % 120 = b.original")
def metadata_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cache knows needs no look at the file."""
    best = fixture(spark, sf_dir, "variant").groupBy("original").agg(F.min("variant_id").alias("cached_id"), F.min("ratio").alias("ratio"))
    s = fixture(spark, sf_dir, "source").withColumn("original", F.col("source_id") % 120)
    return s.join(best, "original", "left").select("source_id", "cached_id", F.coalesce(F.floor(F.col("num_x") * F.col("ratio")).cast("int"), F.col("num_x")).alias("num_x"), F.col("cached_id").isNotNull().alias("hit"))


def handle_pool(handles: DataFrame, cap: int, newest: bool = False) -> DataFrame:
    """Which open handles to close so that `cap` stay; only unreferenced ones may go. Places come from a parallel sort, the number to close from one count."""
    order = [F.col("last_access").desc() if newest else F.col("last_access").asc(), F.col("handle")]
    over = handles.agg((F.count("*") - cap).alias("__over"))
    free = positions(handles.where("not referenced"), order).join(F.broadcast(over), F.col("position") <= F.col("__over"), "left_semi").select("handle", F.lit(True).alias("evict"))
    return handles.join(free, "handle", "left").withColumn("evict", F.coalesce("evict", F.lit(False)))


_POOL = "h as (select user_id as handle, max(ts) as last_access, arg_max(event_type, event_id) = 'purchase' as referenced from events group by 1)"


@query("S9_handle_pool", f"with {_POOL} select handle, referenced, not referenced and rank <= over_ as evict from (select *, count(*) over () - 8 as over_, row_number() over (partition by referenced order by last_access, handle) as rank from h)")
def handle_pool_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handle_pool(_handles(spark, sf_dir), 8).drop("last_access")


@query("R9_evict_newest", f"with {_POOL} select handle from (select *, count(*) over () - 8 as over_, row_number() over (partition by referenced order by last_access desc, handle) as rank from h) where not referenced and rank <= over_")
def handle_pool_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handle_pool(_handles(spark, sf_dir), 8, newest=True).where("evict").select("handle")


def _handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("handle")).agg(F.max("ts").alias("last_access"), (F.max_by("event_type", "event_id") == "purchase").alias("referenced"))


@query("S11_pixel_window", cte("source") + "select source_id, cast(floor((wx0 - x_min) / dx) as int) as px, cast(floor((y_max - wy1) / dy) as int) as py, cast(ceil((wx1 - x_min) / dx) - floor((wx0 - x_min) / dx) as int) as width, cast(ceil((y_max - wy0) / dy) - floor((y_max - wy1) / dy) as int) as height from (select *, greatest(x_min, 0) as wx0, least(x_max, 45) as wx1, greatest(y_min, 0) as wy0, least(y_max, 45) as wy1, (x_max - x_min) / num_x as dx, (y_max - y_min) / num_y as dy from source where source_type = 'IMAGE') where wx0 < wx1 and wy0 < wy1")
def pixel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rectangle of a source's cells a tile needs (here the tile [0, 45] x [0, 45])."""
    return window_of(fixture(spark, sf_dir, "source").where("source_type = 'IMAGE'"), 0.0, 0.0, 45.0, 45.0)


def window_of(s: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    s = s.withColumns({"wx0": F.greatest("x_min", F.lit(x0)), "wx1": F.least("x_max", F.lit(x1)), "wy0": F.greatest("y_min", F.lit(y0)), "wy1": F.least("y_max", F.lit(y1))}).where("wx0 < wx1 and wy0 < wy1")
    dx, dy = (F.col("x_max") - F.col("x_min")) / F.col("num_x"), (F.col("y_max") - F.col("y_min")) / F.col("num_y")
    a, b = F.floor((F.col("wx0") - F.col("x_min")) / dx), F.ceil((F.col("wx1") - F.col("x_min")) / dx)
    c, d = F.floor((F.col("y_max") - F.col("wy1")) / dy), F.ceil((F.col("y_max") - F.col("wy0")) / dy)
    return s.select("source_id", a.cast("int").alias("px"), c.cast("int").alias("py"), (b - a).cast("int").alias("width"), (d - c).cast("int").alias("height"))


# --- text formats --------------------------------------------------------------------


def property_map(lines: Column) -> Column:
    """`key : value` lines to a map; both trimmed, a line without a colon is a value without key, later lines win."""
    pair = lambda l: F.when(F.instr(l, ":") > 0, F.struct(F.trim(F.split_part(l, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(l, r"^[^:]*:", "")).alias("v"))).otherwise(F.struct(F.lit("").alias("k"), F.trim(l).alias("v")))
    pairs = F.transform(F.filter(F.split(lines, "\n"), lambda l: F.trim(l) != ""), pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


_PROPS = "props as (select n_nationkey as id, 'name : ' || n_name || chr(10) || 'region:' || n_regionkey || chr(10) || 'host : a:b' || chr(10) || 'loose line' || chr(10) || 'region : ' || (n_regionkey + 1) as body from nation)"


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("name : "), "n_name", F.lit("\nregion:"), "n_regionkey", F.lit("\nhost : a:b\nloose line\nregion : "), F.col("n_regionkey") + 1).alias("body"))


@query("S17_property_file", f"with {_PROPS}, lines as (select id, i, l from (select id, unnest(string_split(body, chr(10))) as l, generate_subscripts(string_split(body, chr(10)), 1) as i from props)), kv as (select id, i, case when instr(l, ':') > 0 then trim(split_part(l, ':', 1)) else '' end as k, case when instr(l, ':') > 0 then trim(substr(l, instr(l, ':') + 1)) else trim(l) end as v from lines) select id, k as name, arg_max(v, i) as value from kv group by id, k")
def property_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _props(spark, sf_dir).select("id", F.explode(property_map(F.col("body"))).alias("name", "value"))


def blocks(text: Column, name: str) -> Column:
    """Bodies of `name { ... }` blocks without inner braces."""
    return F.regexp_extract_all(text, F.lit(name + r"\s*\{([^{}]*)\}"), F.lit(1))


def field(body: Column, name: str) -> Column:
    """A field of a block: the rest of its line, without quotes around it; null if it is not there or empty."""
    rest = F.trim(F.regexp_extract(body, rf"(?:^|\n)\s*{name}[ \t]+([^\n]*)", 1))
    return F.nullif(F.regexp_replace(rest, r'^"(.*)"$', "$1"), F.lit(""))


def numbers(body: Column, name: str, kind: str, names: tuple) -> list[Column]:
    """The numbers of a field, each under a name."""
    part = F.split(field(body, name), r"\s+")
    return [F.get(part, F.lit(i)).try_cast(kind).alias(n) for i, n in enumerate(names)]


#: Names of what a cache knows about a file.
EXTENTS, AFFINE, SIZE = ("x_min", "y_min", "x_max", "y_max"), ("m00", "m01", "m10", "m11", "m30", "m31"), ("size_x", "size_y", "size_z")


def read_cache(texts: DataFrame, column: str) -> DataFrame:
    """A row for each details block."""
    b = texts.select(F.explode(blocks(F.col(column), "FileDetails")).alias("b"))
    own = F.col("b")
    return b.select(field(own, "build").alias("build"), field(own, "hostname").alias("hostname"), field(own, "original").alias("original_file"), field(own, "file").alias("file"), field(own, "cs").alias("crs"), *numbers(own, "extents", "double", EXTENTS), *numbers(own, "geoTransform", "double", AFFINE), *numbers(own, "size", "int", SIZE))


def quoted(value: Column) -> Column:
    """A text as a field's value, in quotes if it is empty or has blanks."""
    return F.when(value.rlike(r"^\S+$"), value).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def cache_block(build, hostname, original, file, crs, extents: list, affine: list, size: list) -> Column:
    """K6: the block of a file's details; what is null is left out."""
    row = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"  {name} "), value, F.lit("\n"))).otherwise("")
    some = lambda values: F.when(values[0].isNotNull(), F.concat_ws(" ", *[v.cast("string") for v in values]))
    return F.concat(F.lit("FileDetails {\n"), row("build", quoted(build)), row("hostname", quoted(hostname)), row("original", quoted(original)), row("file", quoted(file)), row("cs", quoted(crs)), row("extents", some(extents)), row("geoTransform", some(affine)), row("size", some(size)), F.lit("}"))


@query("S14_cache_file", cte("variant") + "select 'build ' || host as build, 'h' || host as hostname, 'f' || original || '.tif' as original_file, 'v' || variant_id || '.tif' as file, crs, original * 0.5::double as x_min, -1.5::double as y_min, original * 0.5::double + ratio as x_max, 2.25::double as y_max, ratio as m00, 0.0::double as m01, 0.0::double as m10, -ratio as m11, original * 0.5::double as m30, 2.25::double as m31, 64 as size_x, 32 as size_y, cast(1 + host as int) as size_z from variant")
def cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of caches, some files each, written and read back as rows."""
    v = fixture(spark, sf_dir, "variant")
    x0, lit = F.col("original") * 0.5, lambda x: F.lit(float(x))
    body = cache_block(F.concat(F.lit("build "), "host"), F.concat(F.lit("h"), "host"), F.concat(F.lit("f"), "original", F.lit(".tif")), F.concat(F.lit("v"), "variant_id", F.lit(".tif")), F.col("crs"), [x0, lit(-1.5), x0 + F.col("ratio"), lit(2.25)], [F.col("ratio"), lit(0), lit(0), -F.col("ratio"), x0, lit(2.25)], [F.lit(64), F.lit(32), F.col("host") + 1])
    files = v.select(F.floor(F.col("variant_id") / 32).alias("cache"), body.alias("b")).groupBy("cache").agg(F.concat_ws("\n", F.collect_list("b")).alias("body"))
    return read_cache(files, "body")


def included(texts: DataFrame, name: str, column: str, depth: int = 8) -> DataFrame:
    """Texts with their `file other` lines replaced by the texts of that name, to some depth; a name that is not there, or lies deeper, leaves nothing."""
    files = texts.select(F.col(name).alias("__name"), F.col(column).alias("__body"))
    lines = texts.select(*[F.col(c) for c in texts.columns if c != column], F.posexplode(F.split(column, "\n")).alias("__at", "__line")).withColumn("__at", F.array("__at"))
    pattern = r"^\s*file[ \t]+\"?([^\s\"]+)\"?\s*$"
    for _ in range(depth):
        lines = lines.withColumn("__want", F.nullif(F.regexp_extract("__line", pattern, 1), F.lit("")))
        j = lines.join(files, F.col("__want") == F.col("__name"), "left").drop("__name")
        inner = F.when(F.col("__want").isNull(), F.array("__line")).when(F.col("__body").isNull(), F.array(F.lit(""))).otherwise(F.split("__body", "\n"))
        lines = j.select("*", F.posexplode(inner).alias("__k", "__new")).select(*[c for c in texts.columns if c != column], F.array_append("__at", F.col("__k")).alias("__at"), F.col("__new").alias("__line"))
    lines = lines.where(~F.col("__line").rlike(pattern))
    return lines.groupBy(*[c for c in texts.columns if c != column]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__line"))), lambda x: x["__line"]), "\n").alias(column))


def read_tasks(texts: DataFrame, set_column: str, column: str) -> DataFrame:
    """Tasks in the order of their text: commands, and names of files that hold a task."""
    item = F.regexp_extract_all(F.col(column), F.lit(r"(exec\s*\{[^{}]*\}|taskfile[ \t]+\S+)"), F.lit(1))
    found = texts.select(F.col(set_column).alias("task_set"), F.posexplode(item).alias("position", "item"))
    named = F.col("item").startswith("taskfile")
    return found.select("task_set", F.col("position").cast("long").alias("position"), F.when(named, "taskfile").otherwise("exec").alias("kind"), F.trim(F.when(named, F.regexp_replace("item", r"^taskfile\s+", "")).otherwise(F.regexp_extract("item", r"\{([^{}]*)\}", 1))).alias("command"))


def tasks_text(tasks: DataFrame) -> DataFrame:
    """K7: (task_set, body) of tasks (task_set, position, kind, command): a block for each set, which is a barrier and so bounded by what runs at once."""
    line = F.when(F.col("kind") == "taskfile", F.concat(F.lit("  taskfile "), "command")).otherwise(F.concat(F.lit("  exec { "), "command", F.lit(" }")))
    g = tasks.groupBy("task_set").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return g.select("task_set", F.concat(F.lit("Tasks {\n"), F.array_join(F.transform("lines", lambda l: l["line"]), "\n"), F.lit("\n}\n")).alias("body"))


@query("S15_task_file", cte("task") + "select task_id // 16 as task_set, task_id % 16 as position, case when task_type = 'read' then 'taskfile' else 'exec' end as kind, case when task_type = 'read' then 'tasks/t' || task_id || '.task' else 'build --task t' || task_id end as command from task")
def task_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task sets written in file order and read back; each text takes its set from a file of its own."""
    t, k = fixture(spark, sf_dir, "task"), F.col("task_id")
    named = F.col("task_type") == "read"
    rows = t.select(F.floor(k / 16).alias("task_set"), (k % 16).alias("position"), F.when(named, "taskfile").otherwise("exec").alias("kind"), F.when(named, F.concat(F.lit("tasks/t"), k, F.lit(".task"))).otherwise(F.concat(F.lit("build --task t"), k)).alias("command"))
    texts = tasks_text(rows).withColumn("name", F.format_string("set_%d.tasks", "task_set"))
    masters = texts.select("task_set", F.format_string("master_%d.tasks", "task_set").alias("name"), F.concat(F.lit("file "), "name", F.lit("\n")).alias("body"))
    whole = included(texts.select("task_set", "name", "body").union(masters), "name", "body", depth=1)
    return read_tasks(whole.where("name like 'master%'"), "task_set", "body")


def read_machines(texts: DataFrame, column: str) -> DataFrame:
    """A number of threads means the same as one of processes."""
    b = texts.select(F.explode(blocks(F.col(column), "Machine")).alias("b"))
    own = F.col("b")
    return b.select(*[field(own, n).alias(n) for n in ("hostname", "cache", "prefix", "postfix")], F.coalesce(field(own, "processes"), field(own, "threads")).cast("int").alias("processes"))


def machine_block(hostname, cache, prefix, postfix, processes) -> Column:
    """K7: the block of a machine; what is null is left out."""
    row = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"  {name} "), value, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Machine {\n"), row("hostname", quoted(hostname)), row("cache", quoted(cache)), row("prefix", quoted(prefix)), row("postfix", quoted(postfix)), row("processes", processes.cast("string")), F.lit("}"))


@query("S16_machine_file", "select n_name as hostname, '/cache/' || n_regionkey as cache, case when n_regionkey > 1 then 'ssh ' || n_name end as prefix, case when n_regionkey = 3 then '&' end as postfix, cast(1 + n_nationkey % 4 as int) as processes from nation")
def machine_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = F.col("n_regionkey")
    text = n.select(machine_block(F.col("n_name"), F.concat(F.lit("/cache/"), r), F.when(r > 1, F.concat(F.lit("ssh "), "n_name")), F.when(r == 3, "&"), 1 + F.col("n_nationkey") % 4).alias("body"))
    return read_machines(text, "body")


def read_definition(texts: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Every option of the build from a definition's text, its default where the text says nothing. Both text forms, told apart by their first line, hold the same block."""
    kinds = {"bool": "boolean", "int": "int", "float": "double", "str": "string"}
    body = F.coalesce(F.get(blocks(F.col(column), "BuildOptions"), F.lit(0)), F.lit(""))
    options = [F.coalesce(field(body, f.name).try_cast(kinds[f.type]), F.lit(f.default)).alias(f.name) for f in fields(BuildOptions)]
    return texts.select(*keep, F.col(column).startswith("#Ascii").alias("ascii_new"), *options)


@query("S13_build_definition", "select n_nationkey as id, n_nationkey % 2 = 0 as ascii_new, 256 + 64 * (n_nationkey % 3) as image_tile, n_regionkey <> 1 as power_of_two, 0.02::double * (1 + n_regionkey % 2) as skirt_ratio, case when n_regionkey = 2 then '.png' else '.dds' end as image_extension, 64 as terrain_tile, 7.0::double as distance_ratio, 'PagedLOD' as database_type from nation")
def build_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that say only what differs from the defaults, written and read back."""
    n, o, r = table(spark, sf_dir, "nation"), BuildOptions(), F.col("n_regionkey")
    given = {"image_tile": 256 + 64 * (F.col("n_nationkey") % 3), "power_of_two": r != 1, "skirt_ratio": 0.02 * (1 + r % 2), "image_extension": F.when(r == 2, ".png").otherwise(".dds")}
    text = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "#Ascii\n").otherwise(""), definition_block(given, o))
    found = read_definition(n.select(F.col("n_nationkey").alias("id"), text.alias("body")), "body", ["id"])
    return found.select("id", "ascii_new", "image_tile", "power_of_two", "skirt_ratio", "image_extension", "terrain_tile", "distance_ratio", "database_type")


def definition_block(options: dict[str, Column], defaults: BuildOptions) -> Column:
    """K5: the options that differ from the defaults."""
    lines = [F.when(v != getattr(defaults, k), F.concat(F.lit(f"  {k} "), v.cast("string"), F.lit("\n"))).otherwise("") for k, v in options.items()]
    return F.concat(F.lit("BuildOptions {\n"), *lines, F.lit("}"))


_REVS = "revs as (select 'base' || (o_custkey % 9) || '.' || (o_orderkey % 37) || '.source' as file from orders union all select 'notes.txt')"


@query("S18_revision_discovery", f"with {_REVS} select base, max(rev) as revision, arg_max(file, rev) as file from (select file, regexp_extract(file, '^(.*)[.]([0-9]+)[.]source$', 1) as base, try_cast(regexp_extract(file, '^(.*)[.]([0-9]+)[.]source$', 2) as int) as rev from revs) where rev is not null group by 1")
def revision_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("base"), F.col("o_custkey") % 9, F.lit("."), F.col("o_orderkey") % 37, F.lit(".source")).alias("file"))
    return newest_revision(o.union(spark.sql("select 'notes.txt'")))


def newest_revision(files: DataFrame) -> DataFrame:
    """The highest revision of every base name."""
    pattern = r"^(.*)[.]([0-9]+)[.]source$"
    found = files.where(F.col("file").rlike(pattern)).select("file", F.regexp_extract("file", pattern, 1).alias("base"), F.regexp_extract("file", pattern, 2).try_cast("int").alias("rev"))
    return found.groupBy("base").agg(F.max("rev").alias("revision"), F.max_by("file", "rev").alias("file"))
