"""The driver's tables seen as sources, rasters, features, variants and tasks.

Each derivation is one list of expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Q, H = "cast(0.25 as double)", "cast(0.5 as double)"
_X, _Y, _S = f"((p_partkey * 37) % 1024) * {Q} - 128", f"((p_partkey * 53) % 512) * {Q} - 64", f"(1 + p_size % 16) * {H}"
_N = "cast(case p_partkey % 4 when 0 then 64 when 1 then 128 when 2 then 256 else 512 end as int)"

LISTS: dict[str, tuple[str, list[str]]] = {
    "source": ("part", [
        "p_partkey as source_id",
        "case when p_partkey % 8 = 7 then 'SHAPEFILE' when p_partkey % 2 = 0 then 'IMAGE' else 'HEIGHT_FIELD' end as source_type",
        "'src_' || cast(p_partkey % 1500 as string) || '.tif' as file_name",
        "case when p_size % 5 = 0 then 'night' else '' end as set_name",
        "cast(p_size % 3 as int) as layer",
        f"{_X} as x_min", f"{_Y} as y_min", f"{_X} + {_S} as x_max", f"{_Y} + {_S} as y_max",
        f"{_N} as num_x", f"{_N} as num_y",
        "case when p_partkey % 2 = 1 and p_partkey % 3 = 0 then 'VECTOR' else 'RASTER' end as data_type",
        "cast(p_size % 4 as int) as min_level", "cast(4 + p_size % 8 as int) as max_level",
    ]),
    "variant": ("orders", [
        "o_custkey % 50 as original", "o_orderkey % 4 as host", f"(1 + o_orderkey % 13) * {Q} as ratio", "o_orderkey as variant_id",
        "case when o_orderkey % 3 = 0 then 'EPSG:4326' else 'EPSG:3857' end as crs",
    ]),
    "task": ("events", [
        "event_id as task_id", "user_id % 5 as host",
        "case event_type when 'error' then 'failed' when 'view' then 'pending' when 'click' then 'running' else 'completed' end as status",
        "case when user_id % 3 = 0 then 'read' else 'write' end as task_type", "value as duration", "ts as start_time", "cast(event_id % 7 as int) as task_set",
    ]),
    "feature": ("supplier", [
        "s_suppkey as feature_id", f"(s_suppkey * 3) % 32 + {Q} as x0", f"(s_suppkey * 5) % 12 + {Q} as y0", "cast(1 + s_suppkey % 3 as double) as w", "cast(1 + s_suppkey % 2 as double) as h",
        "case when s_suppkey % 2 = 0 then 'Building' else 'Forest' end as kind", "cast(5 + s_suppkey % 20 as double) as hgt",
    ]),
    "machine": ("nation", ["n_name as hostname", "cast(1 + n_nationkey % 4 as int) as processes", "'/cache/' || cast(n_regionkey as string) as cache"]),
    "rev": ("part", [
        "p_partkey as k", "'f' || cast(p_partkey - p_partkey % 3 as string) as file_name", "case when p_partkey % 2 = 0 then 'IMAGE' else 'HEIGHT_FIELD' end as source_type", "cast(p_size as int) as size",
        "p_size % 3 <> 0 as in_old", "p_size % 5 <> 0 as in_new", "cast(p_size + case when p_size % 7 = 0 then 1 else 0 end as int) as new_size",
    ]),
    "point": ("lineitem", [f"(cast(l_quantity as bigint) % 32) * {Q} as cx", f"((l_linenumber * 5) % 32) * {Q} as cy", "l_orderkey as point_group", "cast(l_linenumber as int) as n"]),
}

#: Rows of five tiles, a tile for every supplier, of 9 x 9 posts that share borders and disagree on them.
_POST = "cast(tx as int) tx, cast(ty as int) ty, cast(c as int) c, cast(r as int) r, 8 * tx + c as gx, 8 * ty + r as gy, cast(((8 * tx + c) * 7 + (8 * ty + r) * 13 + tx * 31 + ty * 17) % 512 as double) h"
TILES_SPARK = "select cast(s_suppkey % 5 as int) as tx, cast(s_suppkey div 5 as int) as ty from {supplier}"
DEM_SPARK = "select tx, ty, cast(c as int) c, cast(r as int) r, 8L * tx + c as gx, 8L * ty + r as gy, cast(((8L * tx + c) * 7 + (8L * ty + r) * 13 + tx * 31L + ty * 17L) % 512 as double) h from {tiles} lateral view explode(sequence(0L, 8L)) as c lateral view explode(sequence(0L, 8L)) as r"
DEM_SQL = "dem as (select " + _POST + " from (select s_suppkey % 5 as tx, s_suppkey // 5 as ty from supplier), range(0, 9) x(c), range(0, 9) y(r))"
#: 8 x 8 rasters of embeddings; values below zero are no data.
CELL_SPARK = "select vec_id as source_id, cast(p % 8 as int) as c, cast(p div 8 as int) as r, cast(v as double) as v, label as band from (select vec_id, label, posexplode(embedding) as (p, v) from {embeddings})"
CELL_SQL = "cell as (select vec_id as source_id, cast((p - 1) % 8 as int) as c, cast((p - 1) // 8 as int) as r, cast(embedding[p] as double) as v, label as band from (select vec_id, label, embedding, unnest(range(1, 65)) as p from embeddings))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = LISTS[name]
    return table(spark, sf_dir, base).selectExpr(*columns)


def cte(*names: str) -> str:
    """The `with` clause that gives the oracle these fixtures."""
    parts = []
    for n in names:
        parts.append({"dem": DEM_SQL, "cell": CELL_SQL}.get(n) or f"{n} as (select {', '.join(LISTS[n][1])} from {LISTS[n][0]})")
    return "with " + ", ".join(parts) + " "


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deals few rows, of which each becomes many, over all partitions by their keys: a small table is one file, so one task. What is grouped or joined by these keys then needs no other shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = spark.sql(TILES_SPARK, supplier=table(spark, sf_dir, "supplier"))
    return spark.sql(DEM_SPARK, tiles=spread(tiles, "tx", "ty"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CELL_SPARK, embeddings=table(spark, sf_dir, "embeddings"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rasters, one a row: (source_id, v), cell (c, r) at v[r * 8 + c]. Dealt out by source."""
    return spread(table(spark, sf_dir, "embeddings").selectExpr("vec_id as source_id", "embedding as v"), "source_id")
