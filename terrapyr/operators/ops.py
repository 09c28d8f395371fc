"""The control plane as tables: variants and caches, tasks, timing, logs, sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import cte, fixture, table
from ..registry import query

V, T = cte("variant"), cte("task")


# --- variants of files -------------------------------------------------------------------


def best_variant(requests: DataFrame, variants: DataFrame, local: int) -> DataFrame:
    """Of the variants of each original, the one whose resolution is just finer than asked for (smallest q >= 1), else the finest of the coarser; the local host before others, then the id. Rank keys reduce in one aggregate, so no original's variants are gathered."""
    j = variants.join(requests, "original")
    q = F.col("asked") / F.col("ratio")
    rank = F.struct((q < 1).alias("coarse"), F.when(q >= 1, q).otherwise(-q).alias("far"), (F.col("host") != local).alias("remote"), "variant_id")
    return j.groupBy("original").agg(F.min_by(F.struct("variant_id", "ratio"), rank).alias("b")).select("original", "b.*")


_RANKED = "select original, variant_id, ratio from (select *, row_number() over (partition by original order by asked / ratio < 1, case when asked / ratio >= 1 then asked / ratio else -asked / ratio end, host <> 0, variant_id) as rn from (select *, 1.5::double + (original % 3) * 0.5::double as asked from variant{w})) where rn = 1"


def _requests(variants: DataFrame) -> DataFrame:
    return variants.select("original").distinct().withColumn("asked", 1.5 + (F.col("original") % 3) * 0.5)


@query("J7_best_variant", V + _RANKED.format(w=""))
def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixture(spark, sf_dir, "variant")
    return best_variant(_requests(v), v, 0)


def best_in_crs(variants: DataFrame, crs: str, local: int) -> DataFrame:
    """J7 by CRS: of the variants of each original in a CRS the finest, then the local host's, then the first id; null where an original has variants but none in it."""
    rank = F.when(F.col("crs") == crs, F.struct("ratio", F.col("host") != local, "variant_id"))
    return variants.groupBy("original").agg(F.min_by("variant_id", rank).alias("variant_id"))


@query("J7_best_in_crs", V + "select o.original, variant_id from (select distinct original from variant) o left join (select original, variant_id from variant where crs = 'EPSG:4326' qualify row_number() over (partition by original order by ratio, host <> 1, variant_id) = 1) b on o.original = b.original")
def best_variants_in_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_in_crs(fixture(spark, sf_dir, "variant"), "EPSG:4326", 1)


def compatible(a: tuple, b: tuple, a_crs: Column, b_crs: Column, near: float = 1e-6) -> Column:
    """Equal CRS and extents that differ by less than a millionth."""
    same = a_crs.eqNullSafe(b_crs)
    for x, y in zip(a, b):
        same = same & (F.abs(F.col(x) - F.col(y)) < near)
    return same


@query("S10_optimum_variant_scan", V[:-1] + f", b as ({_RANKED.format(w='')}) select source_id, coalesce('v' || b.variant_id || '.tif', file_name) as file from (select p_partkey as source_id, 'src_' || (p_partkey % 1500) || '.tif' as file_name from part) s left join b on s.source_id = b.original")
def optimum_variant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read instead of a source; the source itself where nothing is cached."""
    v = fixture(spark, sf_dir, "variant")
    b = best_variant(_requests(v), v, 0).withColumnRenamed("original", "source_id")
    return fixture(spark, sf_dir, "source").join(b, "source_id", "left").select("source_id", F.coalesce(F.concat(F.lit("v"), "variant_id", F.lit(".tif")), "file_name").alias("file"))


@query("G17_reprojected_variant", V + "select original, arg_min(variant_id, ratio * 1e6 + (host <> 0)::int * 1e5 + variant_id * 1e-6) as variant_id from variant where crs = 'EPSG:3857' group by 1")
def reprojected_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among variants in the wanted CRS the finest, local before remote."""
    v = fixture(spark, sf_dir, "variant").where("crs = 'EPSG:3857'")
    return v.groupBy("original").agg(F.min_by("variant_id", F.struct(F.col("ratio"), F.col("host") != 0, F.col("variant_id"))).alias("variant_id"))


def mirror_candidates(variants: DataFrame, target: int, local: int) -> DataFrame:
    """Files that the target lacks, from the local host if it has them, else from any."""
    there = variants.where(F.col("host") == target).select("file_key").distinct()
    return variants.join(there, "file_key", "left_anti").groupBy("file_key").agg(F.min_by("variant_id", F.struct(F.col("host") != local, F.col("host"), F.col("variant_id"))).alias("variant_id"))


@query("J11_mirror_candidates", V[:-1] + ", f as (select *, original * 1000 + variant_id % 997 as file_key from variant) select file_key, arg_min(variant_id, (host <> 0)::int * 1e12 + host * 1e10 + variant_id) as variant_id from f where file_key not in (select file_key from f where host = 3) group by 1")
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixture(spark, sf_dir, "variant").withColumn("file_key", F.col("original") * 1000 + F.col("variant_id") % 997)
    return mirror_candidates(v, 3, 0)


@query("A18_latest_modification", "select o_custkey % 50 as source, max(o_orderdate)::timestamp as modified from orders group by 1")
def latest_modification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("source")).agg(F.max("o_orderdate").alias("modified"))


@query("J16_out_of_date_tasks", T[:-1] + ", m as (select user_id as source, max(ts) as modified from events where event_type = 'signup' group by 1), t as (select event_id as task_id, user_id as source, ts as built from events where event_type = 'purchase') select task_id, t.source, coalesce(modified > built, false) as pending from t left join m using (source)")
def out_of_date_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task is to run again if a source of its changed after it ran."""
    e = table(spark, sf_dir, "events")
    m = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("modified"))
    t = e.where("event_type = 'purchase'").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("source"), F.col("ts").alias("built"))
    return t.join(m, "source", "left").select("task_id", "source", F.coalesce(F.col("modified") > F.col("built"), F.lit(False)).alias("pending"))


# --- tasks -----------------------------------------------------------------------------------


@query("A12_task_tallies", T + "select host, status, count(*) as n from task group by rollup(host, status)")
def task_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host and status, per host, and overall, in one pass."""
    return fixture(spark, sf_dir, "task").rollup("host", "status").agg(F.count("*").alias("n"))


@query("A13_timing_stats", T + "select host, task_type, count(*) as n, min(duration) as shortest, max(duration) as longest, round(sum(duration), 6) as total, round(avg(duration), 6) as mean from task where status = 'completed' group by all")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration")
    return fixture(spark, sf_dir, "task").where("status = 'completed'").groupBy("host", "task_type").agg(F.count("*").alias("n"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.round(F.sum(d), 6).alias("total"), F.round(F.avg(d), 6).alias("mean"))


def remaining(tasks: DataFrame, cores: int, now: Column) -> DataFrame:
    """Running tasks end after the mean time of completed ones, pending ones follow in waves of `cores`."""
    g = tasks.agg(F.avg(F.when(F.col("status") == "completed", F.col("duration"))).alias("mean"), F.count_if(F.col("status") == "pending").alias("pending"), F.max(F.when(F.col("status") == "running", F.col("elapsed"))).alias("oldest"), F.min(F.when(F.col("status") == "running", F.col("elapsed"))).alias("youngest"))
    mean = F.coalesce("mean", F.lit(0.0))
    left = F.greatest(F.coalesce(mean - F.col("youngest"), F.lit(0.0)), F.when(F.col("oldest") >= mean, 1.0).otherwise(0.0), F.lit(0.0)) + F.ceil(F.col("pending") / cores) * mean
    return g.select(F.round(mean, 6).alias("mean"), "pending", F.round(left, 6).alias("seconds"), F.round(100 * now / (now + left), 6).alias("percent"))


@query("A14_time_remaining", T[:-1] + ", g as (select coalesce(avg(duration) filter (where status = 'completed'), 0) as mean, count(*) filter (where status = 'pending') as pending, max(task_id % 100) filter (where status = 'running') as oldest, min(task_id % 100) filter (where status = 'running') as youngest from task), l as (select *, greatest(coalesce(mean - youngest, 0), case when oldest >= mean then 1 else 0 end, 0) + ceil(pending / 10.0) * mean as s from g) select round(mean, 6) as mean, pending, round(s, 6) as seconds, round(100 * 3600.0 / (3600.0 + s), 6) as percent from l")
def time_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixture(spark, sf_dir, "task").withColumn("elapsed", (F.col("task_id") % 100).cast("double"))
    return remaining(t, 10, F.lit(3600.0))


@query("A19_subtiles_complete", T + "select task_id // 4 as parent, bool_and(status = 'completed') as complete, count(*) as children from task group by 1")
def subtiles_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "task").groupBy(F.floor(F.col("task_id") / 4).alias("parent")).agg(F.bool_and(F.col("status") == "completed").alias("complete"), F.count("*").alias("children"))


@query("A20_cut_off_distance", T + "select task_id // 4 as parent, greatest(max(duration), any_value(task_id // 4 % 10) * 7.0::double) as cut_off from task group by 1")
def cut_off_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The farthest of the children's, but not below the bound times the distance ratio."""
    parent = F.floor(F.col("task_id") / 4)
    return fixture(spark, sf_dir, "task").groupBy(parent.alias("parent")).agg(F.max("duration").alias("far")).select("parent", F.greatest("far", (F.col("parent") % 10) * 7.0).alias("cut_off"))


@query("A21_pool_counts", T[:-1] + ", " + cte("machine")[5:-1] + " select hostname, processes, count(task_id) filter (where status = 'running') as running, count(task_id) filter (where status not in ('completed', 'failed')) as not_done, count(task_id) filter (where status = 'running') > 0 as active from (select *, row_number() over (order by hostname) - 1 as i from machine) m left join task on host = i % 5 and task_id % 25 = i group by 1, 2")
def pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "machine").withColumn("i", F.row_number().over(W.orderBy("hostname")) - 1)
    t = fixture(spark, sf_dir, "task").withColumn("i", (F.col("task_id") % 25).cast("int")).where("host = i % 5")
    s = F.col("status")
    return m.join(t, "i", "left").groupBy("hostname", "processes").agg(F.count_if(s == "running").alias("running"), F.count_if(~s.isin("completed", "failed")).alias("not_done"), (F.count_if(s == "running") > 0).alias("active"))


@query("C1_task_barriers", T + "select task_set, count(*) filter (where status <> 'completed') as open, sum(count(*) filter (where status <> 'completed')) over (order by task_set rows between unbounded preceding and 1 preceding)::bigint as open_before, coalesce(sum(count(*) filter (where status <> 'completed')) over (order by task_set rows between unbounded preceding and 1 preceding), 0) = 0 as may_start from task group by 1")
def task_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set may start when all before it are done. The window is over sets, not tasks."""
    g = fixture(spark, sf_dir, "task").groupBy("task_set").agg(F.count_if(F.col("status") != "completed").alias("open"))
    before = F.sum("open").over(W.orderBy("task_set").rowsBetween(W.unboundedPreceding, -1))
    return g.select("task_set", "open", before.alias("open_before"), (F.coalesce(before, F.lit(0)) == 0).alias("may_start"))


#: What a pool does when a task fails.
POLICIES = ("IGNORE", "BLACKLIST_MACHINE_AND_RESUBMIT_TASK", "COMPLETE_RUNNING_TASKS_THEN_EXIT", "TERMINATE_RUNNING_TASKS_THEN_EXIT")


def after_failures(tasks: DataFrame) -> DataFrame:
    """For every policy and host, what follows from the failures there are: whether the host still takes tasks, which failed ones go again, and which pending and running ones are dropped. Both ways to exit end the whole pool once any host has a failure."""
    n = lambda s: F.count_if(F.col("status") == s)
    hosts = tasks.groupBy("host").agg(n("failed").alias("failures"), n("pending").alias("waiting"), n("running").alias("busy"))
    pool = tasks.agg((n("failed") > 0).alias("any"))
    each = hosts.join(F.broadcast(pool)).withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES))))  # one row: no product
    p, some = F.col("policy"), F.col("failures") > 0
    ends = p.endswith("THEN_EXIT") & F.col("any")
    return each.select(
        "policy", "host", "failures",
        (~ends & ~((p == POLICIES[1]) & some)).alias("active"),
        F.when(p == POLICIES[1], F.col("failures")).otherwise(0).alias("resubmitted"),
        F.when(ends, F.col("waiting")).otherwise(0).alias("removed"),
        F.when(ends & p.startswith("TERMINATE"), F.col("busy")).otherwise(0).alias("terminated"),
    )


@query("C3_failure_policy", T[:-1] + ", h as (select host, count(*) filter (where status = 'failed') as f, count(*) filter (where status = 'pending') as w, count(*) filter (where status = 'running') as b, (select bool_or(status = 'failed') from task) as any_ from task group by 1) select policy, host, f as failures, case policy when 'IGNORE' then true when 'BLACKLIST_MACHINE_AND_RESUBMIT_TASK' then f = 0 else not any_ end as active, case when policy = 'BLACKLIST_MACHINE_AND_RESUBMIT_TASK' then f else 0 end as resubmitted, case when policy in ('COMPLETE_RUNNING_TASKS_THEN_EXIT', 'TERMINATE_RUNNING_TASKS_THEN_EXIT') and any_ then w else 0 end as removed, case when policy = 'TERMINATE_RUNNING_TASKS_THEN_EXIT' and any_ then b else 0 end as terminated from h, (values ('IGNORE'), ('BLACKLIST_MACHINE_AND_RESUBMIT_TASK'), ('COMPLETE_RUNNING_TASKS_THEN_EXIT'), ('TERMINATE_RUNNING_TASKS_THEN_EXIT')) p(policy)")
def failure_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after_failures(fixture(spark, sf_dir, "task"))


def stop_run(spark: SparkSession, group: str) -> None:
    """C4: what a signal does to a build: all jobs of its group are cancelled, the rest of the session goes on."""
    spark.sparkContext.cancelJobGroup(group)


@query("C6_operation_log", T + "select task_id, host, start_time, round(epoch(start_time - lag(start_time) over (partition by host order by start_time, task_id)), 3) as waited from task where status = 'completed'")
def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with the time since the one before on their host. Hosts are few and busy, so rows meet by host and hour; the first of an hour looks up the last of the hour before it, in a table of one row for each."""
    t = fixture(spark, sf_dir, "task").where("status = 'completed'").withColumn("micros", F.unix_micros(F.col("start_time").cast("timestamp")))
    return waits(t).select("task_id", "host", "start_time", F.round(F.col("waited") / 1e6, 3).alias("waited"))


def waits(operations: DataFrame, bucket_micros: int = 3_600_000_000) -> DataFrame:
    """Operations (task_id, host, micros) with the micros since the one before."""
    t = operations.withColumn("__hour", F.floor(F.col("micros") / bucket_micros))
    own = F.lag("micros").over(W.partitionBy("host", "__hour").orderBy("micros", "task_id"))
    ends = t.groupBy("host", "__hour").agg(F.max("micros").alias("__last"))
    ends = ends.select("host", "__hour", F.lag("__last").over(W.partitionBy("host").orderBy("__hour")).alias("__before"))
    return t.join(ends, ["host", "__hour"]).withColumn("waited", F.col("micros") - F.coalesce(own, "__before")).drop("__hour", "__before")


@query("C7_build_validity", "select n_nationkey as id, case when n_nationkey % 4 = 0 and n_nationkey % 3 <> 0 then 'optional layers need TERRAIN geometry' when n_nationkey % 5 = 0 then 'options are not compatible with the previous build' else '' end as problem from nation")
def build_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    o = table(spark, sf_dir, "nation").select(k.alias("id"), (k % 4 == 0).alias("optional_layers"), F.when(k % 3 == 0, "TERRAIN").otherwise("POLYGONAL").alias("geometry_type"), (k % 5 != 0).alias("compatible"))
    return o.select("id", validity(F.col("optional_layers"), F.col("geometry_type"), F.col("compatible")).alias("problem"))


def validity(optional_layers: Column, geometry: Column, compatible: Column) -> Column:
    return F.when(optional_layers & (geometry != "TERRAIN"), "optional layers need TERRAIN geometry").when(~compatible, "options are not compatible with the previous build").otherwise("")


@query("P26_pyramid_sizing", "select level, case when level = 0 then 1 else 2 * (1 << (level - 1)) end as tiles, cast(case when level = 0 then 1 else 2 * (1 << (level - 1)) end as bigint) * 255 as width, cast(case when level = 0 then 1 else 1 << (level - 1) end as bigint) * 255 + 1 as height, (select min(l) from range(0, 31) t(l) where (case when l = 0 then 1 else 2 * (1 << (l - 1)) end) * 255 >= 43200 and (case when l = 0 then 1 else 1 << (l - 1) end) * 255 + 1 >= 21600) as needed from (select cast(l as int) as level from range(0, 21) r(l))")
def pyramid_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large each level of a pyramid is, and the first that holds a source of 43200 x 21600."""
    return sizing(spark, 21, 2, 1, 256, 43_200, 21_600)


def sizing(spark: SparkSession, levels: int, columns: int, rows: int, tile: int, width: int, height: int) -> DataFrame:
    many = lambda n: F.when(F.col("level") == 0, 1).otherwise(F.lit(n) * F.expr("shiftleft(1, greatest(level - 1, 0))"))
    t = spark.range(31).select(F.col("id").cast("int").alias("level")).withColumns({"tiles": many(columns), "width": many(columns).cast("long") * (tile - 1), "height": many(rows).cast("long") * (tile - 1) + 1})
    needed = F.min(F.when((F.col("width") >= width) & (F.col("height") >= height), F.col("level")).cast("long")).over(W.partitionBy())
    return t.withColumn("needed", needed).where(F.col("level") < levels)


@query("P26_efficiency", "select tile, level, round(w::double * h / (cx * cx2), 9) as efficiency from (select t.tile as tile, l as level, 43200 as w, 21600 as h, 2 * (1 << l) * (t.tile - 1)::double as cx, (1 << l) * (t.tile - 1)::double + 1 as cx2 from range(5, 10) r(l), (values (64), (128), (256)) t(tile))")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a level's pixels that a source fills."""
    t = spark.range(5, 10).select(F.col("id").alias("level"), F.explode(F.array(*map(F.lit, (64, 128, 256)))).alias("tile"))
    side = F.expr("shiftleft(1, cast(level as int))") * (F.col("tile") - 1).cast("double")
    return t.select("tile", "level", F.round(F.lit(43_200.0) * 21_600 / (side * 2 * (side + 1)), 9).alias("efficiency"))
