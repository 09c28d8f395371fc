"""Operator 8, URL filters: host-suffix and path-prefix expressions against a rule list.

Every URL is expanded into its host suffixes (as many as the longest rule host has), and these
meet the rules' hosts in an equi-join on a short hash prefix, confirmed by the full SHA-256
digest. A suffix that is some rule's host is then expanded by the path prefixes of the lengths
that this host's rules have; these expressions meet the rules the same way, and precedence
picks one. So a long list with paths of many lengths costs only the URLs under its hosts. All
of it is native.

Host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case. Path:
then up to `?`, `#` or the end. A null URL, or one without `://`, has an empty host and
path; a very long one is expanded like any other, its prefixes are only as long as rules.
Repeated rows are judged row by row. An empty rule list gives every URL the default, an empty
table of URLs no rows. Ties: of several rules that fit, the longest host plus path wins, then
the longer host, then `block`. Null rules and rules without a host are left out: they fit
nothing. Other columns of both tables may have any names; they are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "example.org", "/en/1")]
BROADCAST_RULES = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int = 16) -> DataFrame:
    """urls with (id, host, path, rule, verdict). rules: verdict, host, path."""
    rules = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path")).where("verdict is not null and r_host <> '' and r_path is not null").dropDuplicates()
    shape = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.count("*").alias("n")).first()
    host, path = split_url(F.col("_url"))
    base = urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    if not shape["n"]:
        return base.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = shape["n"] <= BROADCAST_RULES

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left join on (digest) by its first 32 bits; right has one row a digest, or few."""
        short = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
        left, right = left.withColumn("short", short(F.col("digest"))), right.withColumn("short", short(F.col("r_digest")))
        if small:
            return left.join(F.broadcast(right), "short", "left").drop("short")
        left = left.withColumn("_salt", F.pmod(F.xxhash64("_id", "_row"), F.lit(salts)).cast("int"))
        return left.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["short", "_salt"], "left").drop("short", "_salt")

    hosts = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")).select(F.sha2("r_host", 256).alias("r_digest"), "lengths")
    known = rules.select("verdict", "r_host", "r_path", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256).alias("r_digest"))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(int(shape["labels"])))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    wide = met(base.select("*", F.explode_outer(tails).alias("tail")).withColumn("digest", F.sha2("tail", 256)), hosts)
    # Rows whose host or path can carry no rule still come out of the outer explode.
    heads = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    heads = F.when(F.col("r_digest") == F.col("digest"), heads)
    wide = wide.select("_id", "_row", "host", "path", "tail", F.explode_outer(heads).alias("head"))
    joined = met(wide.withColumn("digest", F.sha2(F.concat("tail", F.lit("\n"), "head"), 256)), known)
    fits = F.col("r_digest") == F.col("digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("total"), F.length("r_host").alias("host_length"), (F.col("verdict") == "block").alias("block"))
    best = joined.groupBy("_id", "_row").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(fits, F.struct(rank.alias("rank"), F.concat("r_host", "r_path").alias("rule"), "verdict"))).alias("best"))
    return best.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = """
with base as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n from base),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'), ('block', 'example.org', '/en/1')),
hit as (select s.n, arg_max({'rule': h || p, 'verdict': verdict}, length(h) * 1000 + length(p) * 1000 + length(h)) as best
  from split s join rules on (s.host = h or ends_with(s.host, '.' || h)) and starts_with(s.path, p) group by s.n)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from split left join hit using (n)
"""
