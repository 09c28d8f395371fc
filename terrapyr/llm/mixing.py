"""Operator 1, mixing sources to target weights.

Each source's documents, in a fixed order, are one stream of words that is packed into blocks
of `block_words`. Each output shard has `shard_slots` slots (the last may have fewer). Every
slot draws its source with a uniform of its own, in proportion to the sources' targets, so a
shard's counts are multinomial. The slots of a source are numbered over all shards; slot r
takes block perm(r mod n) in pass r div n, where perm is a swap-or-not shuffle of [0, n) that
needs no table. Slots and blocks meet in a join by (source, block). `mixture` has a row for
every slot and document span in it, `texts` puts their words together, and `mix` counts what
each document gives.

No block is taken more than `cap` times, so no document is either: slots that a source cannot
fill draw again among those that can, in proportion to their targets, and what is left after
a few rounds goes to free blocks in order. So no slot stays empty.

Sizes are words `[^\\x20\\x09-\\x0D]+`; a null text has size 0. Sources rank by code point,
null last, with weights repeating. Targets stop at `cap` times the source's size and what is
above is shared out again by weight; as all sources below their cap always keep targets in
proportion to weight, that is one threshold, found from running sums. Everything is a
function of the rows and `seed`: reruns agree. Ties in the order of documents are rows with
equal id and text, which are interchangeable; each is a document of its own. Very long texts
are cut into as many blocks as they fill. Empty tables give no rows, and sources without words
no blocks. Other columns may have any names; they are not read.

Everything is native. A hot source is dealt over (source, bucket) groups; only sums per
source and bucket, or source and shard, are ordered by source. Sources are taken to be few:
their targets and cut points are held by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settle, table


def permute(x: Column, n: Column, key: Column, rounds: int) -> Column:
    """Swap-or-not shuffle (Hoang, Morris, Rogaway 2012): a keyed bijection of [0, n)."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) + n - at, n)
        bit = F.xxhash64(F.greatest(at, other), key, r).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def unit(*key: Column) -> Column:
    """A uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / F.lit(float(2**53))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(nul, name, idx, source_size, target) of (nul, name, size)."""
    per = sizes.groupBy("nul", "name").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("idx", F.row_number().over(W.orderBy("nul", "name")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("idx") % len(weights) + 1)).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("limit") / F.col("weight"), "idx")
    left = F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    share = left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    marked = ranked.withColumn("share", share).withColumn("full", F.col("share") * F.col("weight") > F.col("limit"))
    # Below the cap the share no longer changes: the first such row's share holds for all after it.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "idx", "share"))).over(W.partitionBy())
    return marked.withColumn("level", level["share"]).select("nul", "name", "idx", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def cuts(weights: list[float]) -> list[float]:
    """Upper ends of the parts of [0, 1) in proportion to weights; the last is 1."""
    total, run, out = sum(weights), 0.0, []
    for w in weights:
        run += w
        out.append(run / total)
    last = max((i for i, w in enumerate(weights) if w > 0), default=0)
    return [1.0 if i >= last else c for i, c in enumerate(out)]


def _part(value: Column, ends: list) -> Column:
    """How many of the ends do not lie above a value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= value))


def draw(spark: SparkSession, sources: list, slots: int, per_shard: int, cap: int, seed: int, rounds: int = 6) -> DataFrame:
    """(shard, idx, count) of sources [(idx, blocks, draws)], idx being their place in the list."""
    shards = -(-slots // per_shard)
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = [blocks * cap for _, blocks, _ in sources]
    ends = cuts([d for _, _, d in sources])
    size = F.least(F.lit(per_shard).cast("long"), F.lit(slots) - F.col("shard") * per_shard)
    begins = spark.range(0, shards, 1, max(1, min(shards, many))).withColumnRenamed("id", "shard")
    each = begins.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("slot"))
    drawn = each.select("shard", _part(unit(F.lit(seed), "shard", "slot"), ends).alias("idx"))
    counts = settle(drawn.groupBy("shard", "idx").agg(F.count("*").alias("count")), "draws")
    for k in range(1, rounds + 1):
        have = {r["idx"]: r["n"] for r in counts.groupBy("idx").agg(F.sum("count").alias("n")).collect()}
        spare = [max(0, limit[i] - have.get(i, 0)) for i in range(len(sources))]
        if all(n <= limit[i] for i, n in have.items()):
            return counts
        before = F.coalesce(F.sum("count").over(W.partitionBy("idx").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        room = F.greatest(F.element_at(F.array(*[F.lit(x).cast("long") for x in limit]), F.col("idx") + 1) - before, F.lit(0))
        cut = counts.withColumn("kept", F.least("count", room))
        over = cut.groupBy("shard").agg(F.sum(F.col("count") - F.col("kept")).alias("n")).where("n > 0")
        if k < rounds:
            again = over.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
            weights = [d if spare[i] else 0.0 for i, (_, _, d) in enumerate(sources)]
            again = again.select("shard", _part(unit(F.lit(seed), F.lit(k), "shard", "slot"), cuts(weights if any(weights) else [float(x) for x in spare])).alias("idx"))
        else:
            first = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a shard that has some left
            again = over.withColumn("first", first).select("shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
            again = again.select("shard", _part(F.col("slot"), [sum(spare[: i + 1]) for i in range(len(spare))]).alias("idx"))
        both = cut.select("shard", "idx", F.col("kept").alias("count")).union(again.groupBy("shard", "idx").agg(F.count("*").alias("count")))
        counts = settle(both.groupBy("shard", "idx").agg(F.sum("count").alias("count")).where("count > 0"), "draws")
    return counts


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, block_words: int, shard_slots: int, seed: int, rounds: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents' pieces of blocks, and (shard, slot, idx, block, pass) of every slot."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("nul"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    sized = settle(sized, "sizes")
    buckets = max(256, sized.count() // bucket_rows)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sources = settle(source_targets(sized, weights, cap), "sources")
    held = [(r["idx"], -(-r["source_size"] // block_words), r["target"] * -(-r["source_size"] // block_words) / r["source_size"] if r["source_size"] else 0.0) for r in sources.orderBy("idx").collect()]
    slots = round(sum(d for _, _, d in held))

    # Where each document lies in its source's stream.
    parts = sized.groupBy("nul", "name", "bucket").agg(F.sum("size").alias("part"))
    parts = parts.join(sources.select("nul", "name", "idx", "source_size", "target"), ["nul", "name"])
    parts = parts.withColumn("base", F.coalesce(F.sum("part").over(W.partitionBy("idx").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("part")
    within = W.partitionBy("nul", "name", "bucket").orderBy("doc_id", "h")
    placed = sized.withColumn("row", F.row_number().over(within)).withColumn("end", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(parts, ["nul", "name", "bucket"]).withColumn("end", F.col("end") + F.col("base")).withColumn("start", F.col("end") - F.col("size"))
    lie = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(end - 1) div {block_words}"))).otherwise(F.array(-F.col("row").cast("long")))
    pieces = placed.select("idx", "bucket", "row", "doc_id", "h", "size", "source_size", "target", "start", "end", F.explode(lie).alias("block"))
    begin, past = F.greatest("start", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    pieces = pieces.withColumns({"words": F.when(F.col("block") >= 0, past - begin).otherwise(0), "skip": begin - F.col("start"), "at": begin - F.col("block") * block_words}).drop("start", "end")

    # Which block each slot takes.
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not slots:
        return pieces, spark.createDataFrame([], "shard long, slot long, idx int, block long, pass long")
    counts = draw(spark, held, slots, shard_slots, cap, seed)
    run = lambda by, order: F.coalesce(F.sum("count").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"before": run("idx", "shard"), "lead": run("shard", "idx"), "n": F.sum("count").over(W.partitionBy("shard"))}).repartition(many, "idx", "shard")
    blocks = F.element_at(F.array(*[F.lit(n).cast("long") for _, n, _ in held]), F.col("idx") + 1)
    each = counts.select("shard", "idx", "lead", "n", "before", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))
    each = each.withColumn("r", F.col("before") + F.col("i"))
    block = permute(F.col("r") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "idx", F.expr("r div blocks")), rounds)
    slot = permute(F.col("lead") + F.col("i"), F.col("n"), F.xxhash64(F.lit(seed), F.lit("slot"), "shard"), rounds)
    return pieces, each.select("shard", slot.alias("slot"), "idx", block.alias("block"), F.expr("r div blocks").alias("pass"))


def _options(id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), cap=3, block_words=32, shard_slots=65_536, seed=20_240, rounds=16, bucket_rows=20_000) -> tuple:
    return id_col, text_col, source_col, tuple(weights), cap, block_words, shard_slots, seed, rounds, bucket_rows


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix: (shard, slot, idx, block, pass, doc_id, h, skip, words, at) of every document span in every slot. h: hash of the text; skip: the document's words before the span; at: the slot's words before it."""
    pieces, slots = _plan(docs, *_options(**options))
    return slots.join(pieces.select("idx", "block", "doc_id", "h", "skip", "words", "at"), ["idx", "block"]).select("shard", "slot", "idx", "block", "pass", "doc_id", "h", "skip", "words", "at")


def texts(docs: DataFrame, **options) -> DataFrame:
    """(shard, slot, n_words, text) of every slot of the mix, words set apart by a space. A slot's spans are few: its block has no more words than them."""
    o = _options(**options)
    own = docs.select(F.col(o[0]).alias("_id"), F.col(o[1]).cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text")).dropDuplicates(["_id", "_h"])
    m = mixture(docs, **options)
    said = m.join(own, m["doc_id"].eqNullSafe(own["_id"]) & (m["h"] == own["_h"]))
    span = F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), (F.col("skip") + 1).cast("int"), F.col("words").cast("int"))
    return said.select("shard", "slot", "words", "at", F.array_join(span, " ").alias("s")).groupBy("shard", "slot").agg(F.sum("words").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), " ").alias("text"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document: what the slots take of it."""
    pieces, slots = _plan(docs, *_options(**options))
    takes = slots.groupBy("idx", "block").agg(F.count("*").alias("takes"))
    joined = pieces.join(takes.hint("merge"), ["idx", "block"], "left").withColumn("took", F.col("words") * F.coalesce("takes", F.lit(0)))
    out = joined.groupBy("idx", "bucket", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("took").cast("long").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
