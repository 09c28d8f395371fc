"""Operator 5, SimHash near-dedup by multi-index hashing.

Fingerprints: A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, shingles of three words with
repeats, joined by a space (fewer words: all of them; none: fingerprint zero), XXH64 with
seed 42; a bit is set if it is in over half the hashes.

Links, at 3 or fewer differing bits: two fingerprints that close agree up to one bit in one
of their two 32-bit segments. Every distinct fingerprint is in a table under each segment,
and asks under its segment and all values one bit away; of two such neighbours the one with
the zero bit asks, which halves the questions. What meets is verified over all 64 bits.

Texts with one fingerprint are one node. A crowded key (many distinct fingerprints that
share a segment, as near copies do) is cut into blocks of members and of askers; pairs of
blocks are compared in bounded groups that return a spanning forest instead of pairs. No
link is lost, no partner capped.

Null texts are empty, like those without words. Very long texts are hashed some thousand
shingles at a time. Null ids do not count for a component's smallest id unless it has no other.
Ties (a bit set in just half the hashes) leave the bit 0. Repeated rows come back as often as
given; `dedup` keeps one of them. An empty table gives no rows. Other columns may have any
names: `group` does not read them, `dedup` returns them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD_ROWS, settle, table
from .components import components, forest

CROWDED = 64
BLOCK = 1024
DISTANCE = 3


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    import xxhash

    flat = b" ".join(text.lower().split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = len(gaps) + 1 - (width - 1)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(flat, 42)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(flat)]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        h = np.array([digest(flat[a:b], 42) for a, b in zip(starts[i : i + 4096], ends[i : i + 4096])], "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): h is a hash of the text, fp the fingerprint as a signed bigint."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fps = np.array([fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(work, f"doc_id {kind}, h long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that are linked."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    segments = F.array(F.struct(F.lit(0).alias("s"), low.alias("key")), F.struct(F.lit(1).alias("s"), high.alias("key")))
    index = fps.select("fp", F.explode(segments).alias("x")).select("x.s", "x.key", "fp")
    ask = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    # A bit that is set already gives the key itself, which is asked once.
    asks = index.select("s", "fp", F.explode(F.array_append(F.array_remove(ask, F.col("key")), F.col("key"))).alias("key"))
    crowd = settle(index.groupBy("s", "key").agg(F.count("*").alias("members")).where(F.col("members") > CROWDED), "crowd")

    near = lambda a, b: (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE) & (a != b)
    few = index.join(crowd.select("s", "key"), ["s", "key"], "left_anti").withColumnRenamed("fp", "b")
    plain = asks.withColumnRenamed("fp", "a").join(few.hint("merge"), ["s", "key"]).where(near(F.col("a"), F.col("b"))).select("a", "b")

    # Crowded keys: blocks of members against blocks of askers.
    askers = asks.join(crowd, ["s", "key"])
    counted = askers.groupBy("s", "key").agg(F.ceil(F.count("*") / BLOCK).alias("qs"), F.first(F.ceil(F.col("members") / BLOCK)).alias("ms"))
    counted = settle(counted, "crowd-blocks")
    block = lambda n: F.pmod(F.xxhash64(F.lit(5), "fp"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sent = index.join(counted, ["s", "key"]).select("s", "key", block("ms").alias("m"), every("qs").alias("q"), "fp", F.lit(True).alias("member"))
    sent = sent.union(asks.join(counted, ["s", "key"]).select("s", "key", every("ms").alias("m"), block("qs").alias("q"), "fp", F.lit(False).alias("member")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, member = group["fp"].to_numpy(), group["member"].to_numpy()
        m, q, found = fp[member], fp[~member], []
        for i in range(0, len(q), 256):
            far = np.bitwise_count((q[i : i + 256, None] ^ m[None, :]).view(np.uint64))
            x, y = np.nonzero(far <= DISTANCE)
            found.append((q[i + x], m[y]))
        if not found:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return pd.DataFrame({"a": a, "b": b})

    return plain.union(sent.groupBy("s", "key", "m", "q").applyInPandas(compare, "a long, b long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every document, and (fp, first_id, component) of every fingerprint; component is a fingerprint."""
    got = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = settle(got.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    joined = components(links(nodes.select("fp")))
    named = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return got, settle(named, "named")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    got, named = _grouped(docs, id_col, text_col)
    # A component's smallest id comes back to each of its fingerprints.
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return got.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, in its own columns: that with the smallest id (null last), then text hash."""
    return keep_one(docs, *_grouped(docs, "doc_id", "text"))


def keep_one(docs: DataFrame, got: DataFrame, named: DataFrame) -> DataFrame:
    """The same, for given (doc_id, h, fp) of the documents and (fp, component)."""
    best = got.join(named.select("fp", "component"), "fp").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "h")).alias("best"))
    best = settle(best.select(F.col("best.doc_id").alias("_id"), F.col("best.h").alias("_h")).distinct(), "kept")
    own = F.xxhash64(docs["text"].cast("string"))
    same = lambda other: docs["doc_id"].eqNullSafe(other["_id"]) & (own == other["_h"])
    # Rows that repeat id and text: rare, and only then looked at by content.
    twice = got.join(best, got["doc_id"].eqNullSafe(best["_id"]) & (got["h"] == best["_h"]), "left_semi").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    twice = settle(twice, "repeated")
    if not twice.limit(1).count():
        # What goes is mostly little: then no document is moved.
        gone = settle(got.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).join(best.withColumnsRenamed({"_id": "_i", "_h": "_j"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h").eqNullSafe(F.col("_j"))), "left_anti"), "removed")
        if gone.count() <= HELD_ROWS:
            return docs.join(F.broadcast(gone), docs["doc_id"].eqNullSafe(gone["_id"]) & own.eqNullSafe(gone["_h"]), "left_anti")
        return docs.join(best, same(best), "left_semi")
    once = best.join(twice, best["_id"].eqNullSafe(twice["_id"]) & (best["_h"] == twice["_h"]), "left_anti")
    return docs.join(once, same(once), "left_semi").union(docs.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
