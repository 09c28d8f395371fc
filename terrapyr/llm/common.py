"""What the corpus operators share: shared storage, salted lookups, vectorised words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of ids with no more rows than these are broadcast: some MB.
HELD_ROWS = 200_000
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where the session names none and all runs in one process; a cluster must name one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        own = tempfile.mkdtemp(prefix="terrapyr-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/terrapyr-{what}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    atexit.register(_remove, spark, path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Removes, at its end, all folders that were made inside it."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*settled: DataFrame) -> None:
    """Removes settled tables that nothing will read again."""
    for df in settled:
        _remove(df.sparkSession, df._settled)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, salts: int = 32) -> DataFrame:
    """Left join with a table that has one row a key; weight: its column with the key's rows on the left. A key with more than a thousandth of all these rows, of which there are fewer than a thousand, is dealt over `salts` tasks, with its row in `right` repeated as often."""
    right = settle(right, "lookup")
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > F.lit(max(total // 1000, salts))
    keys = right.where(hot).select(F.col(key).alias("_hot"))
    left = left.join(F.broadcast(keys), F.col(key) == F.col("_hot"), "left")
    left = left.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(weight)
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --- vectorised words -------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            grow = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, _INV)]
        _POWERS[size] = (grow[0], grow[1])
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string or binary array; nulls are empty."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), at - (at[0] if len(at) else 0)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, solid: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word. solid: words end at white space only, else at all ASCII that is no letter or digit."""
    inside = (_SOLID if solid else _LETTER)[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _FOLD[data]


def fold_letters(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1, Greek and Cyrillic in lower case, in UTF-8; no text gets longer or shorter."""
    out = _FOLD[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xCE) | (data[:-1] == 0xD0)) if len(data) > 1 else np.zeros(0, np.int64)
    a, b = data[lead], data[lead + 1]
    latin = (a == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
    near = latin | ((a == 0xCE) & (b >= 0x91) & (b <= 0x9F)) | ((a == 0xD0) & (b >= 0x90) & (b <= 0x9F))
    far = ((a == 0xCE) & (b >= 0xA0) & (b <= 0xA9)) | ((a == 0xD0) & (b >= 0xA0) & (b <= 0xAF))
    out[lead[near] + 1] += 0x20
    out[lead[far]] += 1  # these lie under the next lead byte
    out[lead[far] + 1] -= 0x20
    return out


def trim() -> None:
    """Gives memory that is free back to the system, where the C library can."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batch, mb: float = 1):
    """Parts of an Arrow batch whose texts together have some MB at most, or one row. What was freed on the way goes back to the system, as workers live on."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + int(mb * 2**20), side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
    pa.default_memory_pool().release_unused()
    trim()


def keep_where(docs: DataFrame, wanted) -> DataFrame:
    """The rows for which `wanted(bytes, offsets)` of the column text says so, with all their columns and without a shuffle. Only texts go to the workers, and one bit a row comes back."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def says(text: pa.Array) -> pa.Array:
        parts = [pa.array(wanted(*arrow_bytes(part.column("text"))), pa.bool_()) for part in slices(pa.RecordBatch.from_arrays([text], ["text"]))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return docs.where(says(F.col("text").cast("string")))
