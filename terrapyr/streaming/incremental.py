"""Incremental builds as streams. No stream engine is behind these in what they replace: there, a build was run again.

`watch` reads a growing catalog in batches and marks dirty tiles; `touch_counts` counts
events in tumbling windows with a watermark and is an addition of this library.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..fixtures import table
from ..operators import tiling
from ..registry import query


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder where driver and executors both see it: under spark.checkpoint.dir, or a temporary one if all run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp()


def watch(spark: SparkSession, catalog_dir: str, schema: StructType, out_dir: str, checkpoint_dir: str, files_per_batch: int = 64):
    """A stream that appends the tiles touched by each batch of new sources, tagged with the batch; a repeated batch overwrites its own."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(catalog_dir)

    def mark(batch: DataFrame, number: int) -> None:
        tiles = tiling.tile_sources(batch).select(*tiling.KEY).distinct()
        tiles.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return stream.writeStream.foreachBatch(mark).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def touch_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind. On a stream, rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant; the session's zone is UTC
    return timed.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("ST_touch_counts", "select time_bucket(interval '1 hour', ts)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def batch_touch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's plan on a table; rows equal what the stream has emitted in the end."""
    return touch_counts(table(spark, sf_dir, "events"))


def run_touch_counts(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The same as a stream of a folder of event files, run to its end; complete mode keeps every window."""
    folder = folder or shared_folder(spark, "touch-counts")
    schema = spark.read.parquet(path).schema
    stream = touch_counts(spark.readStream.schema(schema).parquet(str(Path(path).parent) if path.endswith(".parquet") and Path(path).is_file() else path))
    name = f"touch_{abs(hash(folder))}"
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
