from pyspark.sql import functions as F

from terrapyr.fixtures import fixture, table
from terrapyr.operators import tiling
from terrapyr.streaming import incremental


def test_stream_of_events_equals_the_batch(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "events").repartition(3).write.parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in incremental.run_touch_counts(spark, str(tmp_path / "in"), str(tmp_path / "c")).collect()}
    assert got == {tuple(r) for r in incremental.batch_touch_counts(spark, sf_dir).collect()}


def test_watch_marks_the_tiles_of_new_sources_only(spark, sf_dir, tmp_path):
    s = fixture(spark, sf_dir, "source")
    a, b = s.where("source_id < 20"), s.where("source_id between 20 and 30")
    run = lambda: incremental.watch(spark, str(tmp_path / "in"), s.schema, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    tiles = lambda df: {tuple(r) for r in df.select(*tiling.KEY).distinct().collect()}
    first = out.agg(F.min("batch")).first()[0]
    assert tiles(out.where(F.col("batch") == first)) == tiles(tiling.tile_sources(a))
    assert tiles(out.where(F.col("batch") > first)) == tiles(tiling.tile_sources(b))
