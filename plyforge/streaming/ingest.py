"""Resumable ingestion of files, and event-time operators (the latter beyond batch parity)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_files(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = None) -> int:
    """Takes in the Parquet files that have not been taken in yet, then stops; returns the rows that are new in the target.

    The stream's checkpoint remembers finished files: a run that was broken off
    goes on where it was, and no file counts twice.  Rows are counted in the
    target, after ``transform``.  A run that takes files in and leaves a target
    that holds nothing is an error.
    """
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source)
    if transform:
        stream = transform(stream)
    before = _rows(spark, target, stream.schema)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    after = _rows(spark, target, stream.schema)
    if not after and not spark.read.parquet(source).isEmpty():
        raise ValueError(f"{source}: nothing passed the filter")
    return after - before


def _rows(spark: SparkSession, target: str, schema) -> int:
    """Rows of a stream's target, by its own list of finished files; 0 where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.schema(schema).parquet(target).count()


def ingest_shards(spark: SparkSession, shards: Sequence[str], target: str, keep: Callable[[DataFrame], DataFrame], *, limit: int | None = None, drop_shards: bool = False) -> int:
    """Filters shards one after the other into part files until ``limit`` rows are kept, then merges the parts; returns the rows.

    A part that is there already is counted and not filtered again, so a run
    that was broken off goes on at the shard it stopped at.  With
    ``drop_shards`` a shard is deleted once its part is committed.  No shards,
    or none with a row that is kept, is an error; the parts then stay.
    """
    from plyforge.sources.files import merge_parts

    if not shards:
        raise ValueError("no shards")
    conf, jpath = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    kept, parts = 0, f"{target}.parts"
    for number, shard in enumerate(sorted(shards)):
        if limit is not None and kept >= limit:
            break
        part = f"{parts}/part-{number:05d}"
        done = jpath(f"{part}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            rows = keep(spark.read.parquet(shard))
            (rows if limit is None else rows.limit(limit - kept)).write.mode("overwrite").option("compression", "zstd").parquet(part)
            if drop_shards:
                jpath(shard).getFileSystem(conf).delete(jpath(shard), True)
        kept += spark.read.parquet(part).count()
    if not kept:
        raise ValueError("nothing passed the filter")
    return merge_parts(spark, parts, target)


def pending_files(listed: DataFrame, done: DataFrame) -> DataFrame:
    """(path) listed and not yet recorded as done."""
    return listed.select("path").distinct().join(done.select("path").distinct(), "path", "left_anti")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and values of each window and type; rows later than ``late`` are not waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end, events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")
