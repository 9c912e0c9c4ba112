"""Streams: the latest row per key into a table, and sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that were written to the end."""
    fs, at = _fs(spark, f"{path}/v*/_SUCCESS")
    return [int(s.getPath().getParent().getName()[1:]) for s in fs.globStatus(at) or []]


def current_version(spark: SparkSession, path: str) -> int | None:
    """The version the pointer names, None before the first."""
    fs, at = _fs(spark, f"{path}/now-*")
    names = [int(s.getPath().getName().split("-")[1]) for s in fs.globStatus(at) or []]
    return max(names, default=None)


def _point(spark: SparkSession, path: str, version: int) -> None:
    """Pointers are empty files; the greatest counts, so making one is the whole move."""
    fs, at = _fs(spark, f"{path}/now-{version}")
    fs.create(at, True).close()
    for s in fs.globStatus(_fs(spark, f"{path}/now-*")[1]):
        if int(s.getPath().getName().split("-")[1]) < version:
            fs.delete(s.getPath(), False)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``stream_upsert`` keeps at ``path``."""
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"no table at {path} yet")
    return spark.read.parquet(f"{path}/v{version}")


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "query_id", order: str = "loaded_at") -> StreamingQuery:
    """Micro-batches merged into a table by key, the row with the greatest ``order`` winning, also over what is stored.

    Every batch writes a version of its own beside the others, under its number, and
    then moves the pointer that says which one counts; readers go through
    ``current_table``. A batch that is lost on the way leaves the version before it,
    and one that is repeated writes its version anew. The last two versions are kept.
    Rows of the stream with a null key are left out. A checkpoint belongs to one table: with a
    new one, begin a new table.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = batch.where(F.col(key).isNotNull())
        now = current_version(spark, path)
        if now is not None and now < epoch:
            latest = spark.read.parquet(f"{path}/v{now}").unionByName(latest, allowMissingColumns=True)
        elif now is not None:  # this batch again: from the version before it
            before = [v for v in _versions(spark, path) if v < epoch]
            if before:
                latest = spark.read.parquet(f"{path}/v{max(before)}").unionByName(latest, allowMissingColumns=True)
        rows = latest.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(F.col(order).isNotNull(), F.col(order))).alias("r")).select("r.*")
        rows.write.mode("overwrite").parquet(f"{path}/v{epoch}")
        _point(spark, path, epoch)
        for old in sorted(_versions(spark, path))[:-2]:
            _fs(spark, path)[0].delete(_fs(spark, f"{path}/v{old}")[1], True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window and kind, with a watermark; works on batches and streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
