"""The append-only event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files of events as they come; offsets are the checkpoint's."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def once(events: DataFrame, key: list[str], stamp: str, late: str) -> DataFrame:
    """The first event of each key; keys are remembered for ``late``."""
    return events.withWatermark(stamp, late).dropDuplicatesWithinWatermark(key)


def fold(events: DataFrame, key: str, sequence: str, payload: list[str]) -> DataFrame:
    """The latest payload by sequence and the number of updates of each id, whatever their order; for update or complete mode."""
    latest = F.max_by(F.struct(*payload), sequence).alias("l")
    return events.groupBy(key).agg(latest, F.max(sequence).alias("last_sequence"), F.count(F.lit(1)).alias("updates")).select(key, "l.*", "last_sequence", "updates")


def windows(events: DataFrame, stamp: str, value: str, width: str, late: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Tumbling or sliding counts and means, closed by a watermark; beyond what the library has to offer, for event tables."""
    w = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    return events.withWatermark(stamp, late).groupBy(w.alias("w"), *(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "mean")


def sessions(events: DataFrame, stamp: str, gap: str, late: str, by: str) -> DataFrame:
    """Sessions of an id."""
    s = F.session_window(stamp, gap)
    return events.withWatermark(stamp, late).groupBy(s.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once by the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def drain_latest(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """The same for an update stream: each batch's rows are written under its number, so a batch that runs twice overwrites itself; ``current`` reads the latest of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("batch", "batch_id", key)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("l")).select(key, "l.*")
