"""Append logs that can be resumed: files in, files out, the last write per key wins on reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.operators.evaluate import latest


def append_log(spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "json") -> int:
    """Process what has arrived in `source` since the last call and append it to `sink`; returns the batches run."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    if transform:
        stream = transform(stream)
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"] > 0])


def resume(spark: SparkSession, sink: str, key: str, order: str) -> DataFrame:
    """What the log holds now, the last write per key."""
    return latest(spark.read.parquet(sink), key, order)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and window; on a stream, late rows are dropped behind the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def watch_checkpoints(spark: SparkSession, source: str, schema: T.StructType | str, checkpoint: str, act: Callable[[dict], object], every: str | None = None, fmt: str = "json"):
    """A query that calls act(row) with the newest checkpoint of what arrives in `source` (it has a column step), once for
    each that is newer than all before it. `every` polls at that interval; without it, what has arrived is read once."""
    best: list[int] = []

    def batch(rows: DataFrame, number: int) -> None:
        found = newest_checkpoint(rows).first()
        if found and found["step"] is not None and (not best or found["step"] > best[-1]):
            best.append(found["step"])
            act(found.asDict())

    stream = spark.readStream.schema(schema).format(fmt).load(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def newest_checkpoint(steps: DataFrame) -> DataFrame:
    return steps.agg(F.max_by(F.struct(*steps.columns), "step").alias("x")).select("x.*")
