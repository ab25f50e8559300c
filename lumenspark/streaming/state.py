"""Streams with state: the latest row per key, sessions, repeats within a watermark, and a sink that adds each batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that states with a time to live need, for queries that start inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class _Latest(StatefulProcessor):
    """Keeps the greatest `order` of a key; rows that don't exceed it are late and give nothing."""

    def __init__(self, order: str, ttl_ms: int | None):
        self.order, self.ttl = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("at", T.LongType())]), self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for some in rows:
            some = some[some[self.order].notna()]
            if len(some):
                last = some.loc[[some[self.order].idxmax()]]
                if best is None or last[self.order].iloc[0] > best[self.order].iloc[0]:
                    best = last
        if best is None:
            return
        at = int(best[self.order].iloc[0])
        if not self.seen.exists() or at > self.seen.get()[0]:
            self.seen.update((at,))
            yield best

    def close(self) -> None:
        pass


def latest_updates(stream: DataFrame, key: str, order: str, ttl_ms: int | None = None) -> DataFrame:
    """Of a stream, the rows that are the newest of their key by `order`, a long column, when they come.

    The state of a key is one number, kept in RocksDB: whether a row is late is known without the rows before it. With
    `ttl_ms`, a key's state goes so long after its last update; a late row that comes behind that counts as new, which
    latest() on reading the log corrects. Rows without a key are one key; rows without `order` give nothing. Equal orders
    count once.
    """
    return stream.groupBy(key).transformWithStateInPandas(_Latest(order, ttl_ms), outputStructType=stream.schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def keep_latest(spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, key: str, order: str, ttl_ms: int | None = None, fmt: str = "json") -> int:
    """What has arrived in the folder `source` since the last call, through latest_updates() to `sink`, each batch once.

    `sink` is for read_committed(); its latest() rows are those of the whole input. Returns the batches run.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    with _rocksdb(spark):
        # with a time to live Spark plans batches without data for ever, so such a call is one batch
        query = once(latest_updates(stream, key, order, ttl_ms), sink, checkpoint, mode="update", trigger={"once": True} if ttl_ms else None)
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"] > 0])


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n and total of `value` of each session: events of a key at most `gap` apart; it ends a gap behind its last.

    On a stream a session comes out when the watermark, `late` behind the newest event, has passed its end; events that come
    later than that are dropped.
    """
    if events.isStreaming:
        events = events.withWatermark(at, late)
    found = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def distinct_within(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first event of each of `keys` to come; on a stream repeats are known as long as the watermark allows, so state is bounded."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    firsts = events.groupBy(*keys).agg(F.min_by(F.struct(*events.columns), at).alias("x"))
    return firsts.select("x.*")


# --- each batch once


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, sink: str) -> list[str]:
    """The batches in the ledger of a sink."""
    fs, p = _fs(spark, f"{sink}/_ledger")
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def add_batch(rows: DataFrame, sink: str, batch: str) -> bool:
    """Write rows as the batch of that name, unless the ledger has it. False if it had.

    The rows go to a folder of the batch's own, which a run that failed is overwritten in, and then the ledger gets an entry,
    in one step of the file system. Readers see what the ledger names, so a batch counts once or not at all.
    """
    spark = rows.sparkSession
    fs, entry = _fs(spark, f"{sink}/_ledger/{batch}")
    if fs.exists(entry):
        return False
    rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}")
    commit(spark, sink, batch)
    return True


def commit(spark: SparkSession, sink: str, batch: str) -> None:
    fs, entry = _fs(spark, f"{sink}/_ledger/{batch}")
    fs.mkdirs(entry.getParent())
    fs.createNewFile(entry)


def once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", then: Callable[[DataFrame, int], object] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A query that adds what has arrived to `sink`, each batch once, however often it is run again after a failure.

    A batch's name holds the id of the query, which its checkpoint keeps, so other queries may write to the same sink.
    `then(rows, number)` is called after a batch is written and before the query notes it as done.
    """

    def batch(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        add_batch(rows, sink, f"{query}-{number:012d}")
        if then:
            then(rows, number)

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_committed(spark: SparkSession, sink: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches in the ledger."""
    names = committed(spark, sink)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{sink}/batch={n}" for n in names])
