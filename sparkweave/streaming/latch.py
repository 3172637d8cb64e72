"""A latch on streams: for each key one row, at its first crossing of a threshold.

First is meant by event time, then by ident, and not by arrival. A crossing is kept in state until the
watermark has passed it, so that a late row may still come before it; then it
is given out, and the key's state closes for good. However a table is cut into batches,
the result is the same, as long as no row comes later than `delay`; rows later than
that are dropped by Spark. Keys that never cross have no state.

When a stream ends, crossings that the watermark has not reached are still in state;
pending() reads them from the checkpoint, and latched() gives both.

Null times, idents and values never cross; null keys are a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from sparkweave.sources.shared import scratch, settings

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FirstCrossing(StatefulProcessor):
    """Of rows key, at (microseconds), ident the first of each key, once the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.found = handle.getValueState("found", "at long, ident long, done boolean")

    @staticmethod
    def timer(at: int) -> int:
        # Watermarks are whole milliseconds; rows of the same one may be earlier than `at`.
        return at // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(min(zip(pdf["at"].tolist(), pdf["ident"].tolist())) for pdf in rows if len(pdf))
        before = self.found.get() if self.found.exists() else None
        if before is None or not before[2] and first < (before[0], before[1]):
            if before is not None and self.timer(before[0]) != self.timer(first[0]):
                self.handle.deleteTimer(self.timer(before[0]))
            self.found.update((*first, False))
            self.handle.registerTimer(self.timer(first[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, ident, done = self.found.get()
        if not done:
            self.found.update((at, ident, True))
            yield pd.DataFrame({"key": [key[0]], "at": [at], "ident": [ident]})

    def close(self) -> None:
        pass


def first_crossings(stream: DataFrame, key: str, time: str, ident: str, value: str, least: float, delay: str = "1 hour") -> DataFrame:
    """Of a stream the first row of each key with value >= least: key, time, ident."""
    kind = stream.schema[key].dataType
    rows = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    # Only crossings reach the state; the watermark has seen all rows.
    crossed = rows.filter((F.col(value) >= F.lit(least)) & F.col("_time").isNotNull() & F.col(ident).isNotNull())
    crossed = crossed.select("_time", F.col(key).alias("key"), F.unix_micros("_time").alias("at"), F.col(ident).cast("long").alias("ident"))
    schema = StructType([StructField("key", kind), *StructType.fromDDL("at long, ident long").fields])
    out = crossed.groupBy("key").transformWithStateInPandas(FirstCrossing(), schema, "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time), F.col("ident").alias(ident))


def pending(spark: SparkSession, checkpoint: str, key: str, time: str, ident: str) -> DataFrame:
    """The crossings that a stopped stream has in state and has not given out."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "found").load()
    return state.filter("NOT value.done").select(F.col("key.key").alias(key), F.timestamp_micros("value.at").alias(time), F.col("value.ident").alias(ident))


def latched(stream: DataFrame, key: str, time: str, ident: str, value: str, least: float, delay: str = "1 hour", at: str | None = None) -> DataFrame:
    """Runs a stream over all that its source has now, and returns the first crossings so far. `at`: a folder of an earlier run, to go on from there; else a new one in the shared folder."""
    spark = stream.sparkSession
    at = at or scratch(spark, "latch")
    with settings(spark, ROCKSDB):
        out = first_crossings(stream, key, time, ident, value, least, delay)
        out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        done = spark.read.schema(out.schema).parquet(f"{at}/out")
        return done.unionByName(pending(spark, f"{at}/state", key, time, ident))
