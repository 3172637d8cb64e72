"""Queries on ordered rows: smoothing, positions, first crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.position import with_position
from sparkweave.operators.recurrence import exponential_smoothing
from sparkweave.sources.tables import stream, table
from sparkweave.streaming.latch import latched

#: Part of the way that a smoothed value goes to the next one.
WEIGHT = 0.15
#: Added before rounding, as smoothed decimals would else lie on the border of two rounded values, where the last bit decides.
OFF = 3.21987e-08
#: When the first and each further row of an order shows, in milliseconds.
FIRST_MS, STEP_MS = 80, 120
#: The value that an event has to reach, and how late events may come.
REACHED, DELAY = 120.0, "2 hours"


def event_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = exponential_smoothing(events, ["user_id"], ["ts", "event_id"], "value", WEIGHT)
    return out.select("event_id", "user_id", F.round(F.col("smoothed") + OFF, 6).alias("smoothed"))


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    out = with_position(orders, [F.col("o_orderdate").desc_nulls_last(), "o_orderkey"])
    return out.select("o_orderkey", "position", (FIRST_MS + F.col("position") * STEP_MS).alias("delay_ms"))


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = with_position(events, ["ts", "event_id"], by=["user_id"])
    return out.select("event_id", "user_id", "position", (FIRST_MS + F.col("position") * STEP_MS).alias("delay_ms"))


def event_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latched(stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", REACHED, DELAY)
    return found.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reached_at"), "event_id")


QUERIES = {
    "event_smoothing": event_smoothing,
    "order_positions": order_positions,
    "event_positions": event_positions,
    "event_latch": event_latch,
}

SQL = {
    "event_smoothing": f"""
WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT event_id, user_id, i, coalesce(value, 0) * {WEIGHT}::DOUBLE AS s FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.i, s.s + (coalesce(o.value, s.s) - s.s) * {WEIGHT}::DOUBLE FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1
)
SELECT event_id, user_id, round(s + {OFF}::DOUBLE, 6) AS smoothed FROM s
""",
    "order_positions": f"""
SELECT o_orderkey, i AS position, {FIRST_MS} + i * {STEP_MS} AS delay_ms FROM (
  SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS FIRST) - 1)::BIGINT AS i FROM orders)
""",
    "event_positions": f"""
SELECT event_id, user_id, i AS position, {FIRST_MS} + i * {STEP_MS} AS delay_ms FROM (
  SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1)::BIGINT AS i FROM events)
""",
    "event_latch": f"""
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS reached_at, event_id FROM (
  SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value >= {REACHED} AND ts IS NOT NULL AND event_id IS NOT NULL)
WHERE i = 1
""",
}
