"""Calendar, label and payload queries: projections that need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import dates, strings
from sparkweave.sources.tables import table

#: The orders begin in this year; with a later one all counts would be held at 1.
FIRST_YEAR = 1995


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(day).cast("long").alias("year"),
        dates.month_index(day).cast("long").alias("month_index"),
        dates.days_in_month(day).cast("long").alias("days_in_month"),
        dates.days_left_in_month(day).cast("long").alias("days_left"),
        dates.months_since(day, FIRST_YEAR).cast("long").alias("months_since"),
    )


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    label = strings.number_label(dates.months_since(day, FIRST_YEAR))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        strings.number_label(dates.days_left_in_month(day)).alias("days_label"),
        F.concat(F.lit("Month "), label, F.lit(" — ongoing")).alias("month_label"),
        strings.number_label(F.col("o_orderkey"), 4).alias("key_label"),
    )


def _padded(name: str):
    """The column with white space around it, of a kind that plain trim() would leave."""
    return F.concat(F.lit("\u00a0 \t\ufeff"), F.col(name), F.lit("\u2028 \n\u3000"))


def customer_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 10 == 0, F.lit("　 \t")).otherwise(_padded("c_name"))
    out = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return out.filter(~strings.is_blank(F.col("raw"))).select("c_custkey", strings.trim_unicode(F.col("raw")).alias("trimmed"))


def customer_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit('say "'), F.col("c_name"), F.lit('"'))).otherwise(_padded("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.json_object(email=strings.trim_unicode(name)).alias("payload"))


QUERIES = {
    "order_calendar": order_calendar,
    "order_labels": order_labels,
    "customer_trim": customer_trim,
    "customer_payload": customer_payload,
}

_MONTHS = f"greatest(1, least((year(d) - {FIRST_YEAR}) * 12 + month(d), 12))"
_SPACES = " || ".join(f"chr({c})" for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_PADDED = "chr(160) || ' ' || chr(9) || chr(65279) || c_name || chr(8232) || ' ' || chr(10) || chr(12288)"
_ORDERS = "(SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"

SQL = {
    "order_calendar": f"""
SELECT o_orderkey, year(d)::BIGINT AS year, (month(d) - 1)::BIGINT AS month_index, day(last_day(d))::BIGINT AS days_in_month,
  date_diff('day', d, last_day(d))::BIGINT AS days_left, {_MONTHS}::BIGINT AS months_since FROM {_ORDERS}
""",
    "order_labels": f"""
SELECT o_orderkey, lpad(date_diff('day', d, last_day(d))::VARCHAR, 2, '0') AS days_label,
  'Month ' || lpad({_MONTHS}::VARCHAR, 2, '0') || ' — ongoing' AS month_label,
  CASE WHEN length(o_orderkey::VARCHAR) >= 4 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 4, '0') END AS key_label
FROM {_ORDERS}
""",
    "customer_trim": f"""
SELECT c_custkey, trimmed FROM (
  SELECT c_custkey, trim(CASE WHEN c_custkey % 10 = 0 THEN chr(12288) || ' ' || chr(9) ELSE {_PADDED} END, {_SPACES}) AS trimmed FROM customer
) WHERE trimmed <> ''
""",
    "customer_payload": f"""
SELECT c_custkey, json_object('email', trim(CASE WHEN c_custkey % 10 = 0 THEN 'say "' || c_name || '"' ELSE {_PADDED} END, {_SPACES}))::VARCHAR AS payload FROM customer
""",
}
