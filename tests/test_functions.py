import calendar
import datetime

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import dates, strings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


DAYS = ["2023-12-31", "2024-02-29", "2023-02-28", "2025-01-01", "2024-11-15"]


@pytest.mark.parametrize("day", DAYS)
def test_dates(spark, day):
    d = datetime.date.fromisoformat(day)
    last = calendar.monthrange(d.year, d.month)[1]
    col = F.lit(d)
    assert one(spark, dates.days_in_month(col)) == last
    assert one(spark, dates.days_left_in_month(col)) == last - d.day
    assert one(spark, dates.month_index(col)) == d.month - 1
    assert one(spark, dates.months_since(col, 2024)) == max(1, min(12, (d.year - 2024) * 12 + d.month))


def test_null_dates(spark):
    col = F.lit(None).cast("date")
    assert one(spark, dates.months_since(col, 2024)) is None
    assert one(spark, dates.days_left_in_month(col)) is None


def test_pad_keeps_long_strings(spark):
    assert one(spark, strings.number_label(F.lit(7))) == "07"
    assert one(spark, strings.number_label(F.lit(123))) == "123"
    assert one(spark, strings.pad_start(F.lit(None).cast("string"), 2)) is None


def test_trim_unicode(spark):
    spaces = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    assert len(spaces) == 25
    for c in spaces:
        assert one(spark, strings.trim_unicode(F.lit(f"{chr(c)}a b{chr(c)}{chr(c)}"))) == "a b"
    for c in (0x200B, 0x85, 0x180E):
        assert one(spark, strings.trim_unicode(F.lit(f"{chr(c)}a"))) == f"{chr(c)}a"


def test_json_keeps_nulls(spark):
    assert one(spark, strings.json_object(email=F.lit('a"b'))) == '{"email":"a\\"b"}'
    assert one(spark, strings.json_object(email=F.lit(None).cast("string"))) == '{"email":null}'
