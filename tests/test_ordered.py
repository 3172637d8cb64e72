"""Positions, recurrences and latches against plain versions."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.functions import strings
from sparkweave.operators import recurrence
from sparkweave.operators.position import with_position
from sparkweave.operators.recurrence import exponential_smoothing, linear_recurrence
from sparkweave.streaming import latch

R = np.random.default_rng(5)


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows(n, users, hot=0.7):
    out = []
    for i in range(n):
        user = None if i % 41 == 0 else ("hot" if R.random() < hot else f"u{R.integers(users)}")
        out.append((user, int(i % 2), int(R.integers(n)), i, None if i % 17 == 0 else float(R.integers(100)), "x", 0))
    R.shuffle(out)
    return [(a, int(b), int(c), int(d), None if e is None else float(e), x, int(y)) for a, b, c, d, e, x, y in out]


SCHEMA = "user string, kind int, t long, id long, v double, position string, at long"


def _null_first(*values):
    return tuple((x is not None, x) for x in values)


@pytest.mark.parametrize("by", [[], ["user"], ["user", "kind"]])
def test_smoothing_against_a_loop(spark, partitions, by):
    rows = _rows(2000, 5)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["s"] for r in exponential_smoothing(frame, by, ["t", "id"], "v", 0.15, "s", 2.0).collect()}
    at = [SCHEMA.replace(",", "").split().index(c) // 2 for c in by]
    state = {}
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        g = tuple(r[i] for i in at)
        s = state.get(g, 2.0)
        s = s if r[4] is None else s + (r[4] - s) * 0.15
        state[g] = want[r[3]] = s
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_hot_group_lies_in_many_partitions(spark, partitions):
    frame = spark.createDataFrame(_rows(3000, 3, hot=1.0), SCHEMA)
    rows = frame.repartitionByRange("user", "t", "id").filter("user = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) > 8


def test_recurrence_with_factors_of_rows(spark, partitions):
    rows = [(1, i, float(R.choice([0.0, 0.5, 1.0, -1.0, 2.0])), float(R.integers(-3, 4))) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, i int, a double, b double")
    got = {r["i"]: r["b"] for r in linear_recurrence(frame, ["k"], ["i"], F.col("a"), F.col("b"), "b", 1.0).collect()}
    s = 1.0
    for _, i, a, b in rows:
        s = a * s + b
        assert got[i] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_scan_in_pieces():
    a, b, first = R.random(100), R.random(100), R.random(100) < 0.1
    x, y = recurrence.scan(a, b, first)
    p, q = 1.0, 0.0
    for i in range(100):
        p, q = (a[i], b[i]) if first[i] else (a[i] * p, a[i] * q + b[i])
        assert x[i] == pytest.approx(p) and y[i] == pytest.approx(q)


def test_smoothing_over_many_batches(spark, partitions):
    """Runs go on from one Arrow batch to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_smoothing_against_a_loop(spark, None, ["user"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_to_smooth(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert exponential_smoothing(frame, ["user"], ["t"], "v").collect() == []
    assert exponential_smoothing(frame, ["user"], ["t"], "v").columns == [*frame.columns, "smoothed"]
    assert with_position(frame, ["t"], by=["user"]).collect() == []


@pytest.mark.parametrize("by", [[], ["user"], ["user", "kind"]])
def test_positions_against_sorting(spark, partitions, by):
    rows = _rows(1500, 5)
    got = with_position(spark.createDataFrame(rows, SCHEMA), [F.col("t").desc(), "id"], by=by, start=10).collect()
    assert set(got[0].asDict()) == {"user", "kind", "t", "id", "v", "position", "at"}
    at = [SCHEMA.replace(",", "").split().index(c) // 2 for c in by]
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (-r[2], r[3])):
        g = tuple(r[i] for i in at)
        want[r[3]] = seen[g] = seen.get(g, 9) + 1
    assert {r["id"]: r["position"] for r in got} == want


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(2, "b", 1.0, 5, 6), (1, "a", 3.0, 7, 8)], "part int, g0 string, c0 double, `meta.k` int, a int")
    got = with_position(frame, ["meta.k"], "before", by=["part"]).orderBy("part").collect()
    assert [tuple(r) for r in got] == [(1, "a", 3.0, 7, 8, 0), (2, "b", 1.0, 5, 6, 0)]
    got = exponential_smoothing(frame, ["g0"], ["meta.k"], "c0", 0.5, "a").orderBy("part").collect()
    assert [tuple(r) for r in got] == [(1, "a", 3.0, 7, 1.5), (2, "b", 1.0, 5, 0.5)]


def test_positions_have_no_window(spark):
    plan = with_position(spark.range(100).toDF("id"), ["id"])._jdf.queryExecution().toString()
    assert "Window" not in plan


EVENTS = [(None if i % 31 == 0 else i % 7, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i, microseconds=int(R.integers(0, 999999))), i, float(R.integers(0, 100))) for i in range(400)]


def _first(least):
    best = {}
    for u, t, i, v in EVENTS:
        if v >= least and (u not in best or (t, i) < best[u]):
            best[u] = (t, i)
    return {u: (t, i) for u, (t, i) in best.items()}


def _events(spark, path, slices):
    """A file for each slice, in this order of time of change."""
    for n, part in enumerate(slices):
        spark.createDataFrame(part, "user long, t timestamp, id long, v double").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("split", ["one", "in order", "late", "very late"])
def test_latch_equals_a_batch_query(spark, tmp_path, split):
    rows = list(EVENTS)
    if split == "late":  # up to an hour, in which there are 60 events
        rows = [rows[int(i)] for i in np.argsort(np.arange(len(rows)) + R.integers(0, 55, len(rows)), kind="stable")]
    if split == "very late":
        R.shuffle(rows)
        rows = [(None if r[0] is None else int(r[0]), r[1], int(r[2]), float(r[3])) for r in rows]
    n = 1 if split == "one" else 4
    path = f"{tmp_path}/events"
    _events(spark, path, [rows[i * 400 // n : (i + 1) * 400 // n] for i in range(n)])
    stream = spark.readStream.schema("user long, t timestamp, id long, v double").option("maxFilesPerTrigger", "1").parquet(path)
    delay = "1 hour" if split != "very late" else "10 hours"
    got = latch.latched(stream, "user", "t", "id", "v", 90.0, delay, at=f"{tmp_path}/latch").collect()
    times = {r["user"]: r["id"] for r in got}
    assert len(got) == len(times)
    assert times == {u: i for u, (_, i) in _first(90.0).items()}


def test_latch_goes_on_and_gives_a_key_once(spark, tmp_path):
    path, at = f"{tmp_path}/events", f"{tmp_path}/latch"
    stream = lambda: spark.readStream.schema("user long, t timestamp, id long, v double").parquet(path)
    ids = lambda: {r["user"]: r["id"] for r in latch.latched(stream(), "user", "t", "id", "v", 90.0, "1 hour", at=at).collect()}
    _events(spark, path, [EVENTS[:100]])
    first = ids()
    out = spark.read.parquet(f"{at}/out").count()
    assert 0 < out <= len(first)
    _events(spark, path, [EVENTS[100:]])
    assert ids() == {u: i for u, (_, i) in _first(90.0).items()}
    # Keys that have crossed stay as they are; another one may still come.
    later = [(u, t + datetime.timedelta(days=1), i + 1000, 100.0) for u, t, i, _ in EVENTS[:50] if u is not None] + [(77, EVENTS[0][1] + datetime.timedelta(days=1), 2000, 95.0)]
    _events(spark, path, [later])
    assert ids() == {u: i for u, (_, i) in _first(90.0).items()} | {77: 2000}
    given = spark.read.parquet(f"{at}/out")
    assert given.count() == given.select("user").distinct().count()


GOOD = ["a@b", "user@example.com", "o'neil+x_y~{}|`^?=/*&%$#!-.@h-1.example", ".a.@x", "a..b@x.y", "a@" + "b" * 63 + ".c", "1@2.3", "A@B.C"]
BAD = ["", "a", "@", "a@", "@b", "a@b@c", "a b@c", "a@b c", "a@-b", "a@b-", "a@b..c", "a@.b", "a@b.", "a@" + "b" * 64, "é@b", "a@é", "a@b_c", "a@b\n", " a@b", "a@b ", "a,b@c", '"a"@b', "a@[1.2.3.4]", "a@b ", "(a)@b", "a\\@b"]
_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
GRAMMAR = re.compile(rf"[a-zA-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})*")


def test_emails(spark):
    cases = GOOD + BAD + ["".join(R.choice(list("ab.-@é_1"), int(n))) for n in R.integers(1, 12, 500)]
    got = {r["x"]: r["ok"] for r in spark.createDataFrame([(x,) for x in [*cases, None]], "x string").select("x", strings.is_email(F.col("x")).alias("ok")).collect()}
    assert got[None] is None
    assert all(got[x] for x in GOOD) and not any(got[x] for x in BAD)
    assert all(got[x] == bool(GRAMMAR.fullmatch(x)) for x in cases)


def test_very_long_emails(spark):
    """No pattern may run out of stack."""
    long = [("a" * 3_000_000 + "@b", True), ("a@" + "b." * 300_000 + "c", True), ("a@" + "b." * 300_000, False), ("@" * 100_000, False)]
    frame = spark.createDataFrame(long, "x string, want boolean")
    assert frame.filter(strings.is_email(F.col("x")) != F.col("want")).count() == 0
