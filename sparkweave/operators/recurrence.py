"""First-order linear recurrences over ordered rows, and exponential smoothing by them.

In a group's order, s = factor * (the s before) + addend. The step of a run of rows
is again such a pair (factor, addend), and joining two runs is associative, so that
runs may be worked out apart: rows are dealt by ranges of group and order, each task
scans its range, and of each partition only the pair of its last run goes to
the driver, which finds what each partition starts from. A group's rows may so lie in
many partitions, and no task ever holds a group.

Nulls: a null factor or addend leaves s as it was; null groups are groups; nulls come first in an
ascending order. Rows that are equal in the whole order are taken in no certain order.
Groups may not be floats or nested. An empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from sparkweave.sources.shared import cut


def scan(factor: np.ndarray, addend: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the pair of all rows from the last one marked `first` (or the first of all) to it, in log2(n) steps."""
    a, b, at = factor.astype(float), addend.astype(float), np.arange(len(factor))
    begin = np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at
    step = 1
    while len(i := at[at - step >= begin]):
        a[i], b[i] = a[i] * a[i - step], a[i] * b[i - step] + b[i]
        step *= 2
    return a, b


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first differs from the one before."""

    def differs(x: pa.Array) -> np.ndarray:
        one, two = x.slice(1), x.slice(0, len(x) - 1)
        known = pc.fill_null(pc.not_equal(one, two), False)
        return pc.or_(known, pc.not_equal(pc.is_null(one), pc.is_null(two))).to_numpy(zero_copy_only=False)

    return reduce(np.logical_or, map(differs, columns))


def _scanned(n_own: int, n_keys: int):
    """Columns of the input, group, factor, addend; these two become the pair of a run, and part, open (the run began with the partition), first and last (of the partition) are added."""

    def run(batches):
        part, held, seen, open_run = TaskContext.get().partitionId(), None, False, True
        before: list[pa.Array] = []
        carried = (1.0, 0.0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield _flagged(held, False)
            keys = batch.columns[n_own : n_own + n_keys]
            fresh = np.zeros(n, bool)
            if keys and n > 1:
                fresh[1:] = _changes(keys)
            if keys and seen:
                fresh[0] = _changes([pa.concat_arrays([x, y.slice(0, 1)]) for x, y in zip(before, keys)])[0]
            a, b = scan(*(batch.columns[n_own + n_keys + i].to_numpy() for i in (0, 1)), fresh)
            runs = np.cumsum(fresh)
            old = runs == 0
            a[old], b[old] = a[old] * carried[0], a[old] * carried[1] + b[old]
            still = old & open_run
            first = np.zeros(n, bool)
            first[0] = not seen
            held = (batch.columns[: n_own + n_keys], a, b, np.full(n, part, np.int32), still, first)
            carried, open_run, seen, before = (a[-1], b[-1]), bool(still[-1]), True, [x.slice(n - 1, 1) for x in keys]
        if held is not None:
            yield _flagged(held, True)

    def _flagged(held, end: bool):
        last = np.zeros(len(held[1]), bool)
        last[-1] = end
        arrays = [*held[0], *map(pa.array, (*held[1:], last))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    names = [f"c{i}" for i in range(n_own)] + [f"g{i}" for i in range(n_keys)] + ["a", "b", "part", "open", "first", "last"]
    return run


def linear_recurrence(df: DataFrame, by: list[str], order: list[Column | str], factor: Column, addend: Column, name: str, start: float = 0.0) -> DataFrame:
    """df with s = factor * (the s before, at first `start`) + addend, in the order `order` of each group of `by`. A column of that name is replaced."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() != name.lower()]
    keys = [F.col(f"`{c}`") for c in by]
    order = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    known = factor.isNotNull() & addend.isNotNull()
    pair = [F.when(known, factor).otherwise(1.0).cast("double").alias("a"), F.when(known, addend).otherwise(0.0).cast("double").alias("b")]
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*own, *(k.alias(f"g{i}") for i, k in enumerate(keys)), *pair)
    more = [("a", DoubleType()), ("b", DoubleType()), ("part", IntegerType()), ("open", BooleanType()), ("first", BooleanType()), ("last", BooleanType())]
    schema = StructType([*rows.schema.fields[: len(own) + len(keys)], *(StructField(n, t) for n, t in more)])
    scanned = cut(rows.mapInArrow(_scanned(len(own), len(keys)), schema), "scanned")

    begins, state, group = [], start, None
    ends = scanned.filter("first OR last").select("part", "first", "last", F.struct(F.lit(0).alias("_"), *(f"g{i}" for i in range(len(keys)))).alias("g"), "a", "b", "open").collect()
    for r in sorted(ends, key=lambda r: (r["part"], not r["first"])):
        if r["first"]:
            begin = state if r["g"] == group else start
            begins.append((r["part"], float(begin)))
        if r["last"]:
            state, group = r["a"] * (begin if r["open"] else start) + r["b"], r["g"]
    begins = spark.createDataFrame(begins, "_part int, _begin double")
    value = F.col("a") * F.when(F.col("open"), F.col("_begin")).otherwise(start) + F.col("b")
    return scanned.join(begins, F.col("part") == F.col("_part")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), value.alias(name))


def exponential_smoothing(df: DataFrame, by: list[str], order: list[Column | str], value: str, weight: float = 0.15, name: str = "smoothed", start: float = 0.0) -> DataFrame:
    """df with s += (value - s) * weight in the order of each group; null values leave s as it was."""
    x = F.col(f"`{value}`").cast("double")
    return linear_recurrence(df, by, order, F.when(x.isNotNull(), F.lit(1.0 - weight)), x * weight, name, start)
