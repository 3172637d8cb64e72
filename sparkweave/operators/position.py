"""Dense positions of rows in an order, over the whole table or in groups.

Rows are dealt by ranges of the order and numbered in each partition; what comes
before a partition is known from the partitions' sizes, one number each, which is all
that the driver sees. No window and no task has to hold more than one range of
rows, however few groups there are. Positions in a group are counted from the
group's first row.

Nulls come first in an ascending order, and null groups are groups. Rows that are equal
in the whole order get positions in no certain order among them. An empty table
stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.sources.shared import cut, discard

#: monotonically_increasing_id() counts rows in the lower bits and partitions above.
_BITS = 33


def with_position(df: DataFrame, order: list[Column | str], name: str = "position", by: list[str] | tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """df with the position of each row, from `start`, in the order `order` of the table, or of its group of `by`. A column of that name is replaced."""
    spark, made = df.sparkSession, []
    kept = [c for c in df.columns if c.lower() != name.lower()]
    keys = [F.col(f"`{c}`") for c in by]
    order = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    # The order is worked out before columns get names of our own.
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    ordered = cut(rows.select(*own, *(k.alias(f"g{i}") for i, k in enumerate(keys)), F.monotonically_increasing_id().alias("at")), "ordered")
    part = F.shiftrightunsigned("at", _BITS)
    before, offsets = start, []
    for p, n in sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, before))
        before += n
    offsets = spark.createDataFrame(offsets, "part long, before long")
    placed = ordered.join(offsets, part == F.col("part")).withColumn("at", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1)))
    if by:
        placed = cut(placed, "placed", made)
        groups = [f"g{i}" for i in range(len(by))]
        firsts = placed.groupBy(*groups).agg(F.min("at").alias("first")).toDF(*(f"of_{g}" for g in groups), "first")
        same = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups))
        placed = cut(placed.join(firsts, same).withColumn("at", F.col("at") - F.col("first") + start), "positions")
        discard(spark, made)
    return placed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("at").alias(name))
