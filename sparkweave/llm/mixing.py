"""Operator 6, mixing sources to target weights.

The words of each source, its documents in a pseudorandom order, are cut into
blocks of BLOCK_WORDS. Each output shard has SHARD_SLOTS slots and draws how many
go to each source: the whole part of what is expected, and multinomial draws for
the rest, as plain multinomial draws would leave small sources far from their
targets. A source whose target is all it may give is taken CAP times and not drawn;
slots drawn beyond what a source may give are drawn again for the others. Slot j of
a source takes the block at j's place in a pseudorandom permutation of the source's
blocks; a new permutation begins when all blocks are taken. Blocks and slots meet by
a join on source and block number.

Draws are made for GROUPS groups of sources, by a hash, however many sources there are, and a
group's slots are dealt to its sources in proportion; with few sources nearly each is a group of
its own. The sources' weights come from their positions in order, and the level to which
targets are filled from a search over sums by ranges, so that no task sees all sources.

Null texts and texts without words have size 0 and are never taken. Null is a
source of its own, the last. Ties in the order are broken by id, size and a hash of
the text, so that only rows equal in all can change places. Repeated rows count each
for itself, an empty table gives an empty result. Texts of any length are cut into
blocks like others. Input columns of any name are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.position import with_position
from .common import cut, read_table, words

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 1024
#: Shards that one task draws for.
TASK_SHARDS = 32
#: Documents of a source that are ordered in one task, about.
BUCKET_ROWS = 4096
#: Slots that one row of ranges stands for.
RANGE_SLOTS = 1 << 16
#: Groups of sources that draws are made for, and ranges of a pass of the search for the level.
GROUPS, LEVELS = 4096, 1024
SEED = 20240501


def size_of(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(words(text))).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def water_level(parts: DataFrame, total: int) -> float:
    """parts: most, weight. The level at which the sum of least(most, level * weight) is total, 0 if there is none.

    Each pass sums up LEVELS ranges of most / weight and goes on in the one that holds the level.
    """
    ratio = F.col("most") / F.col("weight")
    low, high = None, parts.agg(F.max(ratio)).first()[0]
    below, weights = 0, parts.agg(F.sum("weight")).first()[0] or 0
    while weights and total:
        left = parts.filter(ratio <= high) if low is None else parts.filter((ratio > low) & (ratio <= high))
        place = F.least(F.lit(LEVELS - 1), F.floor((ratio - (low or 0.0)) / ((high - (low or 0.0)) or 1.0) * LEVELS))
        ranges = left.groupBy(place.alias("at")).agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"), F.min(ratio).alias("first"), F.max(ratio).alias("last")).orderBy("at").collect()
        for r in ranges:
            level = (total - below) / weights
            if level <= r["first"] or r["first"] == r["last"] and below + r["most"] + r["last"] * (weights - r["weight"]) >= total:
                return level
            if below + r["most"] + r["last"] * (weights - r["weight"]) >= total:
                high = r["last"]
                break
            below, weights, low = below + r["most"], weights - r["weight"], r["last"]
        else:
            # All are full but for what rounding leaves.
            return high
    return 0.0


def source_table(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """skey, source_size, target and blocks of each source; sized has source, skey and size."""
    sums = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ranked = with_position(sums, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    out = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    level = water_level(out, out.agg(F.sum("source_size")).first()[0] or 0)
    out = out.withColumn("target", F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight")))
    return out.select("skey", "source_size", "target", F.ceil(F.col("source_size") / BLOCK_WORDS).alias("blocks"))


def placed(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs, with skey, size and _th (a hash of the text), get `at`: where their words begin in those of the source.

    The documents of a source are spread over buckets by a hash, so that no source
    has to be summed up in one task; the buckets' sums are added up first.
    """
    n = docs.count()
    order = F.xxhash64(F.lit(SEED), F.col(doc_id), F.col("size"), F.col("_th"))
    docs = docs.withColumn("_order", order).withColumn("_bucket", F.pmod(F.col("_order"), F.lit(64 + n // BUCKET_ROWS)))
    sums = docs.groupBy("skey", "_bucket").agg(F.sum("size").alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy("skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = Window.partitionBy("skey", "_bucket").orderBy("_order", doc_id, "size", "_th").rowsBetween(Window.unboundedPreceding, -1)
    out = docs.join(base, ["skey", "_bucket"]).withColumn("at", F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return out.drop("_order", "_bucket", "_base", "_th")


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function of x under key."""
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) puts each index: a Feistel network over enough bits, repeated while outside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            left, right = right, left ^ (_mixed(right, (key * 4 + r) & ((1 << 64) - 1)) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _draw(rates: np.ndarray, slots: int):
    """How many slots go to each source, by its number, each shard drawn for itself."""

    def run(batches):
        for pdf in batches:
            total = np.zeros(len(rates), np.int64)
            for shard in pdf["id"]:
                expected = rates * min(SHARD_SLOTS, slots - shard * SHARD_SLOTS)
                n = np.floor(expected)
                rest = expected - n
                draws = int(round(rest.sum()))
                if draws:
                    n += np.random.default_rng([SEED, int(shard)]).multinomial(draws, rest / rest.sum())
                total += n.astype(np.int64)
            at = np.nonzero(total)[0]
            yield pd.DataFrame({"g": at, "n": total[at]})

    return run


def _block(skey: pd.Series, epoch: pd.Series, index: pd.Series, n: pd.Series) -> pd.Series:
    out = np.zeros(len(index), np.int64)
    for (k, e), rows in pd.DataFrame({"k": skey, "e": epoch}).groupby(["k", "e"]).indices.items():
        out[rows] = permuted(index.to_numpy()[rows], int(n.iloc[rows[0]]), hash_of(k) + int(e))
    return pd.Series(out)


def hash_of(key: str) -> int:
    """A number from a source's key, the same in every process."""
    out = SEED
    for b in key.encode():
        out = (out * 1099511628211 ^ b) & ((1 << 60) - 1)
    return out << 2


def draw_slots(spark: SparkSession, wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many slots each source gets, near wanted and at most room; drawn in Spark, shard by shard."""
    counts = np.where(wanted >= room - 1e-6, room, 0)
    free = counts == 0
    slots = int(round(wanted[free].sum()))
    if not slots:
        return counts
    shards = -(-slots // SHARD_SLOTS)
    rates = np.where(free, wanted, 0) / wanted[free].sum()
    for r in spark.range(0, shards, 1, -(-shards // TASK_SHARDS)).mapInPandas(_draw(rates, slots), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        counts[r["g"]] += r["n"]
    again = np.random.default_rng([SEED, shards])
    while (over := int(np.maximum(counts - room, 0).sum())) and (counts < room).any():
        counts = np.minimum(counts, room)
        chance = np.where(counts < room, wanted, 0)
        counts += again.multinomial(over, chance / chance.sum())
    return np.minimum(counts, room)


def taken_blocks(spark: SparkSession, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """skey, block, times (1 to cap) of all blocks that the mix takes."""
    room = cap * F.col("blocks")
    own = sources.filter("target > 0").select("skey", "blocks", (F.col("target") / F.col("source_size") * F.col("blocks")).alias("wanted"), room.alias("room"), F.pmod(F.xxhash64("skey"), F.lit(GROUPS)).alias("g"))
    # Sources that give all that they may are not drawn for.
    whole = F.col("wanted") >= F.col("room") - 1e-6
    free = own.filter(~whole)
    known = free.groupBy("g").agg(F.sum("wanted").alias("wanted"), F.sum("room").alias("room")).orderBy("g").toPandas()
    known["n"] = draw_slots(spark, known["wanted"].to_numpy(float), known["room"].to_numpy(np.int64)) if len(known) else 0
    drawn = spark.createDataFrame([(int(r.g), float(r.wanted), int(r.n)) for r in known.itertuples()], "g long, of double, n long")
    members = Window.partitionBy("g").orderBy("skey")
    shared = free.join(F.broadcast(drawn), "g").withColumn("upto", F.least(F.lit(1.0), F.sum("wanted").over(members) / F.col("of")))
    last = F.col("skey") == F.max("skey").over(Window.partitionBy("g"))
    end = F.when(last, F.col("n")).otherwise(F.floor(F.col("upto") * F.col("n")))
    dealt = shared.withColumn("end", end).select("skey", "blocks", F.least("room", F.col("end") - F.coalesce(F.lag("end").over(members), F.lit(0))).alias("n"))
    dealt = dealt.unionByName(own.filter(whole).select("skey", "blocks", F.col("room").alias("n"))).filter("n > 0")
    ranges = dealt.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE_SLOTS).cast("long"))))
    # A source's slots are spread over tasks, however many it has.
    spread = ranges.repartition("skey", "from")
    slot = spread.select("skey", "blocks", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + RANGE_SLOTS) - 1)).alias("slot"))
    epoch, index = F.floor(F.col("slot") / F.col("blocks")), F.col("slot") % F.col("blocks")
    chosen = slot.select("skey", F.pandas_udf(_block, "long")("skey", epoch, index, "blocks").alias("block"))
    return chosen.groupBy("skey", "block").agg(F.count("*").alias("times"))


def pieces(placed_docs: DataFrame, times: DataFrame) -> DataFrame:
    """A row for each document and block of it: skey, at, begin (in words of the document), n, times."""
    first, last = F.floor(F.col("at") / BLOCK_WORDS), F.floor((F.col("at") + F.col("size") - 1) / BLOCK_WORDS)
    parts = placed_docs.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * BLOCK_WORDS, F.col("at"))
    end = F.least((F.col("block") + 1) * BLOCK_WORDS, F.col("at") + F.col("size"))
    return parts.join(times, ["skey", "block"]).select("skey", "at", (begin - F.col("at")).alias("begin"), (end - begin).alias("n"), "times")


def prepare(docs: DataFrame, text: str, doc_id: str, source: str, keep: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with skey, source, size and at; the sources; the blocks taken."""
    sized = docs.select(*keep, F.col(source).alias("source"), _key(F.col(source)).alias("skey"), size_of(F.col(text)).alias("size"), F.xxhash64(text).alias("_th"))
    at = cut(placed(sized, doc_id), "placed")
    sources = cut(source_table(at.select("source", "skey", "size")), "sources")
    return at, sources, cut(taken_blocks(docs.sparkSession, sources), "taken")


def mix_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    at, sources, times = prepare(docs, text, doc_id, source, [F.col(doc_id).alias("doc_id")])
    taken = pieces(at.select("skey", "at", "size"), times).groupBy("skey", "at").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    # Documents without words share their place with the next one; its words are not theirs.
    full = at.withColumn("_at", F.when(F.col("size") > 0, F.col("at")))
    out = full.join(taken.withColumnRenamed("at", "_at"), ["skey", "_at"], "left").join(sources, "skey")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _texts(text: pd.Series, size: pd.Series, parts: pd.Series) -> pd.Series:
    """The words taken once at least, twice at least, and so on; a text taken whole stays as it is."""

    def of(t, n, found):
        found = sorted((p["begin"], p["n"], p["times"]) for p in found)
        own = None
        out = []
        for k in range(1, max(p[2] for p in found) + 1):
            spans = [(b, m) for b, m, times in found if times >= k]
            if sum(m for _, m in spans) == n:
                out.append(t)
            else:
                own = own or t.encode("utf-8", "surrogatepass").split()
                out.append(b" ".join(w for b, m in spans for w in own[b : b + m]).decode("utf-8", "surrogatepass"))
        return out

    return pd.Series([of(*x) for x in zip(text, size, parts)])


def mix_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix as documents with all their columns: a row holds the words taken from one document, and further rows what is taken again."""
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    at, _, times = prepare(named, own[text], own[doc_id], own[source], [F.col(x) for x in own.values()])
    found = pieces(at.select("skey", "at", "size"), times).groupBy("skey", "at").agg(F.collect_list(F.struct("begin", "n", "times")).alias("parts"))
    made = at.filter("size > 0").join(found, ["skey", "at"]).withColumn(own[text], F.explode(F.pandas_udf(_texts, "array<string>")(F.col(own[text]), F.col("size"), F.col("parts"))))
    return made.select(*(F.col(x).alias(c) for c, x in own.items()))
