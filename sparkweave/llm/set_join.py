"""An exact join of texts whose sets of shingles are similar, by prefixes.

A set's shingles are in one order for all sets. Of n shingles the first
n - ceil(0.8 n) + 1 are the prefix; sets that are similar enough share a shingle of their
prefixes, and the first one that they share passes the filters by length and by position.
The order is that of hashes, but for slots in which some task has seen more shingles than
is usual: these come last, so that common passages are seldom in prefixes. This sets the
order only, and no pair depends on it.

Sets that share a shingle with MANY others at most meet each of them. Where more share
one, each meets the first of them; when the pairs so far are united, those that are in
different components meet in blocks of BLOCK sets by BLOCK, in numpy, and pass a parity
filter of 256 bits (each flipped by shingles; the bits that differ are at most the
shingles that are in one set only). Before texts are read, pairs pass one of as many bits as
the smaller set has shingles, since 256 bits of long texts differ in half of them and
tell nothing. No number of sets is dropped anywhere.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .minhash import shingle_set
from .sifting import SIMILAR, apart, compare_blocks, may_be_similar, parity, sifted, wide_parity  # noqa: F401

SLOT_BITS = 20
#: A slot is common where a task has seen so many shingles in it, and four times the mean besides.
COMMON = 16
MANY = 16
BLOCK = 2048


def _common(shingle: int):
    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for x in batch.column("text").to_pylist():
                np.add.at(counts, (shingle_set(x, shingle) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        at = np.nonzero(counts >= COMMON + 4 * counts.mean())[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])

    return run


def commonness(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each slot 0, or if it is common the logarithm of how many shingles fall into it."""
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    found = texts.select("text").mapInArrow(_common(shingle), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[found["slot"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(np.float64) + 1)
    return out


def prefix_length(n: int) -> int:
    num, den = SIMILAR
    return n + 1 + (-n * num) // den


def prefix(codes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first codes of a set in the order of all sets."""
    level = common[(codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    return codes[np.lexsort((codes, level))][: prefix_length(len(codes))]


def _prefixed(shingle: int, common):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(x, shingle) for x in batch.column("text").to_pylist()]
            keys = [prefix(x, common.value).view(np.int64) for x in sets]
            bits = np.array([parity(x) for x in sets]).reshape(-1, 4)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array([len(x) for x in sets], np.int32)), *(pa.array(bits[:, k].copy()) for k in range(4)), pa.array([wide_parity(x) for x in sets], pa.binary()), lists], ["id", "n", "p0", "p1", "p2", "p3", "wide", "keys"])

    return run


def _meet(batches):
    """Of rows key, id, n, pos in order: pairs a > b of MANY rows at most of one key, and of more all rows, with the first as b where both may be similar, and with key, n and pos."""

    def out(a, b, key=None, n=None, pos=None):
        rest = [pa.nulls(len(a), kind) if x is None else pa.array(x) for x, kind in ((key, pa.int64()), (n, pa.int32()), (pos, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(a), b, *rest], ["a", "b", "key", "n", "pos"])

    held, hot = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)], None
    for batch in chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(held, ("key", "id", "n", "pos"))]
        key, ids, n, pos = held
        if not len(key):
            continue
        begin = np.nonzero(np.diff(key, prepend=key[0] - 1 if key[0] > 0 else key[0] + 1))[0]
        size = np.diff(np.append(begin, len(key)))
        first = np.repeat(begin, size)
        many = np.repeat(size > MANY, size)
        lead = [x[first] for x in (ids, n, pos)]
        if hot is not None and key[0] == hot[0]:
            own = first == 0
            many |= own
            for x, y in zip(lead, hot[1:]):
                x[own] = y
        hot = (key[-1], *(x[-1] for x in lead)) if many[-1] else None
        # The last key may go on in the next batch.
        end = len(key) if batch is None or many[-1] else begin[-1]
        light = ~many
        light[end:] = False
        a, b = [ids[:0]], [ids[:0]]
        for s in range(1, MANY):
            i = np.nonzero(light[s:] & (key[s:] == key[:-s]))[0] + s
            if not len(i):
                break
            i = i[may_be_similar(n[i].astype(np.int64), n[i - s].astype(np.int64), pos[i], pos[i - s])]
            a.append(ids[i])
            b.append(ids[i - s])
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
        if pairs.shape[1]:
            yield out(pairs[0], pa.array(pairs[1]))
        if many.any():
            m = [x[many] for x in lead]
            apart = (ids[many] == m[0]) | ~may_be_similar(n[many].astype(np.int64), m[1].astype(np.int64), pos[many], m[2])
            yield out(ids[many], pa.array(m[0], mask=apart), key[many], n[many], pos[many])
        held = [x[end:] for x in held]


def meetings(texts: DataFrame, shingle: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """texts: id, text (no empty sets, and each set once). Returns id, n and parities, and the rows of _meet()."""
    common = texts.sparkSession.sparkContext.broadcast(commonness(texts, shingle))
    kind = "id long, n int, p0 long, p1 long, p2 long, p3 long, wide binary, keys array<long>"
    sets = cut(texts.select("id", "text").mapInArrow(_prefixed(shingle, common), kind), "prefixes", made)
    postings = sets.select("id", "n", F.posexplode("keys").alias("pos", "key")).select("key", "id", "n", "pos")
    met = cut(postings.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_meet, "a long, b long, key long, n int, pos int"), "met", made)
    common.destroy()
    return sets.drop("keys"), met


def across(sets: DataFrame, met: DataFrame, roots: DataFrame, made: list[str]) -> DataFrame:
    """The pairs a > b that are left under the keys of many sets. roots: node, root."""
    rows = met.filter("key IS NOT NULL").select("key", F.col("a").alias("id"), "n", "pos").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", "pos", F.coalesce("root", "id").alias("comp"))
    rows = cut(rows, "many", made)
    mixed = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    blocks = mixed.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key").join(sets.drop("n", "wide"), "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.drop("blocks", "other").groupBy("key", "i", "j").applyInPandas(compare_blocks, "a long, b long").distinct()
