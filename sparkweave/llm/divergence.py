"""Operator 12, a divergence audit of the sources of each language, by systolic rotation.

Every group, the documents of one language and source, has a vector of how often it
has each kept term of its language. Terms are dealt into slices of about SLICE terms by
a hash, so that no vector is held whole by anybody; values of slices add up. In a
slice the groups of a language form blocks. The blocks' vectors stay where they are
while compressed copies travel: the rounds of a round-robin tournament let each two
blocks meet once, at the place of the first of them, where both directions are worked out.
A last round is each block with itself. A block has LEAST groups at least, and more where a
language would otherwise have more than MOST blocks, so that there are at most as
many rounds.

The distance of terms from the language as a whole is found where the vectors are, by a
heap of each group's best terms in each slice; the heaps meet in one window by group.

Values are whole numbers of 64 bits throughout; shares of SCALE are divided in three steps, so
that they are exact up to 9e15 terms.

Null texts, languages and sources are empty ones. Groups without terms take part with
count 0. A language without kept terms gives pairs of value 0 and no terms. Rows that
repeat are counted each. Only text, lang and source are read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, read_table, term_table, terms

TABLE = term_table(digits=False)
#: A term is kept if so many documents of its language have it.
DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
SLICE = 1 << 15
LEAST, MOST = 8, 32
#: Counts that a task holds before it gives them on.
HELD = 500_000


def _counts(batches):
    """lang, source, term, n (occurrences) and df (documents), added up as far as a task has gathered them; a null term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def told():
        for (lang, source), (n, df) in groups.items():
            yield pd.DataFrame({"lang": lang, "source": source, "term": list(n), "n": list(n.values()), "df": list(map(df.__getitem__, n))})
            n.clear()
            df.clear()

    for pdf in batches:
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"]):
            own = terms(text, TABLE)
            n, df = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(own)
            df.update(set(own))
            held += len(n)
            if held > HELD:
                yield from told()
                held = 0
    yield from told()
    yield pd.DataFrame([(*g, None, 0, 0) for g in groups], columns=["lang", "source", "term", "n", "df"])


def shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + size)), exactly."""
    whole = max(1, total + size)
    out, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts at places in ascending order, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes() + counts.astype(np.int64).tobytes(), 1)


def _packed(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    return pd.DataFrame({"lang": [key[0]], "slice": [key[1]], "source": [key[2]], "vector": [pack(pdf["at"].to_numpy(), pdf["n"].to_numpy())]})


def unpack(vector: bytes, size: int) -> np.ndarray:
    """The counts at all of `size` places."""
    raw = zlib.decompress(vector)
    n = len(raw) // 12
    out = np.zeros(size, np.int64)
    out[np.cumsum(np.frombuffer(raw, np.int32, n))] = np.frombuffer(raw, np.int64, n, 4 * n)
    return out


def _best_terms(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
    """The TOP terms of a group in one slice. Rows: term, n, c (in the language), total, all_total, size."""
    r = pdf.iloc[0]
    p, q = shares(pdf["n"].to_numpy(np.int64), int(r["total"]), int(r["size"])), shares(pdf["c"].to_numpy(np.int64), int(r["all_total"]), int(r["size"]))
    value, more = distance(p, q), p > q
    found = heapq.nsmallest(TOP, ((-v, t) for v, t in zip(value[more].tolist(), map(bytes, pdf["term"][more]))))
    return pd.DataFrame({"lang": key[0], "source": key[2], "item": [t for _, t in found], "value": [-v for v, _ in found]})


def _meet(key: tuple[Any, ...], home: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
    """The values of each group at home and each guest in this slice, both ways; of a block with itself those of different groups."""
    out = []
    if len(home) and len(guests):
        known = home.iloc[0]
        size, kept = int(known["width"]), int(known["size"])

        def spread(r):
            return shares(unpack(r.vector, size), int(r.total), kept)

        mine = [(r.source, spread(r)) for r in home.itertuples()]
        for g in guests.itertuples():
            q = spread(g)
            for source, p in mine:
                if source == g.source:
                    continue
                out.append((known["lang"], source, g.source, int(distance(p, q).sum())))
                if g.block != known["block"]:
                    out.append((known["lang"], g.source, source, int(distance(q, p).sum())))
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def opponent(block, blocks, turn: int):
    """Whom a block meets in a turn, 0 to the even number of blocks without the last; a column, or a number."""
    last = blocks - 1
    if isinstance(block, int):
        other = (2 * turn - block) % last
        return turn % last if block == last else (last if other == block else other)
    other = F.pmod(F.lit(2 * turn) - block, last)
    return F.when(block == last, F.lit(turn) % last).otherwise(F.when(other == block, last).otherwise(other))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    made: list[str] = []
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"), (text, "text"))))
    found = own.mapInPandas(_counts, "lang string, source string, term binary, n long, df long")
    counts = cut(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts", made)

    named = counts.filter("term IS NOT NULL")
    kept = named.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("df").alias("df")).filter(F.col("df") >= DOCUMENTS).select("lang", "term", "c")
    kept = cut(kept, "kept", made)
    languages = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("c").alias("all_total"))
    # A term's place in its slice; slices hold about SLICE terms.
    in_slice = kept.join(languages, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.ceil(F.col("size") / SLICE)))
    order = Window.partitionBy("lang", "slice").orderBy("term")
    vocabulary = cut(in_slice.withColumn("at", F.row_number().over(order) - 1).select("lang", "term", "c", "slice", "at", "size", "all_total"), "vocabulary", made)
    widths = vocabulary.groupBy("lang", "slice").agg(F.count("*").alias("width"), F.any_value("size").alias("size"))

    held = cut(named.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "held", made)
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    number = Window.partitionBy("lang").orderBy("source")
    groups = cut(groups.withColumn("g", F.row_number().over(number) - 1).withColumn("groups", F.count("*").over(Window.partitionBy("lang"))), "groups", made)

    with_total = held.join(groups.select("lang", "source", "total"), ["lang", "source"])
    best = with_total.groupBy("lang", "slice", "source").applyInPandas(_best_terms, "lang string, source string, item binary, value long")
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= TOP)
    best = cut(best.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value", "rank"), "best_terms")

    # Each group has a vector in each slice of its language, be it empty.
    size = F.greatest(F.lit(LEAST), F.ceil(F.col("groups") / MOST))
    placed = groups.join(widths, "lang").withColumn("block", F.floor(F.col("g") / size)).withColumn("blocks", F.ceil(F.col("groups") / size))
    placed = placed.withColumn("blocks", F.col("blocks") + F.col("blocks") % 2)
    packed = held.select("lang", "slice", "source", "at", "n").groupBy("lang", "slice", "source").applyInPandas(_packed, "lang string, slice long, source string, vector binary")
    vectors = placed.join(packed, ["lang", "slice", "source"], "left").withColumn("vector", F.coalesce("vector", F.lit(zlib.compress(b"", 1))))
    vectors = cut(vectors.select("lang", "slice", "source", "total", "size", "width", "block", "blocks", "vector"), "vectors", made)

    place = [F.col(c) for c in ("lang", "slice", "at")]
    home = vectors.withColumn("at", F.col("block")).repartition(*place).persist()
    turns = vectors.agg(F.max("blocks")).first()[0] or 0
    met = []
    for turn in range(turns):
        # The last turn is that of each block with itself.
        guests = vectors.withColumn("at", F.col("block"))
        if turn < turns - 1:
            real = (F.col("blocks") - 1 > turn) & (F.col("blocks") > 1)
            guests = vectors.filter(real).withColumn("at", opponent(F.col("block"), F.col("blocks"), turn)).filter(F.col("at") < F.col("block"))
        values = home.groupBy(*place).cogroup(guests.groupBy(*place)).applyInPandas(_meet, "lang string, source string, item string, value long")
        met.append(cut(values, "met", made))
    home.unpersist()
    # Groups of a language without terms have no vectors and meet nobody.
    pairs = groups.join(languages.select("lang"), "lang", "left_anti").select("lang", "source")
    silent = pairs.join(pairs.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    for values in met:
        silent = silent.unionByName(values)
    summed = silent.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    every = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    summed = cut(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(every).alias("rank")), "pairs")
    discard(spark, made)
    return summed.unionByName(best)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = "(1 + (1000000000::HUGEINT * ({} + 1)) // ({} + v))"

SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT d, lang, source, unnest(t) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::BIGINT AS c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
sizes AS (SELECT lang, count(k.term)::BIGINT AS v, coalesce(sum(c), 0)::BIGINT AS total FROM (SELECT DISTINCT lang FROM groups) l LEFT JOIN kept k USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::BIGINT AS n, c FROM groups g JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT lang, source, term, n, {_SHARE.format("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p, {_SHARE.format("c", "total")} AS q FROM full_counts JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
