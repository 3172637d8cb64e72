"""Operator 11, ranked lexical search over document-sharded postings.

The index is a table of shards, a row each. A shard holds a batch of documents and,
for every term, the documents with it and the term's impact there, as one compressed
sparse row matrix (term, begin of its postings, documents, impacts). An impact is the
integer part of a score that depends on the document, without the term's weight; it is worked
out once, from the statistics of the whole table. A search goes term at a time:
the postings of each of an item's terms are added, with the term's weight, into
a dense accumulator of the shard. The largest scores are taken by partition, and of
those equal to the last one the smallest ids. Every task keeps the best of its
shards, and these meet in one window by item.

Items come in blocks of BLOCK; the postings of a block's index are of its terms
only, in all documents (build_index without `wanted` gives all terms). Only a block's items,
their terms and weights are broadcast.

Null texts have no terms; items without terms give no rows. Documents without an id
come after all others with the same score. Rows that repeat an id are ranked each, as
are items. Of documents only id and text are read, and of items too. An empty
table on either side gives an empty result. Texts of any length are worked on whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, read_table, term_table, terms

TABLE = term_table(digits=True)
TOP = 10
BLOCK = 1000
#: Part of a document's length in its weight, in percent, and the other constants of a score.
LENGTH, UNIT, RISE = 75, 1000, 8
SCALE = 1_000_000_000

SHARD = "ids binary, named binary, lengths binary, terms binary, begins binary, docs binary, counts binary, n_docs long, n_terms long"


def _shards(wanted):
    """A shard of each batch of columns doc, named, text; its documents are in order of id, those that are not named last."""

    def run(batches):
        only = wanted.value if wanted else None
        for pdf in batches:
            pdf = pdf.sort_values(["named", "doc"], ascending=[False, True], kind="stable")
            lengths, found = np.zeros(len(pdf), np.int64), []
            for i, text in enumerate(pdf["text"]):
                own = terms(text, TABLE)
                lengths[i] = len(own)
                tf = Counter(own if only is None else filter(only.__contains__, own))
                found += [(t, i, c) for t, c in tf.items()]
            found.sort()
            names = sorted({x[0] for x in found})
            place = {t: k for k, t in enumerate(names)}
            row = np.fromiter((place[x[0]] for x in found), np.int64, len(found))
            yield pd.DataFrame([{
                "ids": pdf["doc"].to_numpy(np.int64).tobytes(),
                "named": pdf["named"].to_numpy(bool).tobytes(),
                "lengths": lengths.tobytes(),
                "terms": b" ".join(names),
                "begins": np.searchsorted(row, np.arange(len(names) + 1)).astype(np.int64).tobytes(),
                "docs": np.fromiter((x[1] for x in found), np.int32, len(found)).tobytes(),
                "counts": np.fromiter((x[2] for x in found), np.int64, len(found)).tobytes(),
                "n_docs": int((lengths > 0).sum()),
                "n_terms": int(lengths.sum()),
            }])

    return run


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """counts: of a term in documents of these lengths; n_docs, n_terms: of the whole table."""
    if LENGTH * int(lengths.max(initial=0)) * n_docs >= 1 << 63:
        lengths = lengths.astype(object)
    weight = (100 - LENGTH + LENGTH * lengths * n_docs // max(1, n_terms)).astype(np.int64)
    return SCALE * counts // (UNIT * counts + RISE * weight)


def _with_impacts(n_docs: int, n_terms: int):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                counts, docs, lengths = np.frombuffer(r.counts, np.int64), np.frombuffer(r.docs, np.int32), np.frombuffer(r.lengths, np.int64)
                yield pd.DataFrame([{"ids": r.ids, "named": r.named, "terms": r.terms, "begins": r.begins, "docs": r.docs, "impacts": impacts(counts, lengths[docs], n_docs, n_terms).tobytes()}])

    return run


def _frequencies(batches):
    """term and the number of a shard's documents with it."""
    for pdf in batches:
        for r in pdf.itertuples():
            yield pd.DataFrame({"term": r.terms.split(), "df": np.diff(np.frombuffer(r.begins, np.int64))})


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", wanted: set[bytes] | None = None, made: list[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The shards, with impacts; term and df; and the number of documents with terms. `wanted`: the only terms to post."""
    spark = docs.sparkSession
    told = None if wanted is None else spark.sparkContext.broadcast(wanted)
    doc = F.col(f"`{doc_id}`").cast("long")
    own = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNotNull().alias("named"), F.col(f"`{text}`").alias("text"))
    counted: list[str] = []
    shards = cut(own.mapInPandas(_shards(told), SHARD), "counts", counted)
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = cut(shards.select("terms", "begins").mapInPandas(_frequencies, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")), "df", made)
    index = cut(shards.drop("n_docs", "n_terms").mapInPandas(_with_impacts(n_docs, n_terms), "ids binary, named binary, terms binary, begins binary, docs binary, impacts binary"), "index", made)
    discard(spark, counted)
    return index, df, n_docs


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores above 0; of equal ones the first places."""
    last = 1
    if len(scores) > k:
        last = max(1, int(scores[np.argpartition(scores, -k)[-k]]))
    above = np.nonzero(scores > last)[0]
    return np.concatenate((above, np.nonzero(scores == last)[0][: k - len(above)]))


def _search(told, k: int):
    """item, doc_id, score: the best k of all shards of a task for each item."""

    def run(batches):
        items, weights = told.value
        tops: dict[int, tuple[np.ndarray, ...]] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                place = {t: i for i, t in enumerate(r.terms.split())}
                ids, named = np.frombuffer(r.ids, np.int64), np.frombuffer(r.named, bool)
                begins, docs, impact = np.frombuffer(r.begins, np.int64), np.frombuffer(r.docs, np.int32), np.frombuffer(r.impacts, np.int64)
                for number, (_, asked) in enumerate(items):
                    scores = np.zeros(len(ids), np.int64)
                    for t, times in asked.items():
                        if (i := place.get(t)) is not None:
                            at = slice(begins[i], begins[i + 1])
                            scores[docs[at]] += times * weights[t] * impact[at]
                    found = best(scores, k)
                    if len(found):
                        own = (scores[found], ~named[found], ids[found])
                        if number in tops:
                            own = tuple(np.concatenate(x) for x in zip(tops[number], own))
                        order = np.lexsort((own[2], own[1], -own[0]))[:k]
                        tops[number] = tuple(x[order] for x in own)
        for number, (score, nameless, ids) in tops.items():
            doc = pd.array(ids, dtype="Int64")
            doc[nameless] = pd.NA
            yield pd.DataFrame({"item": number, "item_id": pd.array([items[number][0]] * len(ids), dtype="Int64"), "doc_id": doc, "score": score})

    return run


def weight(n_docs: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))


def search(index: DataFrame, df: DataFrame, n_docs: int, items: list[tuple[int | None, Counter]], k: int = TOP) -> DataFrame:
    """items: id and counted terms. Returns item (its number), item_id, rank, doc_id, score."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(bytearray(t),) for t in sorted(set().union(*(x[1] for x in items)))], "term binary")
    weights = {bytes(r["term"]): weight(n_docs, r["df"]) for r in df.join(asked, "term", "left_semi").collect()}
    told = spark.sparkContext.broadcast((items, weights))
    found = index.mapInPandas(_search(told, k), "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int | None, Counter]]]:
    rows = items.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`")).toLocalIterator()
    counted = ((r[0], Counter(terms(r[1], TABLE))) for r in rows)
    while block := list(islice(counted, BLOCK)):
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, item_text, item_id):
        made: list[str] = []
        index, df, n_docs = build_index(docs, text, doc_id, set().union(*(x[1] for x in block)), made)
        found = cut(search(index, df, n_docs, block, k).drop("item"), "ranked")
        discard(spark, made)
        out = out.unionByName(found)
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH places AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS.format("text")} AS t FROM documents),
full_ones AS (SELECT d, doc_id, t, len(t)::BIGINT AS n FROM places WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM full_ones),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS term FROM full_ones) GROUP BY d, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (
  SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS.format("text")} AS t FROM benchmark)) GROUP BY i, item_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
scored AS (
  SELECT i, item_id, doc_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN full_ones USING (d), whole GROUP BY i, item_id, doc_id, d),
ranked AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
