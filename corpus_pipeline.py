"""The corpus pipeline: documents in, tokens out.

1. Language identification: documents without a known language go.
2. Line deduplication: lines similar to an earlier line go, and documents of which nothing is left.
3. SimHash near-duplicates: of each group of documents with a similarity of 0.8 or more, in sets of five words, the one with the smallest id stays; fingerprints find candidates, and an exact join the rest.
4. Mixing: documents as the mix takes them, some in part, some more than once.
5. BPE: the tokens of each document of the mix, and the text decoded from them.

Null, empty and letterless texts have no language and go in the first stage. Texts of
any length are worked on whole. Null ids come last wherever ids give an order; of
rows equal in id and text one stays at the third stage. All stages but the last
return the columns of their input, whatever further ones there are, with n_chars
brought up to date. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import bpe, langid, line_dedup, mixing, simhash
from sparkweave.llm.common import cut

#: Words of a shingle of near-duplicates.
SHINGLE = 5
#: A language is known if its share of the probability is this or more.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train_packed(docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~langid.held_out()))
    # Columns of the input named like those added are put aside meanwhile.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    found = langid.identify(named, model, text=own["text"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*(F.col(x).alias(c) for c, x in own.items()))


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    found = line_dedup.dedup_lines(named, own["text"], own["doc_id"]).filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _counted(found.select(*(F.col(x).alias(c) for c, x in own.items())), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_similar(docs, shingle=SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix_documents(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, bpe.vocabulary(), keys=("doc_id", "lang", "source"), want="ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the stages with trained or pseudorandom parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
