"""Operator 2, exact deduplication as a stateful stream.

A stream over the table keeps one state entry for each digest of a normalised
text, on disk (RocksDB) and without expiry: the smallest id, where that row's
content lies (file and row), and how often the digest came. Nothing is dropped on
a digest alone: every row that hits an entry is compared in full with the text at
the entry's place, and rows that differ are grouped anew by their whole text. With
a checkpoint folder of the caller's the state lasts: the next run reads only the files
that are new, and these hit the entries of all runs before; files may be added then, and where some
have changed or gone, which would leave rows of theirs in the state, that is an error. Digests that come very
often are dealt over SALTS tasks, each with the entry and its text.

Null texts count as empty. Of equal texts the row with the smallest id stays; null
ids come last, and of rows with the same id the one that lies first in the files
stays, so that exactly one row of each group is kept. An empty table gives an
empty result. Only the columns of id and text are read. Texts of any length are
compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, cut, discard, scratch, settings

#: A digest is hot from so many rows on, or from a thousandth of all.
HOT = 4096
SALTS = 64
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def _first(doc_id: Column) -> Column:
    """What orders the rows of a group: null ids last, then the place in the files."""
    return F.struct(doc_id.isNull().alias("nameless"), doc_id.alias("doc_id"), F.col("file"), F.col("row"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(table: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col(text))
    return table.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"), digest(norm).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def state_of(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None) -> DataFrame:
    """Runs the stream over the files of path, with a checkpoint over those that are new to it, and returns its state: digest, first (id and place), group_size."""
    schema = spark.read.parquet(path).schema
    at = checkpoint or scratch(spark, "dedup-state")
    # A pattern that only this path matches: as a plain path a stream takes folders alone, and the table may be one file.
    files = f"{path[:-1]}[{path[-1]}]"
    with settings(spark, STATE):
        rows = _keyed(spark.readStream.schema(schema).parquet(files), doc_id, text, digest)
        seen = rows.groupBy("digest").agg(F.min(_first(F.col("doc_id"))).alias("first"), F.count("*").alias("group_size"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(at)
        out = cut(kept.select(F.col("key.digest").alias("digest"), F.col("value.min").alias("first"), F.col("value.count").alias("group_size")), "dedup")
    if not checkpoint:
        discard(spark, [at])
    return out


def exact_duplicates(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of the Parquet table at path."""
    path = path.rstrip("/")
    state = state_of(spark, path, doc_id, text, digest, checkpoint)
    # A digest with more than a thousandth of all rows is hot, so that there are at most a thousand.
    n = state.agg(F.sum("group_size")).first()[0] or 0
    if checkpoint and n != spark.read.parquet(path).count():
        raise ValueError(f"files of {path} have changed since the runs of this checkpoint: {n} rows in its state")
    is_hot = F.col("group_size") > max(HOT, n // 1000)
    hot = F.broadcast(state.filter(is_hot).select("digest", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.hash("file", "row"), F.lit(SALTS))).otherwise(0).alias("salt")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    docs = _keyed(spark.read.parquet(path), doc_id, text, digest)
    docs = docs.join(hot, "digest", "left").select(*docs.columns, salt)
    entries = state.withColumn("salt", F.explode(salts))
    is_first = F.col("first") == _first(F.col("doc_id"))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    found = docs.select("doc_id", "file", "row", "digest", "salt", sha.alias("sha")).join(entries, ["digest", "salt"])
    shared = cut(docs.join(entries.filter("group_size > 1"), ["digest", "salt"]).withColumn("is_first", is_first), "hits")
    held = shared.filter("is_first").select("digest", F.col("norm").alias("held"), F.explode(salts).alias("salt"))
    hits = shared.filter("NOT is_first").join(held, ["digest", "salt"])
    other = cut(hits.filter("norm <> held").select("digest").distinct(), "other")
    result = lambda df, sha: df.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", is_first.alias("kept"), sha.alias("text_sha256"))
    if other.isEmpty():
        return result(found, F.col("sha"))
    mixed = shared.join(other, "digest", "left_semi").drop("first", "group_size", "is_first")
    groups = mixed.groupBy("digest", "norm").agg(F.min(_first(F.col("doc_id"))).alias("first"), F.count("*").alias("group_size"))
    return result(found.join(other, "digest", "left_anti"), F.col("sha")).unionByName(result(mixed.join(groups, ["digest", "norm"]), sha256(F.col("norm"))))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g') AS t, row_number() OVER () AS k FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, k) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
