"""Queries on e-mail addresses: projections that need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import strings
from sparkweave.sources.tables import table


def _entered(key: Column) -> Column:
    """What the customer of this number might enter: addresses, some within white space, and things that are none."""
    number = key.cast("string")
    kinds = [
        F.concat(F.lit("user"), number, F.lit("@example.com")),
        F.concat(F.lit(" \t"), F.lit("user+"), number, F.lit("@host\n")),
        F.concat(F.lit("user"), number),
        F.concat(F.lit("user@"), number, F.lit("@example.com")),
        F.concat(F.lit("user@-"), number, F.lit(".example")),
        F.concat(F.lit("user@"), F.repeat(F.lit("a"), F.lit(64)), F.lit("."), number),
        F.concat(F.lit("üser"), number, F.lit("@example.com")),
        F.concat(F.lit(" o'neil."), number, F.lit("@"), F.repeat(F.lit("b"), F.lit(63)), F.lit(".Sub-1.example ")),
        F.lit(" 　"),
        F.concat(F.lit("user"), number, F.lit("@example..com")),
    ]
    out = kinds[0]
    for i, kind in enumerate(kinds[1:], 1):
        out = F.when(key % len(kinds) == i, kind).otherwise(out)
    return out


def customer_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, empty ones left out, checked, and made into a payload if good."""
    entered = _entered(F.col("c_custkey"))
    given = table(spark, sf_dir, "customer").select("c_custkey", strings.trim_unicode(entered).alias("address")).filter(F.col("address") != "")
    valid = strings.is_email(F.col("address"))
    return given.select("c_custkey", "address", valid.alias("valid"), F.when(valid, strings.json_object(email=F.col("address"))).alias("payload"))


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with an at sign in the whole texts, without punctuation at its ends, and whether it is an address."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x.contains("@"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("place", "word"))
    address = F.regexp_replace("word", r"\A[^a-zA-Z0-9]+|[^a-zA-Z0-9]+\z", "")
    return found.select("doc_id", F.col("place").cast("long").alias("place"), address.alias("address")).withColumn("valid", strings.is_email(F.col("address")))


QUERIES = {"customer_emails": customer_emails, "document_emails": document_emails}

_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_VALID = rf"regexp_full_match(address, '[a-zA-Z0-9.!#$%&''*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})*')"
_SPACES = " || ".join(f"chr({c})" for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))

SQL = {
    "customer_emails": f"""
WITH entered AS (SELECT c_custkey, CASE c_custkey % 10
  WHEN 1 THEN ' ' || chr(9) || 'user+' || c_custkey || '@host' || chr(10)
  WHEN 2 THEN 'user' || c_custkey
  WHEN 3 THEN 'user@' || c_custkey || '@example.com'
  WHEN 4 THEN 'user@-' || c_custkey || '.example'
  WHEN 5 THEN 'user@' || repeat('a', 64) || '.' || c_custkey
  WHEN 6 THEN chr(252) || 'ser' || c_custkey || '@example.com'
  WHEN 7 THEN chr(160) || 'o''neil.' || c_custkey || '@' || repeat('b', 63) || '.Sub-1.example' || chr(8232)
  WHEN 8 THEN ' ' || chr(12288)
  WHEN 9 THEN 'user' || c_custkey || '@example..com'
  ELSE 'user' || c_custkey || '@example.com' END AS e FROM customer),
given AS (SELECT c_custkey, trim(e, {_SPACES}) AS address FROM entered)
SELECT c_custkey, address, {_VALID} AS valid, CASE WHEN {_VALID} THEN json_object('email', address)::VARCHAR END AS payload FROM given WHERE address <> ''
""",
    "document_emails": rf"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: contains(x, '@')) AS w FROM documents),
found AS (SELECT doc_id, unnest(range(len(w))) AS place, unnest(w) AS word FROM words),
given AS (SELECT doc_id, place::BIGINT AS place, regexp_replace(word, '\A[^a-zA-Z0-9]+|[^a-zA-Z0-9]+\z', '', 'g') AS address FROM found)
SELECT doc_id, place, address, {_VALID} AS valid FROM given
""",
}
