"""Operator 1, quality rules: a threshold table compiled into one projection.

Null, empty and white-space texts have no words and fail. Rows are judged one by
one, so ties, repeated rows and repeated ids give one result row each, and an
empty table gives an empty result. Further columns of the input are not touched;
an input column of the same name as a result column is replaced. Very long texts are
measured whole, in time in proportion to their length but for the sorting of their
windows' hashes.

Stop words are those of four languages below, in small letters, capitalised or in capitals.
Their ratio is taken of the words with a letter from A to Z, so that texts in other scripts
do not fail by it; texts of a fifth language in Latin letters may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WS, WS, read_table, unused, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
_SMALL = (
    "the of and to in is that it for was on are with as be by this an or from at have not "
    "der die das und ist den von zu mit sich des auf ein nicht dem im für als auch es "
    "le la les de et un une des du en que qui dans est pour par sur au plus avec "
    "el los las y que del se por con una su para no lo como al"
).split()
STOP_WORDS = [*_SMALL, *(w.capitalize() for w in _SMALL), *(w.upper() for w in _SMALL)]
LATIN = "[A-Za-z]"


@dataclass(frozen=True)
class Rule:
    """low * per <= 100 * value and 100 * value <= high * per; whole numbers, so that every engine decides alike."""

    name: str
    value: str
    per: str
    low: int | None = None
    high: int | None = None


#: The production thresholds, in hundredths of the column in `per`.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 30),
    Rule("stop_word_ratio", "n_stop_words", "n_latin_words", 1, None),
    Rule("repeated_line_ratio", "n_dup_lines", "n_lines", None, 50),
)


def _count(text: Column, found: str) -> Column:
    """How many characters of text are among those of found, all in ASCII."""
    gone = text
    for c in found:
        gone = F.replace(gone, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(gone)).cast("long")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_latin_words (with a letter from A to Z) and n_stop_words.

    The windows of a text are hashed, and the hashes sorted with their places in
    the low bits of the same numbers. Windows beside an equal hash are candidates;
    only these are compared as strings, so that n_repeat_words is exact.
    """
    w, n, h, c, s, p, ls = unused(docs, "_w", "_n", "_h", "_c", "_s", "_p", "_l")
    low = (1 << 30) - 1
    high = lambda x: x.bitwiseAND(F.lit(~low))
    raw = F.coalesce(F.col(text), F.lit(""))
    at = F.sequence(F.lit(0), F.col(n) - WINDOW)
    out = docs.withColumn(w, words(raw)).withColumn(n, F.size(w))
    hashed = F.transform(at, lambda i: high(F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))).bitwiseOR(i.cast("long")))
    out = out.withColumn(h, F.when(F.col(n) >= WINDOW, F.sort_array(hashed)).otherwise(F.array().cast("array<bigint>")))
    beside = lambda a, f: lambda x, i: (f(F.get(a, i - 1)) == f(x)) | (f(F.get(a, i + 1)) == f(x))
    out = out.withColumn(c, F.filter(h, beside(h, high)))
    window = lambda x: F.concat_ws(" ", F.slice(w, x.bitwiseAND(F.lit(low)).cast("int") + 1, WINDOW))
    out = out.withColumn(s, F.sort_array(F.transform(c, lambda x: F.struct(window(x).alias("w"), x.bitwiseAND(F.lit(low)).alias("i")))))
    same = F.filter(s, beside(s, lambda x: x["w"]))
    out = out.withColumn(p, F.sort_array(F.transform(same, lambda x: x["i"])))
    step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW).cast("long"))))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(NOT_WS))
    out = out.withColumn(ls, lines)
    return out.withColumns(
        {
            "n_words": F.col(n).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": _count(raw, SYMBOLS),
            "n_lines": F.size(ls).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": F.when(F.size(p) > 0, _sum(step)).otherwise(F.lit(0).cast("long")),
            "n_latin_words": F.size(F.filter(w, lambda x: x.rlike(LATIN))).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long"),
        }
    ).drop(w, n, h, c, s, p, ls)


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, base_failed, failed_rules (names, in the table's order) and kept."""
    out = measures(docs, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = []
    for r in rules:
        value, per = 100 * F.col(r.value), F.col(r.per)
        tests = [value < r.low * per] * (r.low is not None) + [value > r.high * per] * (r.high is not None)
        failed += [F.when(t, F.lit(r.name)) for t in tests]
    out = out.withColumn("base_failed", base).withColumn("failed_rules", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def _sql_rules() -> str:
    tests = [f"100 * {r.value} < {r.low} * {r.per}" for r in RULES if r.low is not None] + [f"100 * {r.value} > {r.high} * {r.per}" for r in RULES if r.high is not None]
    return " OR ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '{WS}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_WS}')) AS ls FROM d),
g AS (SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY k),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '{LATIN}')))::BIGINT AS n_latin_words,
        len(list_filter(ws, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_sql_rules()}) AS kept, n_lines, n_stop_words FROM b
"""
