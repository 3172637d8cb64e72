"""Operator 4, secret scans by a trigram inverted index.

From each rule's pattern a Boolean query of trigrams is derived: alternatives, of
which one must hold, each a set of trigrams that all must occur. The index has a
posting for each document and trigram of the rules' queries; postings are
intersected by a grouping on document and alternative, and only the candidates are
searched with the pattern. Rules without mandatory trigrams search all documents.
Letters are compared without case in the index, which only adds candidates.

Null texts count as empty. Spans are in code points, the end exclusive. Documents
are known by a hash of id and text in the index, so that repeated ids or rows only
share candidates, which are verified row by row. An empty table gives an empty
result. Other columns are not touched.
"""

from __future__ import annotations

import itertools
import re._parser as parser
from dataclasses import dataclass
from re import _constants as op

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def _any_case(words: str) -> str:
    """Letters of either case, in ASCII alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The first three have matches as with `+`; their lengths are written into the patterns where that is the same, as matches are whole runs.
RULES = (
    Rule("assign", "(" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, True),
    # A key ends with its END line; where none follows before another block, the header alone is the span. Possessive repeats keep Java from recursing.
    Rule("private_key", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment_key", "[sr]k_live_[A-Za-z0-9]{16,}"),
)
#: The same for engines that look neither ahead nor hold on to repeats: dashes in a key's body, five or more of which do not come before BEGIN or END.
_PARTS = "(?:B|BE|BEG|BEGI|BEGIN|E|EN|END)"
_NO_MARK = "(?:[^-BE]|B[^E-]|BE[^G-]|BEG[^I-]|BEGI[^N-]|BEGIN[^ -]|E[^N-]|EN[^D-]|END[^ -])"
_BODY = f"(?:[^-]|(?:-{{5,}}{_PARTS})*(?:-{{1,4}}[^-]|-{{5,}}{_NO_MARK}))*(?:-{{5,}}{_PARTS})*-*"
SQL_PATTERNS = {"private_key": f"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:{_BODY}-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?"}
MOST_ALTERNATIVES = 16
GAP = None


def _sequences(nodes) -> list[tuple]:
    """The ways through a parsed pattern, as characters in lower case and gaps."""
    out = [()]
    for code, arg in nodes:
        if code is op.LITERAL:
            own = [(chr(arg).lower(),)]
        elif code is op.IN and {o for o, _ in arg} <= {op.LITERAL}:
            letters = {chr(c).lower() for _, c in arg}
            own = [(c,) for c in sorted(letters)] if len(letters) <= 6 else [(GAP,)]
        elif code is op.SUBPATTERN:
            own = _sequences(arg[3])
        elif code is op.BRANCH:
            own = [x for branch in arg[1] for x in _sequences(branch)]
        elif code is op.MAX_REPEAT and arg[:2] == (0, 1):
            own = [(), *_sequences(arg[2])]
        elif code is op.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
            own = _sequences(list(arg[2]) * arg[0])
        else:
            own = [(GAP,)]
        if len(out) * len(own) > MOST_ALTERNATIVES:
            own = [(GAP,)]
        out = [a + b for a, b in itertools.product(out, own)]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams that all must occur; an empty list if nothing is mandatory."""
    found = []
    for way in _sequences(parser.parse(pattern)):
        runs = [list(run) for gap, run in itertools.groupby(way, lambda c: c is GAP) if not gap]
        grams = frozenset("".join(run[i : i + 3]) for run in runs for i in range(len(run) - 2))
        if not grams:
            return []
        found.append(grams)
    return [a for a in dict.fromkeys(found) if not any(b < a for b in found)]


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and rules (their numbers) of the documents whose trigrams fit; docs has key and text."""
    clauses = [(n, grams) for n, r in enumerate(rules) for grams in trigram_query(r.pattern)]
    vocabulary = sorted(set().union(*(grams for _, grams in clauses)))
    folded = docs.select("key", F.lower("text").alias("text"))
    grams = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary))))
    postings = folded.select("key", F.explode(grams).alias("gram")).distinct()
    asked_by = F.array(*(F.array(*(F.lit(c) for c, (_, g) in enumerate(clauses) if t in g)) for t in vocabulary))
    asked = postings.select("key", F.explode(F.get(asked_by, F.col("gram"))).alias("clause"))
    sizes, rule_of = (F.array(*map(F.lit, x)) for x in ([len(g) for _, g in clauses], [n for n, _ in clauses]))
    whole = asked.groupBy("key", "clause").agg(F.count("*").alias("n")).filter(F.col("n") == F.get(sizes, F.col("clause")))
    return whole.groupBy("key").agg(F.collect_set(F.get(rule_of, F.col("clause"))).alias("rules"))


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Structs kind, i, gap (characters since the match before), size and own (those of the group) of all matches."""
    pattern, length = F.lit(rule.pattern), lambda xs: F.transform(xs, lambda x: F.length(x))
    group = length(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    parts = F.arrays_zip(length(F.split(text, rule.pattern)).alias("gap"), length(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"), group.alias("own"))
    numbered = F.transform(parts, lambda p, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), p["gap"].alias("gap"), p["size"].alias("size"), p["own"].alias("own")))
    # What follows the last match is a gap without a match. Most texts have no match at all, and a plain search is cheaper than the lists.
    return F.when(text.rlike(rule.pattern), F.filter(numbered, lambda x: x["own"].isNotNull()))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of structs begin, kind (the rule's number) and end, in order.

    The places of matches are running sums over their sizes and the gaps between, in a window for each text
    and rule, so that a text takes time in proportion to its matches.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    asked = own.join(candidates(own.select("key", "text"), rules), "key", "inner" if all(trigram_query(r.pattern) for r in rules) else "left")
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,own:int>>")
    lists = []
    for n, rule in enumerate(rules):
        fits = F.array_contains("rules", n) if trigram_query(rule.pattern) else F.lit(True)
        lists.append(F.coalesce(F.when(fits, _matches(F.col("text"), rule, n)), none))
    # Equal rows share a key, and one of them is enough.
    found = asked.dropDuplicates(["key"]).select("key", F.explode(F.concat(*lists)).alias("m")).select("key", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "kind").orderBy("i")).cast("int")
    least = F.get(F.array(*(F.lit(r.least) for r in rules)), F.col("kind"))
    placed = found.withColumn("end", end).filter(F.col("own") >= least).select("key", F.struct((F.col("end") - F.col("size")).alias("begin"), "kind", "end").alias("span"))
    spans = placed.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    nothing = F.array().cast("array<struct<begin:int,kind:int,end:int>>")
    return own.select("doc_id", "key").join(spans, "key", "left").select("doc_id", F.coalesce("spans", nothing).alias("spans"))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    base = [n for n, r in enumerate(RULES) if r.base]
    count = lambda n: F.size(F.filter("spans", lambda x: x["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *(count(n).alias(f"n_{RULES[n].kind}") for n in base),
        F.sha2(_written(F.filter("spans", lambda x: x["kind"].isin(base)), RULES).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans"), RULES).alias("spans"),
    )


def _sql() -> str:
    quoted = [SQL_PATTERNS.get(r.kind, r.pattern).replace("'", "''") for r in RULES]
    lists = ", ".join(f"regexp_extract_all(t, '{q}', 0) AS m{n}, regexp_extract_all(t, '{q}', {r.group}) AS g{n}, string_split_regex(t, '{q}') AS p{n}" for n, (r, q) in enumerate(zip(RULES, quoted)))
    begin = "list_sum(list_transform(p{n}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{n}[1:i - 1], lambda x: length(x))), 0)"
    rows = " UNION ALL ".join(
        f"SELECT k, {n} AS kind, '{r.kind}' AS name, ({begin.format(n=n)})::BIGINT AS b, length(m{n}[i]) AS n FROM (SELECT k, m{n}, g{n}, p{n}, unnest(range(1, len(m{n}) + 1)) AS i FROM f) WHERE length(g{n}[i]) >= {r.least}"
        for n, r in enumerate(RULES)
    )
    base = ", ".join(str(n) for n, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {n}), 0)::BIGINT AS n_{r.kind}" for n, r in enumerate(RULES) if r.base)
    line = "name || ':' || b || ':' || (b + n)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT k, {lists} FROM d),
s AS ({rows}),
a AS (SELECT k, {counts}, string_agg({line}, ',' ORDER BY b, kind) FILTER (kind IN ({base})) AS base, string_agg({line}, ',' ORDER BY b, kind) AS spans FROM s GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (k)
"""


SQL = _sql()
