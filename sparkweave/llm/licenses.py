"""Operator 7, licence scans by a trained paragraph classifier.

Paragraphs are parts of a text between lines without letters and digits. A family of
licences is found in a paragraph in two ways, and both need the classifier: for
each family a logistic regression with sparse weights over words and pairs of words. Its
temperature and the least probability are calibrated on held-out rows; what has no family
above that is of the unknown class. A template comparison confirms what the classifier has found.

Notices: the lines of a paragraph, and the sentences of its lines joined, without marks of
comments. Each that names a family is scored, and the family is confirmed if its
probability is high enough and the name is that of the family (NAMED). So a notice of a
licence without a family, or of a name in another sense, is unknown, and one line
may state several families.

Passages: the licences' own paragraphs. A paragraph is cut into pieces, its lines and
the sentences in them, and its runs are its lines and each 1, 2, 4 and more pieces, up to
the whole, that begin in the middle of the run before, so that neither a wrap nor
other prose around hides a passage. A run is scored and may be confirmed if it has COVERED
or more of the word pairs of one of the family's passages, and the family's name if the
passage has it. Of such runs the lines, the shortest ones and those twice as
long are scored. A run with so many pairs of a passage has at least one of the passage's rarest
ones, and at least one of its key words: as many as leave too few pairs without
them.

Texts without a key word and without any of HINTS are not looked at, since nothing in
them can be confirmed, whatever its score.

It is trained on notices made from names and frames (license_notices), on passages, on
lines with the same words that state no licence or another one, and on at most NEGATIVES
distinct lines from anywhere in the texts that name no licence, chosen by a hash.

Texts of any length are scanned whole. Null and empty texts have no paragraphs. There is one result row for each input
row, repeated rows and ids included; an empty table gives an empty result. Other columns are not
touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table
from .license_notices import ALONE, CONTEXTS, DUAL, FRAMES, HINT_PATTERNS, HINTS, NAMED, NAMES, OTHER, OTHER_NAMES, SENSES
from .license_texts import PASSAGES
from .quality import STOP_WORDS

#: Lines with these are no examples of the class of all else.
ANCHORS = "|".join(map(re.escape, (*HINTS, "copyright")))
FAMILIES = list(NAMED)
COVERED = 0.5
COMMON = frozenset(STOP_WORDS)
NEGATIVES = 400
#: Of all pairs of a name and a frame one in so many is trained on, and one in HELD_OUT of these is held out for calibration.
THINNED, HELD_OUT = 3, 4

#: Gap between paragraphs, and ends of sentences.
BLANK = r"\n[^\p{L}\p{N}\n]*\n"
SENTENCE = r"(?<=[.!?;:])\s+"
#: Ends of sentences in notices, and what stands before the words of a line of comments.
STOP = r"(?<=[.!?])\s+"
LEAD = r"(?m)^[\s#*/;>%-]+"
LONG = 24
#: The level of runs that are a line.
LINE = -1


def tokens(line: str) -> list[str]:
    return re.findall(r"[^\W_]+", line.lower())


def grams(line: str) -> list[str]:
    t = tokens(line)
    return sorted({*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))})


def _pairs(line: str) -> list[str]:
    return [g for g in grams(line) if " " in g]


def plain(line: str) -> str:
    """The words with one space between and around them."""
    return f" {' '.join(tokens(line))} "


def templates() -> list[tuple[str, str]]:
    """Family and text of the passages, and of notices without a name, which are found as passages are."""
    return [(family, t) for family in FAMILIES for t in (*PASSAGES.get(family, ()), *ALONE.get(family, ())) if t in PASSAGES.get(family, ()) or not re.search(NAMED[family], plain(t))]


def notices() -> list[tuple[str, set[str]]]:
    """Lines and the families that they state: every THINNED-th pair of a frame and a name, and what stands alone."""
    named = [(n, {family}) for family, own in NAMES.items() for n in own] + [(n, set()) for n in OTHER_NAMES]
    rows = [(frame.format(n), own) for i, (n, own) in enumerate(named) for j, frame in enumerate(FRAMES) if (i + j) % THINNED == 0]
    rows += [(frame.format(n, m), own | more) for i, (n, own) in enumerate(named) for j, frame in enumerate(DUAL) for k in range(3) for m, more in (named[(7 * i + 11 * j + 17 * k + 5) % len(named)],) if n != m]
    rows += [(t, {family}) for family, own in ALONE.items() for t in own for t in (t, "The author says: " + t)]
    return rows + [(t, set()) for t in OTHER] + [(t.format(n), set()) for t in CONTEXTS for n in SENSES]


def rare_pairs() -> list[str]:
    """Pairs of which a text has one at least if it has COVERED of a template's pairs: of each template the rarest, as many as make it so."""
    every = [_pairs(t) for _, t in templates()]
    seen = Counter(w for own in every for g in own for w in g.split(" "))
    rare = lambda g: (math.prod(seen[w] for w in g.split(" ")), g)
    return sorted({g for own in every for g in sorted(own, key=rare)[: len(own) - math.ceil(COVERED * len(own)) + 1]})


def key_words() -> list[str]:
    """Words of which a text has one at least if it has COVERED of a template's pairs: of each template the longest, frequent words last, as many as make it so."""
    keys: set[str] = set()
    for _, t in templates():
        own = [g.split(" ") for g in _pairs(t)]
        for w in sorted({w for g in own for w in g}, key=lambda w: (w in COMMON, -len(w), w)):
            if sum(not keys & set(g) for g in own) < math.ceil(COVERED * len(own)):
                break
            keys.add(w)
    return sorted(keys)


def _passage_rows() -> list[tuple[str, set[str]]]:
    """The passages alone, in other words, and, if they are long, each half of them."""
    out = []
    for family, t in templates():
        w = t.split()
        halves = (" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])) if len(w) >= LONG else ()
        out += [(x, {family}) for x in (t, "The author says: " + t, *halves)]
    return out


@dataclass(frozen=True)
class Model:
    features: list[str]
    weights: np.ndarray  # features + 1 (the last for the constant) x FAMILIES
    temperature: float
    sure: float

    def probabilities(self, line: str) -> dict[str, float]:
        """Of one line, for tests and for a look at it."""
        place = {g: i for i, g in enumerate(self.features)}
        known = [place[g] for g in grams(line) if g in place]
        z = self.weights[known].sum(0) / np.sqrt(max(1, len(known))) + self.weights[-1]
        return dict(zip(FAMILIES, (1 / (1 + np.exp(-z / self.temperature))).tolist()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(rows: list[tuple[str, set[str]]], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(rows), len(place) + 1), np.float32), np.zeros((len(rows), len(FAMILIES)), np.float32)
    for i, (line, own) in enumerate(rows):
        known = [place[g] for g in grams(line) if g in place]
        x[i, known] = 1 / np.sqrt(max(1, len(known)))
        x[i, -1] = 1
        y[i, [FAMILIES.index(f) for f in own]] = 1
    return x, y


def fit(negatives: list[str], rounds: int = 200, rate: float = 8.0, decay: float = 2e-5, most: float = 0.98) -> Model:
    """Full-gradient descent with momentum; of the rows every HELD_OUT-th is held out for calibration: for the temperature, and for the least probability at which the held-out share of right families is `most`. Then all are used."""
    rows = notices() + _passage_rows() + [(x, set()) for x in negatives]
    features = sorted({g for line, own in rows[: len(rows) - len(negatives)] for g in grams(line)})
    x, y = _matrix(rows, {g: i for i, g in enumerate(features)})
    # Rows of a family, others that name it and all others count alike.
    hard = np.array([[bool(re.search(NAMED[f], plain(line))) for f in FAMILIES] for line, _ in rows], np.float32) * (1 - y)
    share = sum(k / np.maximum(1, k.sum(0)) for k in (y, hard, 1 - y - hard))

    def descend(on):
        w, v = np.zeros((2, x.shape[1], y.shape[1]), np.float32)
        own, want, part = x[on], y[on], share[on]
        for _ in range(rounds):
            v = 0.9 * v - rate * 0.1 * (own.T @ ((_sigmoid(own @ w) - want) * part) + decay * w)
            w = w + v
        return w

    held = np.arange(len(rows)) % HELD_OUT == HELD_OUT - 1
    z, want = (x[held] @ descend(~held)).astype(float), y[held]

    def loss(t):
        p = np.clip(_sigmoid(z / t), 1e-9, 1 - 1e-9)
        return -(want * np.log(p) + (1 - want) * np.log(1 - p)).sum()

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    p = _sigmoid(z / temperature)
    right = lambda t: want[p >= t].mean() if (p >= t).any() else 1.0
    sure = next((t for t in (0.5, 0.6, 0.7, 0.8, 0.9) if right(t) >= most), 0.9)
    return Model(features, descend(np.ones(len(rows), bool)), temperature, sure)


def _key(doc_id: str, text: str) -> Column:
    """128 bits of a document."""
    return F.struct(F.xxhash64(doc_id, text).alias("x"), F.xxhash64(F.lit(1), text, doc_id).alias("y"))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _once(value: Column, use) -> Column:
    """use(value), an array, with the value worked out once: functions with lambdas would work it out at each mention."""
    return F.flatten(F.transform(F.array(value), use))


def _pieces(paragraph: Column) -> Column:
    """Structs x (a line or a sentence in it) and line (its number)."""
    lines = F.transform(F.split(paragraph, "\n"), lambda t, n: F.transform(F.split(t, SENTENCE), lambda x: F.struct(x.alias("x"), n.alias("line"))))
    return F.filter(F.flatten(lines), lambda p: p["x"].rlike(r"[\p{L}\p{N}]"))


def _step(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size / 2).cast("int"))


def _run_text(pieces: Column, level: Column, b: Column) -> Column:
    """The text of the run number b of a level."""
    size = F.pow(F.lit(2), F.greatest(level, F.lit(0))).cast("int")
    own = F.when(level == LINE, F.filter(pieces, lambda p: p["line"] == b)).otherwise(F.slice(pieces, b * _step(size) + 1, size))
    return F.array_join(F.transform(own, lambda p: p["x"]), " ")


def _runs_with(n: Column, first: Column, last: Column, line: Column) -> Column:
    """Structs level and b of the runs of n pieces that hold the pieces first to last; line is null unless they are in one."""

    def of_level(level):
        size = F.pow(F.lit(2), level).cast("int")
        step = _step(size)
        low, high = F.greatest(F.lit(0), F.ceil((last - size + 1) / step).cast("int")), F.floor(first / step).cast("int")
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda b: F.struct(level.alias("level"), b.alias("b")))).otherwise(F.array().cast("array<struct<level:int,b:int>>"))

    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int")), of_level))
    return F.when(line.isNull(), runs).otherwise(F.array_append(runs, F.struct(F.lit(LINE).alias("level"), line.alias("b"))))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def _pairs_of(line: Column) -> Column:
    def of(words):
        n = F.size(words)
        return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))

    return _once(_words(line), of)


def _grams(line: Column) -> Column:
    return F.array_distinct(F.concat(_words(line), _pairs_of(line)))


def train(docs: DataFrame, text: str = "text") -> Model:
    """The negatives are the distinct lines with the lowest hashes; ever more of the hashes are read until there are enough."""
    known = {g for _, t in templates() for g in _pairs(t)}
    share = 8 * NEGATIVES / max(1, docs.count())
    while True:
        below = F.lit(True) if share >= 1 else F.lit(int(share * 2**64) - 2**63)
        line = F.filter(F.split(F.col(text), "\n"), lambda x: (F.length(x) > 20) & (below if share >= 1 else F.xxhash64(x) < below))
        some = docs.select(F.explode(line).alias("line")).filter(~F.lower("line").rlike(ANCHORS)).distinct()
        found = [r["line"] for r in some.select("line", F.xxhash64("line").alias("h")).orderBy("h", "line").limit(NEGATIVES).collect()]
        if len(found) == NEGATIVES or share >= 1:
            break
        share *= 16
    # Lines of a licence that name none are no negatives.
    return fit([x for x in found if 2 * sum(g in known for g in _pairs(x)) <= len(_pairs(x))])


def _placed_pairs(pieces: Column) -> Column:
    """Structs gram, first and last (the pieces of its words) and line (null if they are not in one line)."""
    flat = F.flatten(F.transform(pieces, lambda p, n: F.transform(_words(p["x"]), lambda w: F.struct(w.alias("w"), n.alias("n"), p["line"].alias("line")))))

    def of(words):
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("gram"), a["n"].alias("first"), b["n"].alias("last"), F.when(a["line"] == b["line"], a["line"]).alias("line")))

    return _once(flat, of)


def covered_runs(able: DataFrame) -> DataFrame:
    """able: key, i, pieces. Returns key, i, level, b, family, covered and needs (the family's name) of the runs with COVERED or more of a passage's pairs."""
    known = [(n, family, _pairs(t), bool(re.search(NAMED[family], plain(t)))) for n, (family, t) in enumerate(templates())]
    vocabulary = sorted({g for _, _, own, _ in known for g in own})
    own_pairs = able.sparkSession.createDataFrame([(g, n, family, len(own), needs) for n, family, own, needs in known for g in own], "gram string, template int, family string, size int, needs boolean")
    hit = F.filter(_placed_pairs(F.col("pieces")), lambda x: x["gram"].isin(vocabulary))
    # The table of passages is as large as these make it, whatever the corpus.
    hits = able.select("key", "i", F.size("pieces").alias("n"), F.explode(F.array_distinct(hit)).alias("h")).select("key", "i", "n", "h.*").join(F.broadcast(own_pairs), "gram")
    hits = cut(hits, "hits")
    share = (F.count_distinct("gram") / F.first("size")).alias("covered")
    # No run has more than its paragraph.
    enough = hits.groupBy("key", "i", "template").agg(share).filter(F.col("covered") >= COVERED).drop("covered")
    placed = hits.join(enough, ["key", "i", "template"], "left_semi").withColumn("run", F.explode(_runs_with(F.col("n"), F.col("first"), F.col("last"), F.col("line"))))
    found = placed.groupBy("key", "i", "template", "family", "needs", "run.level", "run.b").agg(share).filter(F.col("covered") >= COVERED)
    shortest = F.min(F.when(F.col("level") != LINE, F.col("level"))).over(Window.partitionBy("key", "i", "template"))
    near = found.withColumn("shortest", shortest).filter((F.col("level") == LINE) | (F.col("level") <= F.col("shortest") + 1))
    return cut(near.groupBy("key", "i", "level", "b", "family").agg(F.min("needs").alias("needs")), "covered")


def _plain(line: Column) -> Column:
    """As plain()."""
    return F.concat(F.lit(" "), F.array_join(_words(line), " "), F.lit(" "))


def _named(words: Column) -> Column:
    """The families that a line of plain() names."""
    return F.array_compact(F.array(*(F.when(words.rlike(pattern), F.lit(f)) for f, pattern in NAMED.items())))


def _lines(paragraph: Column) -> Column:
    """The lines of a paragraph and the sentences of its lines joined."""
    bare = F.regexp_replace(paragraph, LEAD, "")
    return F.array_union(F.split(bare, "\n"), F.split(F.replace(bare, F.lit("\n"), F.lit(" ")), STOP))


def named_lines(keyed: DataFrame) -> DataFrame:
    """keyed: key, i, paragraph. Returns key, i, words and family (distinct) of lines and sentences that name a family."""
    lines = keyed.select("key", "i", F.explode(_lines(F.col("paragraph"))).alias("line")).select("key", "i", _plain(F.col("line")).alias("words"))
    return lines.select("key", "i", "words", F.explode(_named(F.col("words"))).alias("family")).distinct()


def scored(lines: DataFrame, model: Model) -> DataFrame:
    """lines: key, i, words, family (distinct). Adds score, the probability of the family."""
    number = F.coalesce(*(F.when(F.col("family") == f, F.lit(k)) for k, f in enumerate(FAMILIES)))
    weights = lines.sparkSession.createDataFrame([(g, [float(v) for v in model.weights[k]]) for k, g in enumerate(model.features)], "gram string, w array<double>")
    parts = lines.select("key", "i", F.xxhash64("words").alias("h"), "words", "family", number.alias("k"), F.explode(_grams(F.col("words"))).alias("gram"))
    # The table of weights is as large as the notices and passages make it, whatever the corpus.
    sums = parts.join(F.broadcast(weights), "gram").groupBy("key", "i", "h", "words", "family", "k").agg(F.sum(F.get("w", F.col("k"))).alias("z"), F.count("*").alias("n"))
    constant = F.get(F.array(*(F.lit(float(v)) for v in model.weights[-1])), F.col("k"))
    z = (F.col("z") / F.sqrt(F.col("n")) + constant) / model.temperature
    return sums.select("key", "i", "words", "family", (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """key, i (the paragraph's number), family, score of what is confirmed, a row for each family of a paragraph. Equal documents share a key."""
    hinted = F.transform(F.array(F.lower(F.col(text))), lambda t: reduce(lambda x, y: x | y, (*(t.contains(h) for h in HINTS), *map(t.rlike, HINT_PATTERNS))))[0]
    found = named_lines(docs.filter(hinted).select(_key(doc_id, text).alias("key"), F.posexplode(_paragraphs(F.col(text))).alias("i", "paragraph")))
    notices_found = scored(found, model).filter(F.col("score") >= model.sure)

    rare = rare_pairs()
    keys = F.array(*map(F.lit, key_words()))
    keyed = docs.filter(F.arrays_overlap(_words(F.col(text)), keys)).select(_key(doc_id, text).alias("key"), F.posexplode(_paragraphs(F.col(text))).alias("i", "paragraph"))
    able = keyed.filter(F.exists(_pairs_of(F.col("paragraph")), lambda g: g.isin(rare))).distinct()
    able = cut(able.select("key", "i", _pieces(F.col("paragraph")).alias("pieces")), "able")
    met = covered_runs(able)
    # A run is scored only if it has enough of some passage, as it cannot be confirmed else.
    runs = able.join(met, ["key", "i"]).select("key", "i", "family", "needs", _plain(_run_text(F.col("pieces"), F.col("level"), F.col("b"))).alias("words"))
    right = F.coalesce(*(F.when(F.col("family") == f, F.col("words").rlike(pattern)) for f, pattern in NAMED.items()))
    runs = runs.filter(~F.col("needs") | right).drop("needs").distinct()
    both = notices_found.unionByName(scored(runs, model).filter(F.col("score") >= model.sure))
    return both.groupBy("key", "i", "family").agg(F.max("score").alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))


def scan(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, families (confirmed ones, sorted and joined by commas), n_paragraphs, n_unknown of these, score (the highest confirmed, or 0)."""
    own = classify(docs, model, text, doc_id).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.count_distinct("i").alias("known"),
        F.max("score").alias("score"),
    )
    every = docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"), F.size(_paragraphs(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("n_paragraphs"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return every.join(own, "key", "left").select("doc_id", zero("families", ""), "n_paragraphs", (F.col("n_paragraphs") - F.coalesce("known", F.lit(0))).alias("n_unknown"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
