"""Operator 9, line deduplication by an exact set-similarity join.

A line is the set of its words. A line is removed if an earlier line of the table,
removed itself or not, has a Jaccard similarity of SIMILAR or more; the order is
that of ids (null last), texts' hashes and line numbers. Lines without words stay.

Equal lines are grouped first, by the lines themselves; all that follows sees one of
each, the earliest. Words are ordered by rarity: all words of these lines are counted
into a table of 2 ** SLOT_BITS counters, which only sets the order, so that words
sharing a counter cost time but no matches. Of n words the first
n - ceil(SIMILAR n) + 1 are the prefix; similar lines share a word of their prefixes.
Pairs of postings must pass the length filter, the positional filter and a parity
filter (64 bits, each flipped by words; the bits that differ are at most the words
that are in one line only; later one of 128 bits). What is left is verified with the words
themselves. Words are 25 bits of a hash and the rarity in the prefixes, which adds pairs to
verify where words meet by chance, and loses none; words of one line are counted as
equal by 57 bits of a hash.

Postings are of rare words only, so that each meets fewer than FREQUENT others. A line with a
frequent word in its prefix has all its rare words there. Two similar lines that share no
rare word of their prefixes both are such lines, and no rare word is in both. For them
there are grams: runs of three frequent words that follow each other in the order of rarity. A word that
only one of two lines has spoils at most three grams of that line and two of the other, so
that similar lines of n words share one of their first 3 n / 5 + 1 grams, or of three fewer for each
rare word. (Lines of four and five words may share none, and lines of one or two words have no run of
three; up to five words runs of two, or whatever there is, are taken too.) Three words seldom
meet by chance, however many lines there are.

So that large groups of similar lines do not give all their pairs, lines with grams
are first compared with the earliest line that has the gram; only lines that find no match
there go on to ask all others. Under a gram of more than ASKERS such lines they meet in blocks
of about BLOCK by BLOCK lines, dealt out by gram and blocks.

Null and empty texts have no lines with words and stay as they are. Rows equal in
id and text share one result. An empty table gives an empty result. Only id and
text are read; other columns stay as they are, but for n_lines and n_removed, which
are replaced. Of a text without removed lines nothing changes. Texts of any number of
lines take time in proportion to it.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WS, WRITING, WS, cut, discard, read_table, settings, words

#: As a fraction, so that all bounds are whole numbers.
SIMILAR = (4, 5)
SLOT_BITS = 22
HASH_BITS = 25
#: Slots of lines whose texts are read.
MARK_BITS = 20
#: Words are frequent from so many occurrences on.
FREQUENT = 512
#: Words of a gram; lines of at most SHORT words have grams of a word less, too.
GRAM, SHORT = 3, 5
#: Lines that ask all others under one gram meet in blocks where there are more than this.
ASKERS = 256
#: Lines of a block.
BLOCK = 2048
#: Of an earlier form, in which keys grew by words; only tests set them.
CROWD, MOST_WORDS = 2048, 2


def slot_table(spark: SparkSession, levels: DataFrame, slots: int) -> bytes:
    """levels: slot, level (0 to 127; 0 where missing). One byte for each slot, put together by Spark in rows of 1024."""
    parts = levels.groupBy(F.shiftright("slot", 10).alias("row")).agg(F.array_sort(F.collect_list(F.struct(F.col("slot").bitwiseAND(F.lit(1023)).alias("at"), "level"))).alias("v"))
    gap = lambda x, i: x["at"] - F.coalesce(F.get("v", i - 1)["at"], F.lit(-1)) - 1
    text = F.array_join(F.transform("v", lambda x, i: F.concat(F.repeat(F.char(F.lit(0)), gap(x, i)), F.char(x["level"]))), "")
    out = bytearray(-(-slots // 1024) * 1024)
    with settings(spark, WRITING):
        for r in parts.select("row", text.alias("text")).collect():
            out[r["row"] * 1024 : r["row"] * 1024 + len(r["text"])] = r["text"].encode("ascii")
    return bytes(out)


def slot_marks(spark: SparkSession, slots: DataFrame) -> DataFrame:
    """slots: slot. One row with a bit for each slot, 64 to a number; it is used as a subquery, so that plans hold none of it."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)))
    rows = slots.groupBy(F.shiftright("slot", 6).cast("long").alias("at")).agg(F.bit_or(bit).alias("bits"))
    every = spark.range(1 << (MARK_BITS - 6)).withColumnRenamed("id", "at").join(rows, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("marks"))


def _marked(marks: DataFrame, slot: Column) -> Column:
    return F.getbit(F.get(marks.scalar(), F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1


def _slot(value: Column) -> Column:
    return F.hash(value).bitwiseAND(F.lit((1 << MARK_BITS) - 1))


def unique_lines(docs: DataFrame, made: list[str]) -> DataFrame:
    """id (any number of its own), line, and at, the place of the first line that is equal: nameless (a null id), doc, th (a hash of the text), i."""
    lines = docs.filter("text IS NOT NULL").select("doc", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(F.col("line").rlike(NOT_WS))
    place = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "th", "i")
    # The hash makes for quick sorting; lines are told apart by themselves.
    first = lines.groupBy(F.xxhash64("line").alias("h"), "line").agg(F.min(place).alias("at"))
    return cut(first.select(F.monotonically_increasing_id().alias("id"), "line", "at"), "lines", made)


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As F.xxhash64 has them in Spark, for tests: a hash of each word, line by line, and how many words each line has."""
    import xxhash

    found = [line.encode("utf-8", "surrogatepass").split() for line in lines]
    return np.array([xxhash.xxh64_intdigest(w, 42) for x in found for w in x], np.uint64), np.array([len(x) for x in found])


def _split(line: str) -> Column:
    """The words of a line and empty strings. Splitting by one character takes no pattern, and few lines have other white space."""
    return F.split(F.when(F.col(line).rlike(r"[\x09-\x0D]"), F.regexp_replace(line, WS, " ")).otherwise(F.col(line)), " ")


def _place(h: Column) -> Column:
    """The slot of a word's hash."""
    return F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")


def rarity(lines: DataFrame) -> bytes:
    """For each slot twice the logarithm of how many words of all lines fall into it, 0 to 63."""
    found = lines.select(F.explode(_split("line")).alias("w")).filter("w != ''")
    counts = found.groupBy(_place(F.xxhash64("w")).alias("slot")).agg(F.count("*").alias("n"))
    # A little more, as logarithms of powers may come out a little too small.
    level = F.least(F.lit(63), F.floor(2 * F.log2(F.col("n") + 1) + 1e-9)).cast("int")
    return slot_table(lines.sparkSession, counts.select("slot", level.alias("level")), 1 << SLOT_BITS)


def _level_table(spark: SparkSession, levels: bytes) -> DataFrame:
    """One row with rarity()'s levels in an array, for subqueries."""
    return spark.createDataFrame(pa.table({"levels": pa.array([np.frombuffer(levels, np.int8)], pa.list_(pa.int8()))}))


def shared() -> int:
    """The least token of a word that may be in two lines: no other word is in the slots of the words below."""
    return int(2 * log2(2 + 1)) << HASH_BITS


def frequent() -> int:
    """The least token of a frequent word."""
    return int(2 * log2(FREQUENT + 1)) << HASH_BITS


def _keys(hashes: str, levels: str) -> Column:
    """The distinct words of a line as numbers in order, the rarest first: six bits of rarity and 57 of a hash."""
    level = lambda h: F.call_function("shiftleft", F.coalesce(F.get(levels, _place(h)), F.lit(0).cast("tinyint")).cast("long"), F.lit(57))
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: level(h).bitwiseOR(h.bitwiseAND(F.lit((1 << 57) - 1))))))


def _parity(keys: Column) -> Column:
    """64 bits, each flipped by the words that fall into it."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda found, k: found.bitwiseXOR(bit(k)))


def _grams(keys: str, rare: str) -> Column:
    """Hashes of the first runs of frequent words, as many as it takes for similar lines that share none of their rare words to share one."""
    n = F.size(keys)

    def runs(size: int) -> Column:
        last = F.least(n - F.col(rare) - size, F.floor(n * 3 / 5).cast("int") - size * F.col(rare))
        # Lines of fewer words than a run have one run of all.
        last = F.when(n < size, 0).otherwise(last)
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(keys, F.col(rare) + i + 1, F.lit(size))))).otherwise(none)

    none = F.array().cast("array<long>")
    return F.concat(F.when(n >= SHORT, runs(GRAM)).otherwise(none), F.when(n <= SHORT, runs(GRAM - 1)).otherwise(none))


def index_lines(lines: DataFrame, levels: DataFrame, made: list[str]) -> DataFrame:
    """id, at, n (words), parity, the same in two parts of 64 bits each, prefix, tokens in order, rare (how many words are), and grams (null where no word of the prefix is frequent)."""
    # Each is used once, so that both become parts of the next step and no row has a table of its own.
    hashed = lines.select("id", "at", F.transform(F.array_remove(_split("line"), ""), lambda w: F.xxhash64(w)).alias("hashes"), levels.scalar().alias("levels"))
    keyed = hashed.select("id", "at", _keys("hashes", "levels").alias("k"))
    split = keyed.select("id", "at", "k", F.size(F.filter("k", lambda k: k < frequent() << (57 - HASH_BITS))).alias("rare"))
    n, rare = F.size("k"), F.col("rare")
    first = F.transform(F.slice("k", F.lit(1), _prefix(n)), lambda k: F.shiftright(k, 57 - HASH_BITS).cast("int"))
    grams = F.when(rare < _prefix(n), _grams("k", "rare"))
    # Rare and frequent words have a parity each.
    parts = split.select("id", "at", n.alias("n"), _parity(F.slice("k", F.lit(1), rare)).alias("p0"), _parity(F.slice("k", rare + 1, n)).alias("p1"), first.alias("prefix"), "rare", grams.alias("grams"))
    return cut(parts.select("id", "at", "n", F.col("p0").bitwiseXOR(F.col("p1")).alias("parity"), "p0", "p1", "prefix", "rare", "grams"), "index", made)


def _prefix(n: Column) -> Column:
    num, den = SIMILAR
    return (n - F.floor((n * num + den - 1) / den) + 1).cast("int")


def _far(a: str, b: str) -> Column:
    """How many bits of the parities differ."""
    return F.bit_count(F.col(f"{a}.parity").bitwiseXOR(F.col(f"{b}.parity")))


def _near(a: str, b: str, words: int = 1) -> Column:
    """The filters for postings of one key, `words` words of which the last is at pos; the first words that similar lines share pass them."""
    num, den = SIMILAR
    n, m, p, q = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    # shared / (n + m - shared) >= num / den; what is in one line only is n + m - 2 * shared.
    enough = (num + den) * (words - 1 + F.least(n - p, m - q)) >= num * (n + m)
    return (den * n >= num * m) & (den * m >= num * n) & enough & ((num + den) * _far(a, b) <= (den - num) * (n + m))


def _similar(a: str, b: str) -> Column:
    """Whether the words of two lines are similar enough."""
    num, den = SIMILAR
    one, two = words(F.col(a)), words(F.col(b))
    return (num + den) * F.size(F.array_intersect(one, two)) >= num * (F.size(F.array_distinct(one)) + F.size(F.array_distinct(two)))


def verified(lines: DataFrame, index: DataFrame, pairs: DataFrame, kept: list[str]) -> DataFrame:
    """Of the pairs x, y (far: bits that differ) whose words are similar enough, the id of the later line (distinct).

    A line is first compared with the nearest of the earlier ones; only if that is
    not similar enough is it compared with all others, so that a group of similar
    lines does not move all its texts together. Only lines whose slot some pair marks
    are read into the joins.
    """
    num, den = SIMILAR
    made: list[str] = []
    x, y = (index.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("at", "n", "p0", "p1"))) for k in "xy")
    later = F.col("at_x") > F.col("at_y")
    apart = F.bit_count(F.col("p0_x").bitwiseXOR(F.col("p0_y"))) + F.bit_count(F.col("p1_x").bitwiseXOR(F.col("p1_y")))
    placed = pairs.join(x, "x").join(y, "y").filter((num + den) * apart <= (den - num) * (F.col("n_x") + F.col("n_y")))
    ordered = cut(placed.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("late"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("early"), "far"), "pairs", made)

    def similar(some: DataFrame) -> DataFrame:
        slot = _slot(F.col("id"))
        asked = some.select(F.explode(F.array("late", "early")).alias("id")).distinct()
        marks = slot_marks(lines.sparkSession, asked.select(slot.alias("slot")).distinct())
        read = cut(lines.filter(_marked(marks, slot)).join(asked, "id", "left_semi").select("id", "line"), "asked", made)
        one, two = (read.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}")) for k in ("late", "early"))
        both = some.select("late", "early").join(one, "late").join(two, "early").filter(_similar("line_late", "line_early"))
        return cut(both.select(F.col("late").alias("id")).distinct(), "matched", kept)

    nearest = cut(ordered.groupBy("late").agg(F.min(F.struct("far", "early")).alias("e")).select("late", "e.early"), "nearest", made)
    first = similar(nearest)
    others = cut(ordered.join(first, F.col("late") == F.col("id"), "left_anti").join(nearest, ["late", "early"], "left_anti").select("late", "early"), "others", made)
    found = first if others.isEmpty() else first.unionByName(similar(others)).distinct()
    discard(lines.sparkSession, made)
    return found


def _like(a: str, b: str, apart: Column) -> Column:
    """The filters for lines of one gram, of which `apart` words at least are in one line only."""
    num, den = SIMILAR
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (den * n >= num * m) & (den * m >= num * n) & ((num + den) * apart <= (den - num) * (n + m))


def _bits(a: str, b: str, part: str) -> Column:
    return F.bit_count(F.col(f"{a}.{part}").bitwiseXOR(F.col(f"{b}.{part}")))


def _with_first(heavy: DataFrame) -> DataFrame:
    """heavy: the index of lines with grams. Pairs of lines and, for each of their grams, the earliest line with it."""
    rows = heavy.select("id", "at", "n", "p0", "p1", F.explode("grams").alias("gram"))
    firsts = rows.groupBy("gram").agg(F.min(F.struct("at", "id", "n", "p0", "p1")).alias("f"), F.count("*").alias("c")).filter("c > 1").select("gram", "f.id", "f.n", "f.p0", "f.p1")
    apart = _bits("a", "b", "p0") + _bits("a", "b", "p1")
    met = rows.alias("a").join(firsts.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") != F.col("b.id")) & _like("a", "b", apart))
    return met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), apart.alias("far")).distinct()


def _by_grams(heavy: DataFrame, done: DataFrame, made: list[str]) -> DataFrame:
    """heavy: the index of lines with grams. Pairs of lines of one gram, of which one line at least is not done; the lines of a gram meet in blocks.

    Pairs with a rare word in common are left to _by_rare(), so that all rare words are in one line only here.
    """
    asking = heavy.select("id", "n", "rare", "p1", "grams").join(done.withColumn("done", F.lit(True)), "id", "left")
    rows = asking.select("id", "n", "rare", "p1", F.col("done").isNull().alias("asks"), F.inline(F.transform("grams", lambda g, i: F.struct(g.alias("gram"), F.get("grams", i - 1).alias("before")))))
    blocks = F.when(F.col("askers") > ASKERS, F.ceil(F.col("c") / BLOCK).cast("int")).otherwise(1)
    asked = rows.groupBy("gram").agg(F.count_if("asks").alias("askers"), F.count("*").alias("c")).filter("askers > 0 AND c > 1").select("gram", blocks.alias("blocks"))
    held = cut(rows.join(asked, "gram").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "grams", made)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = held.filter("asks").select("gram", F.col("block").alias("i"), every.alias("j"), "id", "n", "rare", "p1", "before").alias("a")
    b = held.select("gram", every.alias("i"), F.col("block").alias("j"), "id", "n", "rare", "p1", "asks", "before").alias("b")
    same = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    apart = F.col("a.rare") + F.col("b.rare") + _bits("a", "b", "p1")
    # Lines with the gram before in common have met there.
    fresh = F.coalesce(F.col("a.before") != F.col("b.before"), F.lit(True))
    # Of two lines that both ask one is enough.
    met = a.join(b, same & (F.col("a.id") != F.col("b.id")) & ((F.col("a.id") > F.col("b.id")) | ~F.col("b.asks")) & fresh & _like("a", "b", apart))
    return met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), apart.alias("far"))


def _by_rare(index: DataFrame, done: DataFrame, least: int) -> DataFrame:
    """Pairs of lines that share a word that is not frequent, of which one line at least is not done. Lines that are done get ids below 0: they can be matched, but ask no more."""
    heavy = F.element_at("prefix", -1) >= least
    asks = index.filter(heavy).join(done.withColumn("done", F.lit(True)), "id", "left").withColumn("id", F.when(F.col("done"), -1 - F.col("id")).otherwise(F.col("id"))).select("id", "n", "parity", "prefix")
    every = index.filter(~heavy).select("id", "n", "parity", "prefix").unionByName(asks)
    postings = every.select("id", "n", "parity", F.posexplode("prefix").alias("pos", "tok")).filter((F.col("tok") < least) & (F.col("tok") >= shared()))
    # All that holds for one side is said of both, so that they are equal and postings are sent once.
    postings = postings.filter("id IS NOT NULL AND n IS NOT NULL AND parity IS NOT NULL AND pos IS NOT NULL AND tok IS NOT NULL")
    met = postings.alias("a").join(postings.alias("b"), (F.col("a.tok") == F.col("b.tok")) & (F.col("a.id") > F.greatest(F.col("b.id"), F.lit(-1))) & _near("a", "b"))
    y = F.coalesce(F.when(F.col("b.id") < 0, -1 - F.col("b.id")).otherwise(F.col("b.id")), F.lit(-1))
    return met.select(F.col("a.id").alias("x"), y.alias("y"), _far("a", "b").alias("far")).distinct()


def staying_lines(docs: DataFrame) -> DataFrame:
    """docs: doc, text. Returns doc, th and `stay`, the numbers of the lines with words that stay."""
    made: list[str] = []
    lines = unique_lines(docs, made)
    index = index_lines(lines, _level_table(docs.sparkSession, rarity(lines)), made)
    heavy = index.filter("grams IS NOT NULL")
    first = verified(lines, index, _with_first(heavy), made)
    others = _by_rare(index, first, frequent()).unionByName(_by_grams(heavy, first, made)).distinct()
    gone = first.unionByName(verified(lines, index, others, made))
    left = index.select("id", "at").join(gone, "id", "left_anti")
    out = cut(left.groupBy("at.doc", "at.th").agg(F.collect_list("at.i").alias("stay")), "stay")
    discard(docs.sparkSession, made)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the lines removed from text; adds n_lines (with words) and n_removed."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    text, doc_id = own[text], own[doc_id]
    stay = staying_lines(named.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")))
    out = named.join(stay.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("th")), "left")
    out = out.withColumn("lines", F.split(text, "\n"))
    out = out.withColumn("filled", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(NOT_WS), i)), lambda i: i.isNotNull()))
    out = out.withColumn("gone", F.array_except("filled", F.coalesce("stay", F.array().cast("array<int>"))))
    # The lines between one removed line and the next.
    between = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda j: F.struct((F.coalesce(F.get("gone", j - 1), F.lit(-1)) + 2).alias("from"), F.coalesce(F.get("gone", j), F.size("lines")).alias("to")))
    left = F.array_join(F.flatten(F.transform(between, lambda x: F.slice("lines", x["from"], x["to"] - x["from"] + 1))), "\n")
    return out.select(
        *(F.when(F.size("gone") > 0, left).otherwise(F.col(x)).alias(c) if x == text else F.col(x).alias(c) for c, x in own.items() if c.lower() not in ("n_lines", "n_removed")),
        F.coalesce(F.size("filled"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
