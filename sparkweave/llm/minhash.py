"""Operator 13, MinHash near-duplicates by an LSH forest.

A document's set holds its distinct shingles; equal sets are grouped first, and all
that follows sees one of each. TREES times VALUES hash functions give a signature.
Each of TREES orders sorts the sets by the signature turned to begin at another
place. Sets that share no first DEPTH values with another one leave an order before it is
sorted. In an order a set's candidates are its WINDOW neighbours on each side,
which have the longest common prefixes with it: where few sets lie in a region of one
beginning these are all of the region, and where many do, those that agree
deeper, so that the depth adapts to the region. Neighbours across the bounds of
partitions are met in a second, small pass.

A candidate must agree in SCREEN values of the whole signature before texts are read.
First each set is verified with its nearest neighbour in each order, on the full sets;
then every candidate pair whose sets are not yet in one component. So a group of many
near copies costs a few verifications for each member and not one for each
pair, and no candidate is left out.

Windows do not cover regions of more than WINDOW + 1 sets. There each set is verified
first with the one of which there are most copies too; then all pairs of sets that
are still in different components meet, in blocks of BLOCK sets by BLOCK: those outside of
a region's largest component with each other and with all of that. They need not pass the
screen. So in regions of any size all pairs are found. Before texts are read all pairs pass
the filters of sifting.py, which lose nothing.

Shingles are told apart by 64-bit hashes and equal sets by 128 bits of them. A pair with a
similarity of 0.8 shares a beginning in some order with a probability of
1 - (1 - 0.8 ** 3) ** 12 = 0.9998.

Null, empty and white-space texts have empty sets and are linked with nothing. Rows
that repeat an id or a text stay, each with its own row. Null ids take part; a
component's id is the smallest that is not null (null if there is none), and a row is
kept if its id equals that, null counting as equal to null. Texts of any length are
worked on whole. Columns other than id and text are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, read_table
from .components import components
from .sifting import SIMILAR, compare_blocks, parity, sifted, wide_parity

SHINGLE = 4
TREES, VALUES, DEPTH = 12, 8, 3
SIZE = TREES * VALUES
WINDOW = 32
#: Of SIZE values so many must agree; at a similarity of 0.8 fewer do once in some 10,000 pairs.
SCREEN = 62
#: Sets that meet as many others at once, in regions that windows do not cover.
BLOCK = 2048
#: Bits of the wide parity for each shingle.
SPREAD = 4
#: Shingles whose hash functions are worked out together.
CHUNK = 1 << 16

_RANDOM = np.random.default_rng(13)
_SEEDS = _RANDOM.integers(0, 1 << 64, SIZE, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 64, SIZE, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted hashes; only A to Z are lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - shingle + 1
    codes = _mixed(words[:n])
    for j in range(1, shingle):
        codes = _mixed(codes + words[j : j + n])
    return np.unique(codes)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    num, den = SIMILAR
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SIZE values of 32 bits for each set; the sets are not empty."""
    out = np.empty((len(sets), SIZE), np.uint32)
    ends = np.cumsum([len(x) for x in sets])
    begin = 0
    while begin < len(sets):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, "right")))
        codes = np.concatenate(sets[begin:end])
        at = np.concatenate(([0], np.cumsum([len(x) for x in sets[begin : end - 1]]))).astype(np.int64)
        for k in range(SIZE):
            out[begin:end, k] = np.minimum.reduceat((codes ^ _SEEDS[k]) * _FACTORS[k], at) >> np.uint64(32)
        begin = end
    return out


def _marks(shingle: int):
    """n, digest of the set, keys (a hash of the first values in each order), low, a byte of each value, and parities."""

    @F.pandas_udf("n long, digest binary, keys array<long>, low binary, p0 long, p1 long, p2 long, p3 long, wide binary")
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(x, shingle) for x in texts]
        full = [i for i, x in enumerate(sets) if len(x)]
        digest, keys, low, wide = ([None] * len(sets) for _ in range(4))
        bits = np.zeros((len(sets), 4), np.int64)
        for i, row in zip(full, signatures([sets[i] for i in full])):
            digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            keys[i] = [xxhash.xxh3_64_intdigest(row[VALUES * t : VALUES * t + DEPTH].tobytes(), t) - (1 << 63) for t in range(TREES)]
            low[i] = row.astype(np.uint8).tobytes()
            bits[i], wide[i] = parity(sets[i]), wide_parity(sets[i], SPREAD)
        return pd.DataFrame({"n": [len(x) for x in sets], "digest": digest, "keys": keys, "low": low, **{f"p{k}": bits[:, k] for k in range(4)}, "wide": wide})

    return marks


def _neighbours(inner: bool, bounds: bool = False):
    """Of rows key, label, id, comp in order, the pairs a, b of neighbours that pass the screen.

    With `inner`, a row's nearest earlier neighbour, or the nearest later one if it has
    none; else all whose comp differs. The rows next to the bounds of a partition come
    out too, with key and label instead of b, and with the partition's number. With
    `bounds` rows have that number, and only pairs of different partitions are made.
    """

    def run(batches):
        held, first_key, number = None, None, TaskContext.get().partitionId()
        for pdf in batches:
            if not len(pdf):
                continue
            key, ids, comp = (pdf[c].to_numpy(np.int64) for c in ("key", "id", "comp"))
            part = pdf["part"].to_numpy(np.int64) if bounds else np.full(len(key), number)
            label = np.frombuffer(b"".join(pdf["label"]), np.uint8).reshape(-1, SIZE)
            if first_key is None:
                first_key, seen = key[0], 0
            head = (key == first_key) & (np.arange(seen, seen + len(key)) < WINDOW)
            seen += len(key)
            if head.any() and not bounds:
                yield _edge(key[head], label[head], ids[head], comp[head], part[head])
            old = 0
            lonely = np.ones(len(key), bool)
            if held is not None:
                old = len(held[0])
                key, label, ids, comp, part, lonely = (np.concatenate(x) for x in zip(held, (key, label, ids, comp, part, lonely)))
            best, to = np.zeros(len(key), np.int64), np.full(len(key), -1)
            later, to_later = np.zeros(len(key), np.int64), np.full(len(key), -1)
            for s in range(1, min(WINDOW, len(key) - 1) + 1):
                i = np.nonzero(key[s:] == key[:-s])[0] + s
                if not len(i):
                    break
                i = i[(i >= old) & (ids[i] != ids[i - s]) & (inner | (comp[i] != comp[i - s])) & ((part[i] != part[i - s]) | (not bounds))]
                same = (label[i] == label[i - s]).sum(1)
                i, same = i[same >= SCREEN], same[same >= SCREEN]
                if not inner:
                    yield _pairs(ids[i], ids[i - s])
                    continue
                better = same > best[i]
                best[i[better]], to[i[better]] = same[better], i[better] - s
                better = same > later[i - s]
                later[i[better] - s], to_later[i[better] - s] = same[better], i[better]
            if inner:
                lonely &= to < 0
                yield _pairs(ids[to >= 0], ids[to[to >= 0]])
                go = lonely & (to_later >= 0)
                yield _pairs(ids[go], ids[to_later[go]])
            held = tuple(x[-WINDOW:] for x in (key, label, ids, comp, part, lonely))
        if held is not None and not bounds:
            tail = held[0] == held[0][-1]
            yield _edge(*(x[tail] for x in held[:5]))

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b), "key": None, "label": None, "comp": None, "part": None})


def _edge(key: np.ndarray, label: np.ndarray, ids: np.ndarray, comp: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": ids, "b": None, "key": key, "label": [x.tobytes() for x in label], "comp": comp, "part": part})


def candidates(forest: DataFrame, inner: bool, made: list[str]) -> DataFrame:
    """forest: key, label, id, comp. Returns distinct pairs a > b."""
    kind = "a long, b long, key long, label binary, comp long, part long"
    ordered = forest.select("key", "label", "id", "comp").repartitionByRange("key", "label", "id").sortWithinPartitions("key", "label", "id")
    found = cut(ordered.mapInPandas(_neighbours(inner), kind), "neighbours", made)
    edges = found.filter("b IS NULL").select("key", "label", F.col("a").alias("id"), "comp", "part").dropDuplicates(["key", "id"])
    # Regions inside one partition have nothing to add.
    edges = edges.repartition("key").sortWithinPartitions("key", "label", "id")
    more = edges.mapInPandas(_neighbours(inner, True), kind).filter("b IS NOT NULL")
    return cut(found.filter("b IS NOT NULL").select("a", "b").unionByName(more.select("a", "b")).distinct(), "candidates", made)


def _confirm(shingle: int):
    def run(batches):
        for pdf in batches:
            ok = np.array([similar(shingle_set(x, shingle), shingle_set(y, shingle)) for x, y in zip(pdf["x"], pdf["y"])], bool)
            yield pdf.loc[ok, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, made: list[str]) -> DataFrame:
    """The pairs whose full sets are similar enough. texts: id, text."""
    one, two = (texts.select(F.col("id").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return cut(both.mapInPandas(_confirm(shingle), "a long, b long").distinct(), "confirmed", made)


def central(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a > b of each set of a region and the region's set of most copies. crowd: key, id."""
    hubs = crowd.join(sets.select("id", "copies"), "id").groupBy("key").agg(F.max(F.struct("copies", "id")).alias("hub")).select("key", "hub.id").toDF("key", "hub")
    return crowd.join(hubs, "key").filter("id <> hub").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b"))


def beyond_windows(crowd: DataFrame, sets: DataFrame, roots: DataFrame, made: list[str]) -> DataFrame:
    """All pairs a > b of different components in one region that pass the filters. crowd: key, id; roots: node, root."""
    rows = crowd.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    rows = cut(rows, "crowd", made)
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("main")).filter("main.c < all")
    blocks = parts.select("key", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.c")) / BLOCK).alias("few"), F.ceil(F.col("main.c") / BLOCK).alias("many"))
    rows = rows.join(blocks, "key").join(sets.select("id", "n", "p0", "p1", "p2", "p3", "wide"), "id")
    # The blocks of the largest component follow those of the other sets, and do not meet each other.
    main, at = F.col("comp") == F.col("main"), F.xxhash64("id")
    rows = rows.withColumn("block", F.when(main, F.col("few") + F.pmod(at, "many")).otherwise(F.pmod(at, "few")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = rows.select("key", "id", "n", F.lit(0).alias("pos"), "comp", "p0", "p1", "p2", "p3", "wide", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.groupBy("key", "i", "j").applyInPandas(compare_blocks, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """A row for each of docs: doc, n (size of its set) and component_id."""
    spark = docs.sparkSession
    made: list[str] = []
    own = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")).withColumn("th", F.xxhash64("text"))
    marked = cut(own.select("doc", "th", _marks(shingle)("text").alias("m")).select("doc", "th", "m.*"), "marked")
    place, bits = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "th"), ("n", "p0", "p1", "p2", "p3", "wide")
    sets = marked.filter("n > 0").groupBy("digest").agg(F.min(place).alias("at"), F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("keys", "low", *bits)))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("id"), "digest", "at", "copies", "keys", "low", *bits), "sets", made)

    beginnings = sets.select("id", F.posexplode("keys").alias("tree", "key"))
    shared = beginnings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    met = beginnings.join(shared, "key", "left_semi")
    turned = F.concat(F.expr(f"substring(low, tree * {VALUES} + 1, {SIZE})"), F.expr(f"substring(low, 1, tree * {VALUES})"))
    forest = cut(met.join(sets.select("id", "low"), "id").select("key", turned.alias("label"), "id", F.col("id").alias("comp")), "forest", made)

    large = forest.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > WINDOW + 1).select("key")
    large = cut(large, "large", made)
    crowd = cut(forest.select("key", "id").join(large, "key", "left_semi"), "regions", made)
    close = candidates(forest, True, made)
    asked = close.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")).distinct().join(sets.select("id", "at"), "id").select("id", "at.doc", "at.th")
    texts = own.alias("o").join(asked.hint("shuffle_hash").alias("q"), F.col("o.doc").eqNullSafe(F.col("q.doc")) & (F.col("o.th") == F.col("q.th"))).select("id", "text")
    texts = cut(texts, "texts", made)
    near = cut(sifted(sets, close.unionByName(central(crowd, sets)).distinct()), "near", made)
    first = confirmed(near, texts, shingle, made)
    roots = cut(components(first), "roots", made)

    # What is left to compare: sets of different components in one region.
    placed = forest.drop("comp").join(large, "key", "left_anti").join(texts.select("id").distinct(), "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "label", "id", F.coalesce("root", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    others = sifted(sets, candidates(placed.join(mixed, "key", "left_semi"), False, made)).unionByName(beyond_windows(crowd, sets, roots, made)).distinct()
    second = confirmed(cut(others.join(near, ["a", "b"], "left_anti"), "others", made), texts, shingle, made)
    if not second.isEmpty():
        roots = cut(components(first.unionByName(second)), "roots", made)

    placed = sets.join(roots, F.col("id") == F.col("node"), "left").select("digest", "at.doc", F.coalesce("root", "id").alias("root"))
    # The smallest id of a set is that of its place.
    named = placed.join(placed.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("digest", "component_id")
    named = cut(named, "named")
    discard(spark, made)
    linked = marked.filter("n > 0").join(named, "digest").select("doc", "n", "component_id")
    return linked.unionByName(marked.filter("n = 0").select("doc", "n", F.col("doc").alias("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))
