"""Operator 3, SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank and cut into blocks of equal size,
whatever their distribution. A block is described by the bits that all its
members share; runs of blocks, and inside a block runs of members, form upper
nodes in the same way. A search adds up the differing bits on the way down and
leaves a whole group as soon as there are too many. The directory of blocks has
MAX_BLOCKS entries at most besides one for each partition, and only this is
broadcast; members and queries meet by a shuffle on the block's number. With more
than BLOCK * MAX_BLOCKS distinct fingerprints the blocks grow, and with them the
index inside each, which is searched by the same levels.

The width of shingles and the distance are parameters. Texts of any length are
hashed in pieces. Of a table only fingerprints and ids go through the joins that may
have hot keys.

Fingerprints miss most pairs whose similarity is little above 0.8. keep_similar() compares
the full sets of shingles of texts whose fingerprints are linked, and finds all other
similar pairs by the exact join of set_join.py, so that none is lost. There empty texts
are linked with nothing.

Null, empty and white-space texts have fingerprint 0 and link like any other.
Repeated rows and ids stay, with equal results. Null ids take part, and a
component's id is the smallest id that is not null (null if there is none).
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, read_table
from .components import components
from .minhash import confirmed, shingle_set
from .set_join import across, meetings, sifted

SHINGLE = 3
SEED = 42
DISTANCE = 2
FAN = 16
BLOCK = 1024
MAX_BLOCKS = 1 << 16
PIECE = 1 << 16
QUERIES = 2048
#: Of keep_similar(): fingerprints, and words of their shingles.
SEEDS, SEED_SHINGLE = 1, 2
SEED_PIECE = 1 << 13


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as a signed number; only A to Z are lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - shingle + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[shingle - 1 :].tolist() if len(found) >= shingle else [len(joined)]
    total = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        own = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE])])
        total += np.unpackbits(np.frombuffer(own, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(k))
    return codes


def _gray_column(code: Column) -> Column:
    """The rank, with the top bit flipped so that signed order is rank order."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def build(mask: np.ndarray, value: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels of the index, the top one first. The items are in Gray order; mask says which bits an item fixes, and value what they are."""
    levels = [(mask, value & mask)]
    while len(mask) > FAN:
        at = np.arange(0, len(mask), FAN)
        all_set, any_set = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value, at)
        mask = np.bitwise_and.reduceat(mask, at) & ~(all_set ^ any_set)
        value = all_set & mask
        levels.append((mask, value))
    return levels[::-1]


def search(levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, most: int = DISTANCE):
    """Yields arrays (query, item) of all that differ in at most `most` of the bits that the item fixes."""
    n = len(levels[0][0])
    for begin in range(0, len(queries), QUERIES):
        own = queries[begin : begin + QUERIES]
        q, node = np.repeat(np.arange(len(own)), n), np.tile(np.arange(n), len(own))
        known, far = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint8)
        for depth, (mask, value) in enumerate(levels):
            if depth:
                q, known, far = (np.repeat(x, FAN) for x in (q, known, far))
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(mask)
                q, known, far, node = q[there], known[there], far[there], node[there]
            far = far + np.bitwise_count((own[q] ^ value[node]) & mask[node] & ~known)
            near = far <= most
            q, node, far = q[near], node[near], far[near]
            known = mask[node]
        yield q + begin, node


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest number in its component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _cut_blocks(size: int):
    def run(batches):
        part, number, rest = TaskContext.get().partitionId(), 0, []
        for pdf in batches:
            rest.append(pdf["fp"].to_numpy())
            while sum(map(len, rest)) >= size:
                have = np.concatenate(rest)
                yield pd.DataFrame({"block": part << 32 | number, "fp": have[:size]})
                number, rest = number + 1, [have[size:]]
        have = np.concatenate(rest) if rest else []
        if len(have):
            yield pd.DataFrame({"block": part << 32 | number, "fp": have})

    return run


def _route(directory, most: int):
    """Sends each fingerprint to its own block and to the later ones that may hold a link."""

    def run(batches):
        names, mask, value = directory.value
        levels = build(mask, value)
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            own = np.searchsorted(names, pdf["block"].to_numpy())
            for q, block in search(levels, fp, most):
                keep = block >= own[q]
                q, block = q[keep], block[keep]
                yield pd.DataFrame({"block": block, "fp": fp[q].view(np.int64), "own": block == own[q]})

    return run


def _link(most: int):
    """Links inside a block: each member and each visitor to the first member of its component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        home = fp[own]
        home = home[np.argsort(gray_rank(home))]
        nodes = np.concatenate((home, fp[~own]))
        levels = build(np.full(len(home), ~np.uint64(0)), home)
        size = len(home)
        root, first = np.arange(size), np.full(len(nodes), -1)
        for q, item in search(levels, nodes, most):
            if len(q):
                begin = np.nonzero(np.diff(q, prepend=-1))[0]
                least = np.minimum.reduceat(item, begin)
                first[q[begin]] = least
                # Members that one node meets belong together.
                pairs = np.unique(item * size + np.repeat(least, np.diff(np.append(begin, len(q)))))
                root = stars(np.concatenate((pairs // size, np.arange(size))), np.concatenate((pairs % size, root)), size)
        to = np.where(first >= 0, root[first], -1)
        to[:size] = root
        moved = (to >= 0) & (to != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[moved].view(np.int64), "b": home[to[moved]].view(np.int64)})

    return run


def links(codes: DataFrame, most: int = DISTANCE) -> DataFrame:
    """codes: fp, distinct. Returns pairs a, b that connect what lies within the distance `most`."""
    spark = codes.sparkSession
    n = codes.count()
    size = max(BLOCK, -(-n // MAX_BLOCKS))
    ordered = codes.repartitionByRange(max(1, n // (8 * size)), _gray_column(F.col("fp"))).sortWithinPartitions(_gray_column(F.col("fp")))
    blocks = cut(ordered.select("fp").mapInPandas(_cut_blocks(size), "block long, fp long"), "blocks")
    top = blocks.groupBy("block").agg(F.bit_and("fp").alias("x"), F.bit_or("fp").alias("y")).orderBy("block").toPandas()
    all_set, any_set = (top[k].to_numpy(np.int64).view(np.uint64) for k in "xy")
    directory = spark.sparkContext.broadcast((top["block"].to_numpy(np.int64), ~(all_set ^ any_set), all_set))
    if not n:
        return spark.createDataFrame([], "a long, b long")
    routed = blocks.mapInPandas(_route(directory, most), "block long, fp long, own boolean")
    return routed.groupBy("block").applyInPandas(_link(most), "a long, b long")


def _grouped(docs: DataFrame, text: str, doc_id: str, keep: list[str], shingle: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The columns `keep` with fp, written once; and fp, root (the component's smallest fingerprint) and component_id of each fingerprint."""

    @F.pandas_udf("long")
    def fingerprints_of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    marked = cut(docs.select(*(F.col(f"`{c}`") for c in keep), fingerprints_of(F.col(f"`{text}`")).alias("fp")), "fingerprints")
    made: list[str] = []
    nodes = cut(marked.groupBy("fp").agg(F.min(F.col(f"`{doc_id}`")).alias("first")), "nodes", made)
    roots = components(links(nodes.select("fp"), most))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    named = cut(named, "named")
    discard(docs.sparkSession, made)
    return marked, named


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, shingle: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """The columns `keep` (all, if None) with fp (long), root (the component's smallest fingerprint) and component_id; an input column of such a name is replaced."""
    marked, named = _grouped(docs, text, doc_id, [c for c in (keep or docs.columns) if c not in ("fp", "root", "component_id")], shingle, most)
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """The rows with the smallest id of each component; of components without an id, and of rows that repeat such an id and fingerprint, one row."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked, named = _grouped(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items())), own[text], own[doc_id], list(own.values()), shingle, most)
    # Rows are chosen by id and fingerprint, so that no text goes through the join on fingerprints, where copies meet.
    rows = marked.select(F.col(own[doc_id]).alias("k"), "fp").join(named, "fp")
    chosen = rows.filter(F.col("k").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("k", "fp")).alias("r")).select("r.k", F.col("r.fp").alias("f"))
    kept = marked.join(chosen, F.col(own[doc_id]).eqNullSafe(F.col("k")) & (F.col("fp") == F.col("f")), "left_semi")
    return kept.dropDuplicates([own[doc_id], "fp"]).select(*(F.col(x).alias(c) for c, x in own.items()))


_RANDOM = np.random.default_rng(3)
_TURNS = _RANDOM.integers(0, 1 << 64, SEEDS, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 64, SEEDS, dtype=np.uint64) | np.uint64(1)


def fingerprints(text: str | None, shingle: int = SEED_SHINGLE) -> np.ndarray:
    """SEEDS fingerprints of a text's shingles, repeats included, as signed numbers."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found) - shingle + 1
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    codes = words[: max(1, n)].copy()
    for j in range(1, shingle if n > 0 else len(found)):
        codes = (codes ^ (codes >> np.uint64(31))) * _FACTORS[0] + words[j : j + max(1, n)]
    total = np.zeros((SEEDS, 64), np.int64)
    for i in range(0, len(codes), SEED_PIECE):
        own = (codes[None, i : i + SEED_PIECE] ^ _TURNS[:, None]) * _FACTORS[:, None]
        own = (own ^ (own >> np.uint64(32))) * _FACTORS[:, None]
        total += bit_counts(own ^ (own >> np.uint64(29)))
    return np.packbits(2 * total > len(codes), axis=1).view(">i8").ravel().astype(np.int64)


def bit_counts(codes: np.ndarray) -> np.ndarray:
    """How often each bit is set in each row of codes; bits are in the order of their place in a byte, then of the byte.

    Up to 255 numbers are added at once, with a byte for each bit's count.
    """
    rows, n = codes.shape
    width = min(255, n)
    lanes = np.concatenate((codes, np.zeros((rows, -n % width), np.uint64)), 1).reshape(rows, -1, width)
    out = np.empty((rows, 8, 8), np.int64)
    for k in range(8):
        sums = ((lanes >> np.uint64(k)) & np.uint64(0x0101010101010101)).sum(2)
        out[:, k] = sums.view(np.uint8).reshape(rows, -1, 8).sum(1, dtype=np.int64)
    return out.reshape(rows, 64)


def keep_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, most: int = DISTANCE) -> DataFrame:
    """The rows with the smallest id of each group of texts whose sets of `shingle` words have a similarity of 0.8 or more; of groups without an id, and of rows that repeat such an id and text, one row. Texts without words stay."""
    spark = docs.sparkSession
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    text, doc_id = own[text], own[doc_id]
    made: list[str] = []

    @F.pandas_udf("digest binary, fp long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(x, shingle) for x in texts]
        fps = pd.array([int(fingerprints(x)[0]) if len(s) else None for x, s in zip(texts, sets)], dtype="Int64")
        return pd.DataFrame({"digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "fp": fps})

    keyed = named.withColumn("th", F.xxhash64(text))
    marked = cut(keyed.select(F.col(doc_id).alias("doc"), "th", marks(text).alias("m")).select("doc", "th", "m.*"), "marked", made)
    place = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "th")
    sets = marked.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(place).alias("at"), F.any_value("fp").alias("fp"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("id"), "at", "fp"), "sets", made)
    asked = sets.select("id", "at.doc", "at.th").hint("shuffle_hash").alias("q")
    texts = keyed.alias("o").join(asked, F.col(f"o.{doc_id}").eqNullSafe(F.col("q.doc")) & (F.col("o.th") == F.col("q.th"))).select("id", F.col(text).alias("text"))
    texts = cut(cut(texts, "asked", made).dropDuplicates(["id"]), "texts", made)
    discard(spark, [made.pop(-2)])

    # First come the sets whose fingerprints are linked, and the first of the many that share a shingle.
    firsts = cut(sets.groupBy("fp").agg(F.min("id").alias("first")), "firsts", made)
    near = links(firsts.select("fp"), most)
    one, two = (firsts.select(F.col("fp").alias(k), F.col("first").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    apart = near.join(one, "a").join(two, "b").select("x", "y")
    equal = sets.join(firsts, "fp").select(F.col("id").alias("x"), F.col("first").alias("y"))
    bits, met = meetings(texts, shingle, made)
    leading = met.filter("key IS NOT NULL AND b IS NOT NULL").select(F.col("a").alias("x"), F.col("b").alias("y"))
    pairs = apart.unionByName(equal).unionByName(leading).filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    def similar(some: DataFrame) -> DataFrame:
        """Only texts of pairs that pass the filters are moved."""
        left = cut(sifted(bits, some), "pairs", made)
        asked = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return confirmed(left, cut(texts.join(asked, "id", "left_semi"), "compared", made), shingle, made)

    first = similar(pairs)
    roots = cut(components(first), "roots", made)

    # Then all others that may be similar and are not yet in one component.
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    others = met.filter("key IS NULL").select("a", "b").unionByName(across(bits, met, roots, made)).distinct()
    others = others.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    second = similar(others.select("a", "b"))
    roots = cut(components(first.unionByName(second)), "roots", made)

    placed = sets.join(roots, F.col("id") == F.col("node"), "left").select("at", F.coalesce("root", "id").alias("root"))
    chosen = cut(placed.groupBy("root").agg(F.min("at").alias("at")).select("at.doc", "at.th"), "chosen")
    without = marked.filter("digest IS NULL").select("doc", "th")
    stay = chosen.unionByName(without).distinct().toDF("stay", "stay_th").hint("shuffle_hash")
    kept = keyed.join(stay, F.col(doc_id).eqNullSafe(F.col("stay")) & (F.col("th") == F.col("stay_th")), "left_semi")
    out = cut(kept.dropDuplicates([doc_id, "th"]).select(*(F.col(x).alias(c) for c, x in own.items())), "similar")
    discard(spark, made)
    return out


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
