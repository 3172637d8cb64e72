"""Operators 11 to 13: SQL and brute force on small tables with edge cases."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkweave.llm import divergence, minhash, search, set_join, simhash
from sparkweave.llm.common import term_table, terms

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rank string, comp long, `a.b` string"
BIG = (1 << 60) + 1
R = np.random.default_rng(11)
WORDS = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(400)]


def _prose(n):
    return " ".join(R.choice(WORDS, n))


def _changed(text, n):
    w = text.split(" ")
    for i in R.choice(len(w), n, replace=False):
        w[i] = str(R.choice(WORDS))
    return " ".join(w)


def _texts():
    edge = [None, "", " \t\n ", "one", "One", "one two three", "one two\nthree", "a b c d", "A-b_c d", "é ü 你好 ok", "123 45", "\x0b", "İI Kk", "don't stop", "word " * 3000]
    plain = [_prose(int(n)) for n in R.integers(5, 60, 60)]
    near = [_changed(t, int(R.integers(1, 3))) for t in plain[:30] for _ in range(3)]
    base = _prose(150)
    group = [_changed(base, 2) for _ in range(90)]
    return edge + plain + near + group + plain[:10] + [plain[3]] * 20


TEXTS = _texts()
DOCS = [(BIG + i if i % 7 == 0 else i, t, ("en", "fr", None, "", "x1")[i % 4 if i % 9 else 4], ("a", "b", None, "c", "é")[i % 5], 0, 1, "s", 2, "k") for i, t in enumerate(TEXTS)]
DOCS += [DOCS[20], (None, TEXTS[20], None, None, *[None] * 5), (None, None, None, None, *[None] * 5)]
ITEMS = [(i, t, "s") for i, t in enumerate(["w1 w2 w2 W3", "one", "", None, "nowhere", "w0é w5é", TEXTS[20], "123", "word one a"])] + [(1, "one", "s"), (None, "w7 w8", "s")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("newer")
    spark.createDataFrame(DOCS, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string, doc_id string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def _sql(folder, sql):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con.sql(sql)


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def _same(frame, relation):
    assert frame.columns == relation.columns
    assert _sorted(frame.collect()) == _sorted(relation.fetchall())


def test_terms():
    table = term_table(digits=True)
    text = "".join(map(chr, range(256))) + "İÉ ſ 9a_Z"
    want = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for t in terms(text, table)] == want
    letters = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for t in terms(text, term_table(digits=False))] == letters
    assert terms(None, table) == []


@pytest.mark.parametrize("block", [1000, 2])
def test_search_against_sql(spark, folder, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    _same(search.op11_search(spark, folder), _sql(folder, search.SQL))


def test_search_takes_the_smallest_ids_of_ties(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(50, 0, -1)] + [(None, "same words here"), (99, "other")], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(7, "words")], "item_id long, text string")
    rows = search.rank_documents(docs, items).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == list(range(1, 11)) and len({r["score"] for r in rows}) == 1
    few = search.rank_documents(docs.filter("doc_id IS NULL OR doc_id < 4"), items).orderBy("rank").collect()
    assert [r["doc_id"] for r in few] == [1, 2, 3, None]


def test_search_index_of_all_terms(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index, df, n_docs = search.build_index(docs)
    asked = [(1, Counter([b"w1", b"w2", b"w2"]))]
    some = search.build_index(docs, wanted={b"w1", b"w2"})
    assert n_docs == some[2] and df.count() > 2 and some[1].count() == 2
    assert _sorted(search.search(index, df, n_docs, asked).collect()) == _sorted(search.search(*some, asked).collect())


def test_best_against_sorting():
    for n in (0, 3, 10, 11, 300):
        scores = R.integers(0, 12, n)
        want = [int(i) for i in np.lexsort((np.arange(n), -scores)) if scores[i] > 0][:10]
        assert sorted(search.best(scores, 10).tolist()) == sorted(want)


def test_impacts_of_huge_tables():
    lengths, counts = np.array([1, 10**9, 5]), np.array([1, 10**6, 5])
    want = [10**9 * c // (1000 * c + 8 * (25 + 75 * n * 10**11 // 10**13)) for c, n in zip(counts.tolist(), lengths.tolist())]
    assert search.impacts(counts, lengths, 10**11, 10**13).tolist() == want


@pytest.mark.parametrize("size, least, most", [(1 << 15, 8, 32), (40, 1, 32), (7, 1, 2)])
def test_divergence_against_sql(spark, folder, monkeypatch, size, least, most):
    monkeypatch.setattr(divergence, "SLICE", size)
    monkeypatch.setattr(divergence, "LEAST", least)
    monkeypatch.setattr(divergence, "MOST", most)
    _same(divergence.op12_divergence(spark, folder), _sql(folder, divergence.SQL))


def test_tournament_lets_all_meet_once():
    for n in (2, 4, 6, 32):
        met = Counter()
        for turn in range(n - 1):
            for b in range(n):
                o = divergence.opponent(b, n, turn)
                assert o != b and divergence.opponent(o, n, turn) == b
                met[min(b, o), max(b, o)] += 1
        assert len(met) == n * (n - 1) // 2 and set(met.values()) == {2}


def test_shares_are_exact():
    counts = [0, 1, 10**9, 10**13, 8 * 10**15]
    got = divergence.shares(np.array(counts), 8 * 10**15, 12345)
    assert got.tolist() == [1 + 10**9 * (c + 1) // (8 * 10**15 + 12345) for c in counts]


def test_vectors_come_back():
    at, counts = np.array([0, 3, 4, 9]), np.array([5, 1, 10**12, 2])
    assert divergence.unpack(divergence.pack(at, counts), 11).tolist() == [5, 0, 0, 1, 10**12, 0, 0, 0, 0, 2, 0]


def _linked(docs):
    """For each row its set's size and its component's smallest id."""
    sets = []
    for d in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[1] or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    out = []
    for i, d in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root[j] == root[i] and docs[j][0] is not None]
        least = min(ids, default=None)
        out.append((d[0], len(sets[i]), least, d[0] == least))
    return out


@pytest.mark.parametrize("window", [32, 4])
def test_minhash_against_brute_force(spark, folder, monkeypatch, window):
    monkeypatch.setattr(minhash, "WINDOW", window)
    rows = minhash.op13_minhash(spark, folder).collect()
    assert Counter(map(tuple, rows)) == Counter(_linked(DOCS))


def test_minhash_in_groups_beyond_windows(spark, tmp_path, monkeypatch):
    """Copies that are similar to their original only: in one group that has most copies, in the other one of the rest has."""
    monkeypatch.setattr(minhash, "WINDOW", 2)
    monkeypatch.setattr(minhash, "BLOCK", 16, raising=False)
    r = np.random.default_rng(5)
    texts = []
    for most in (0, 1):
        base = [f"g{most}x{i}" for i in range(200)]
        group = [base]
        for i in range(100):
            w = list(base)
            for k in r.choice(48, 5, replace=False):
                w[4 * k + 5] = f"n{i}y{k}"
            group.append(w)
        texts += [" ".join(w) for w in group + [group[most]] * 3]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = _linked(rows)
    assert [sum(x[2] == i for x in want) for i in (0, 104)] == [104, 104]
    assert sorted(map(tuple, minhash.op13_minhash(spark, str(tmp_path)).collect())) == sorted(want)


def test_neighbours_across_partitions(spark):
    """With a row in each partition every pair is met across their bounds."""
    label = bytes(range(96))
    rows = [(1, label, i, i) for i in range(6)] + [(2, label, i, i) for i in range(6, 9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        made = []
        near = minhash.candidates(spark.createDataFrame(rows, "key long, label binary, id long, comp long"), True, made).collect()
        every = minhash.candidates(spark.createDataFrame(rows, "key long, label binary, id long, comp long"), False, made).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pairs = {(a, b) for g in (range(6), range(6, 9)) for a in g for b in g if a > b}
    assert {tuple(r) for r in every} == pairs
    roots = {i: i for i in range(9)}
    for a, b in sorted(map(tuple, near)):
        roots[a] = roots[b]
    assert {tuple(r) for r in near} <= pairs and len(near) >= 7


def test_bounds_add_pairs_of_different_partitions_only(spark):
    """A region over many partitions: each pair of neighbours comes out once, from its partition or from a bound."""
    label = bytes(minhash.SIZE)
    rows = [(7, label, i, i, i // 100) for i in range(400)]
    frame = spark.createDataFrame(rows, "key long, label binary, id long, comp long, part long").coalesce(1).sortWithinPartitions("id")
    kind = "a long, b long, key long, label binary, comp long, part long"
    found = [(x["a"], x["b"]) for x in frame.mapInPandas(minhash._neighbours(False, True), kind).collect()]
    want = [(a, b) for a in range(400) for b in range(max(0, a - minhash.WINDOW), a) if a // 100 != b // 100]
    assert sorted(found) == want


def test_estimate_is_near_the_similarity():
    for _ in range(20):
        text = _prose(200)
        a, b = minhash.shingle_set(text), minhash.shingle_set(_changed(text, 4))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = minhash.signatures([a, b])
        assert abs((x == y).mean() - true) < 0.2


@pytest.mark.parametrize("op", [search.op11_search, divergence.op12_divergence, minhash.op13_minhash])
def test_empty_tables(spark, empty, op):
    assert op(spark, empty).collect() == []


def test_search_without_items_or_documents(spark, folder, empty):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    assert search.rank_documents(docs, items.limit(0)).collect() == []
    assert search.rank_documents(docs.limit(0), items).collect() == []


@pytest.mark.parametrize("many, block, common", [(16, 2048, 16), (2, 8, 1)])
def test_no_similar_pair_is_lost(spark, monkeypatch, many, block, common):
    """Pairs of a similarity of 0.81 and of 0.79, a passage in many texts, and a group larger than a block; the small limits send nearly all through blocks."""
    monkeypatch.setattr(set_join, "MANY", many)
    monkeypatch.setattr(set_join, "BLOCK", block)
    monkeypatch.setattr(set_join, "COMMON", common)
    r = np.random.default_rng(7)
    words = lambda n: [f"x{i}" for i in r.integers(0, 1 << 40, n)]
    texts, passage = [], words(60)
    for i in range(200):
        w = words(100) if i % 4 else passage + words(40)
        v = list(w)
        for k in (70, 80) if i % 5 else (70, 80, 90):
            v[k] = "new"
        texts += [w, v]
    base = words(100)
    for i in range(60):
        v = list(base)
        v[i], v[99 - i] = words(2)
        texts.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    kept = {x["doc_id"] for x in simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(96)} for w in texts]
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert {i for i in range(400) if i not in kept} == {i + 1 for i in range(0, 400, 2) if similar(i, i + 1)}
    root = list(range(400, 460))
    for i in range(60):
        for j in range(i):
            if similar(400 + i, 400 + j):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert {x for x in kept if x >= 400} == set(root)


def test_meeting_keys_over_batches():
    import pyarrow as pa

    sizes, key, ids = [1, 5, 16, 17, 40, 2, 1, 90], [], []
    for k, n in enumerate(sizes):
        key += [k - 3] * n
        ids += range(100 * k, 100 * k + n)
    table = pa.table({"key": pa.array(key, pa.int64()), "id": pa.array(ids, pa.int64()), "n": pa.array([50] * len(key), pa.int32()), "pos": pa.array([1] * len(key), pa.int32())})
    for size in (1, 3, 7, 1000):
        got = pa.Table.from_batches(list(set_join._meet(table.to_batches(max_chunksize=size)))).to_pylist()
        pairs = [(x["a"], x["b"]) for x in got if x["key"] is None]
        assert sorted(pairs) == sorted((100 * k + a, 100 * k + b) for k, n in enumerate(sizes) if n <= set_join.MANY for a in range(n) for b in range(a))
        rows = [(x["key"], x["a"], x["b"]) for x in got if x["key"] is not None]
        assert rows == [(k - 3, 100 * k + a, 100 * k if a else None) for k, n in enumerate(sizes) if n > set_join.MANY for a in range(n)]


def test_long_texts_are_sifted(spark):
    """Sets of thousands of shingles with much and with little in common: none of the similar pairs is lost, and hardly any other is left to compare."""
    r = np.random.default_rng(4)
    sets, want, other = [], set(), set()
    for k, n in enumerate((3000, 4090, 4100, 9000) * 3):
        one = r.integers(0, 1 << 63, n, dtype=np.uint64)
        share = (0.95, 0.895, 0.4)[k % 3]
        two = np.concatenate((one[: int(share * n)], r.integers(0, 1 << 63, n - int(share * n), dtype=np.uint64)))
        (want if minhash.similar(np.unique(one), np.unique(two)) else other).add((2 * k, 2 * k + 1))
        sets += [one, two]
    a, b = np.unique(sets[0]), np.unique(sets[1])[:2500]
    assert set_join.apart(set_join.wide_parity(a), set_join.wide_parity(b)) <= len(np.setxor1d(a, b))
    rows = [(i, len(x), *map(int, set_join.parity(x)), set_join.wide_parity(x)) for i, x in enumerate(sets)]
    bits = spark.createDataFrame(rows, "id long, n int, p0 long, p1 long, p2 long, p3 long, wide binary")
    pairs = spark.createDataFrame(sorted(want | other), "a long, b long")
    got = {tuple(x) for x in set_join.sifted(bits, pairs).collect()}
    assert len(want) >= 4 and len(other) >= 4
    assert got == want


def test_wide_parities_at_once():
    """As one pair after the other, for sets whose parities differ in length."""
    from sparkweave.llm import sifting

    r = np.random.default_rng(6)
    wide = np.array([sifting.wide_parity(r.integers(0, 1 << 63, n, dtype=np.uint64), 4) for n in (1, 60, 64, 70, 500, 512, 530, 600)], object)
    i, j = (x.ravel() for x in np.meshgrid(range(8), range(8)))
    fit = [2 * min(a, b) >= max(a, b) for a, b in zip(map(len, wide[i]), map(len, wide[j]))]
    i, j = i[fit], j[fit]
    assert sifting.all_apart(wide, wide, i, j, {}).tolist() == [sifting.apart(wide[a], wide[b]) for a, b in zip(i, j)]
