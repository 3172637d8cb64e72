"""Filters for pairs of sets that may be similar, none of which loses a similar pair.

They go by the sets' lengths, and by parities: bits flipped by shingles, of which those that
differ are at most the shingles that are in one set only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least similarity, as a fraction.
SIMILAR = (80, 100)
#: Sets of a block that are compared with all others at once.
STRIPE = 128


def parity(codes: np.ndarray) -> np.ndarray:
    """256 bits, each flipped by the codes that fall on it, as four signed numbers."""
    bits = (np.bincount((codes & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def wide_parity(codes: np.ndarray, spread: int = 1) -> bytes:
    """As parity(), with `spread` bits for each code or more: a power of two, 256 at least. Halves folded together give fewer bits."""
    size = max(256, 1 << (spread * len(codes) - 1).bit_length())
    return np.packbits((np.bincount((codes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """How many bits of two wide parities differ, at the length of the shorter."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        x, y = (v[: len(v) // 2] ^ v[len(v) // 2 :] if len(v) > min(len(x), len(y)) else v for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _of_length(wide: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The wide parities of `size` bytes, and those of twice that folded, as rows; and the row of each."""
    found = [np.frombuffer(v, np.uint64) for v in wide if len(v) in (size, 2 * size)]
    there = np.array([len(v) in (size, 2 * size) for v in wide])
    return np.array([v if v.nbytes == size else v[: len(v) // 2] ^ v[len(v) // 2 :] for v in found]), np.cumsum(there) - 1


def all_apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, cache: dict) -> np.ndarray:
    """apart() of x[i] and y[j], of which none is more than twice as long as the other. The cache is for one x and y."""
    out = np.zeros(len(i), np.int64)
    if "lengths" not in cache:
        cache["lengths"] = tuple(np.array([len(v) for v in z], np.int64) for z in (x, y))
    least = np.minimum(cache["lengths"][0][i], cache["lengths"][1][j])
    for size in np.unique(least).tolist():
        if size not in cache:
            cache[size] = _of_length(x, size), _of_length(y, size)
        (one, row), (two, column) = cache[size]
        at, step = np.nonzero(least == size)[0], max(1, (1 << 22) // size)
        for s in range(0, len(at), step):
            k = at[s : s + step]
            out[k] = np.bitwise_count(one[row[i[k]]] ^ two[column[j[k]]]).sum(1, dtype=np.int64)
    return out


def may_be_similar(n, m, p, q):
    """The filters for sets of n and m shingles whose first common one is at p and q."""
    num, den = SIMILAR
    return (den * n >= num * m) & (den * m >= num * n) & ((num + den) * np.minimum(n - p, m - q) >= num * (n + m))


def compare_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of two blocks of one key, or within one, that are in different components and pass the filters; that by wide parity if there is one."""
    num, den = SIMILAR
    same = (pdf["i"] == pdf["j"]).to_numpy()
    one, two = (pdf, pdf) if same.all() else (pdf[(pdf["block"] == pdf["i"]).to_numpy()], pdf[(pdf["block"] == pdf["j"]).to_numpy()])
    x, y = ({c: d[c].to_numpy(np.int64) for c in ("id", "n", "pos", "comp", "p0", "p1", "p2", "p3")} for d in (one, two))
    a, b, cache = [x["id"][:0]], [x["id"][:0]], {}
    for s in range(0, len(one), STRIPE):
        z = {c: v[s : s + STRIPE, None] for c, v in x.items()}
        i, j = np.nonzero((z["comp"] != y["comp"]) & may_be_similar(z["n"], y["n"], z["pos"], y["pos"]))
        i += s
        far = sum(np.bitwise_count((x[p][i] ^ y[p][j]).view(np.uint64)).astype(np.int64) for p in ("p0", "p1", "p2", "p3"))
        ok = (num + den) * far <= (den - num) * (x["n"][i] + y["n"][j])
        i, j = i[ok], j[ok]
        if "wide" in pdf:
            far = all_apart(one["wide"].to_numpy(), two["wide"].to_numpy(), i, j, cache)
            ok = (num + den) * far <= (den - num) * (x["n"][i] + y["n"][j])
            i, j = i[ok], j[ok]
        a.append(x["id"][i])
        b.append(y["id"][j])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def _sift(batches):
    num, den = SIMILAR
    for pdf in batches:
        far = np.array([apart(x, y) for x, y in zip(pdf["wide_a"], pdf["wide_b"])], np.int64)
        yield pdf.loc[(num + den) * far <= (den - num) * (pdf["n_a"] + pdf["n_b"]).to_numpy(), ["a", "b"]]


def sifted(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b that pass the filters by length and by both parities. sets: id, n and parities."""
    num, den = SIMILAR
    x, y = (sets.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "p0", "p1", "p2", "p3"))) for k in "ab")
    far = sum((F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(1, 4)), F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    n, m = F.col("n_a").cast("long"), F.col("n_b").cast("long")
    near = pairs.join(x, "a").join(y, "b").filter((den * n >= num * m) & (den * m >= num * n) & ((num + den) * far <= (den - num) * (n + m))).select("a", "b", n.alias("n_a"), m.alias("n_b"))
    wide = lambda k: sets.select(F.col("id").alias(k), F.col("wide").alias(f"wide_{k}"))
    return near.join(wide("a"), "a").join(wide("b"), "b").mapInPandas(_sift, "a long, b long")
