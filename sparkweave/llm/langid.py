"""Operator 8, language identification by prediction by partial matching.

Each language has a tree of byte contexts of every order from ORDER down to 0, below
the uniform order -1, over all 256 bytes. A symbol not seen in a context costs an
escape (method C, with exclusion of the symbols seen there) and is looked up in the
next shorter context; a context never seen costs nothing and is passed over. The
trees are frozen after training and written out as the exact code length of every
symbol seen after every context, and the cost of the escape from every context, one
column for each language. A text's score under a language is the sum over its bytes.

The trees hold what a bounded sample has (DOCS_PER_LANGUAGE), whatever the table's
size. Null texts and texts without a letter (Unicode categories Ll, Lm, Lo, Lt, Lu)
get `und` and score 0, as do all texts where nothing could be learned. Ties go to the
first language in byte order. Long texts are scored in pieces, each with the bytes
before it as context, so that the sum is that of the whole text. Rows are scored one
by one: repeated rows give repeated results, an empty table gives an empty result,
other columns stay as they are, and input columns named lang_pred or score are
replaced.
"""

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, unused

WORDLIKE = re.compile(r"[^\W\d_]")
#: The longest context, in bytes; 6 at most, so that a context and its symbol fit into a number.
ORDER = 4
#: Training takes about this many documents of each language, chosen by a hash of the id; scoring covers all.
DOCS_PER_LANGUAGE = 1500
PAD = b"\n" * ORDER
#: Bytes that are scored at once.
PIECE = 1 << 18
UNIFORM = 8.0


def has_letter(text: str) -> bool:
    """The pattern also finds numbers such as \u00bd, which are no letters."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Table:
    """Numbers of byte strings of one length, found by open addressing."""

    keys: np.ndarray  # uint64, slots
    numbers: np.ndarray  # int32, slots; -1 where free

    @staticmethod
    def of(codes: np.ndarray) -> "Table":
        size = 1 << max(4, (2 * len(codes)).bit_length())
        keys, numbers = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, step = np.arange(len(codes)), 0
        while len(todo):
            at = _slot(codes[todo], size, step)
            free = numbers[at] < 0
            numbers[at[free]], keys[at[free]] = todo[free], codes[todo[free]]  # of several, the last one stays
            todo, step = todo[numbers[at] != todo], step + 1
        return Table(keys, numbers)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code, -1 if it is not there."""
        out, todo, step = np.full(len(codes), -1, np.int32), None, 0
        while True:
            own = codes if todo is None else codes[todo]
            at = _slot(own, len(self.keys), step)
            found = self.numbers[at]
            hit = (self.keys[at] == own) & (found >= 0)
            if todo is None:
                out[hit] = found[hit]
                todo = np.nonzero(~hit & (found >= 0))[0]
            else:
                out[todo[hit]] = found[hit]
                todo = todo[~hit & (found >= 0)]
            if not len(todo):
                return out
            step += 1


def _slot(codes: np.ndarray, size: int, step: int) -> np.ndarray:
    h = (codes ^ (codes >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
    return (((h >> np.uint64(32)) + np.uint64(step)) & np.uint64(size - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: list[np.ndarray]  # the strings of 1, 2, ... ORDER + 1 bytes: a context and its symbol
    bits: list[np.ndarray]  # for each of them the code length of its last byte, (strings + 1) x languages
    escapes: list[np.ndarray]  # for each context of 0, 1, ... ORDER bytes the cost of the escape; those of 1 byte and more are numbered as strings, with a last row of zeros

    @cached_property
    def tables(self) -> list[Table]:
        """Made where they are used, so that they are not sent."""
        return [Table.of(x) for x in self.codes]


def _codes(b: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes up to and with each place in ends, as numbers."""
    out = b[ends].astype(np.uint64)
    for k in range(1, size):
        out |= b[ends - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _pieces(texts: list[str]):
    """Yields (owners, bytes, places): pieces of about PIECE bytes in all, each after the ORDER bytes before it, the text that each belongs to, and where the bytes of the pieces stand, without those before."""
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        data = PAD + _bytes(text)
        for at in range(ORDER, len(data), PIECE):
            parts.append(data[at - ORDER : at + PIECE])
            owners.append(i)
            held += len(parts[-1])
            if held >= PIECE:
                yield _joined(owners, parts)
                parts, owners, held = [], [], 0
    if parts:
        yield _joined(owners, parts)


def _joined(owners: list[int], parts: list[bytes]):
    b = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    inside = np.ones(len(b), bool)
    inside[((np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER)).ravel()] = False
    return np.repeat(owners, sizes - ORDER), b, np.nonzero(inside)[0]


def _count(batches):
    """How often each string of ORDER + 1 bytes occurs in each language."""
    for pdf in batches:
        for lang, own in pdf.groupby("lang"):
            for _, b, ends in _pieces(list(own["text"])):
                codes, n = np.unique(_codes(b, ends, ORDER + 1), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n.astype(np.int64)})


def _tree(codes: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """One language: for each order its strings (sorted) with their code lengths, and its contexts (sorted) with their escapes."""
    strings, contexts = [], []
    for k in range(ORDER + 1):
        own, inverse = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(inverse, counts)
        ctx, at = np.unique(own >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(at, n), np.bincount(at)
        # What the shorter context gives to the symbols seen here is taken out of it, and the rest is scaled up to one.
        if k:
            before = np.exp2(-strings[-1][1])[np.searchsorted(strings[-1][0], own & np.uint64((1 << 8 * k) - 1))]
        else:
            before = np.full(len(own), 2.0**-UNIFORM)
        left = np.maximum(1 - np.bincount(at, before), 0)
        left[distinct == 256] = 0
        escaping = np.where(left > 0, distinct, 0)
        strings.append((own, -np.log2(n / (total + escaping)[at])))
        with np.errstate(divide="ignore", invalid="ignore"):
            contexts.append((ctx, np.where(left > 0, np.log2(left) - np.log2(distinct / (total + distinct)), 0.0)))
    return strings, contexts


def build(languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """counted: for each language the strings of ORDER + 1 bytes, as numbers, and how often each occurs."""
    trees = [_tree(*c) for c in counted]
    bits, escapes, every = [], [], []
    for k in range(ORDER + 1):
        # What stands before texts is a context, and so a string, in any case.
        codes = np.unique(np.concatenate([_codes(np.frombuffer(PAD + b"\n", np.uint8), np.array([ORDER]), k + 1), *(strings[k][0] for strings, _ in trees)]))
        own = np.zeros((len(every[-1]) if k else 1, len(languages)), np.float32)
        for j, (_, contexts) in enumerate(trees):
            own[np.searchsorted(every[-1], contexts[k][0]) if k else slice(None), j] = contexts[k][1]
        full = np.full((len(codes), len(languages)), UNIFORM, np.float32)
        if k:
            full = bits[-1][np.searchsorted(every[-1], codes & np.uint64((1 << 8 * k) - 1))].copy()
        full += own[np.searchsorted(every[-1], codes >> np.uint64(8))] if k else own
        for j, (strings, _) in enumerate(trees):
            full[np.searchsorted(codes, strings[k][0]), j] = strings[k][1]
        every.append(codes)
        bits.append(full)
        escapes.append(own)
    # A row of zeros at the end is what the number -1 of a missing string gives.
    zero = np.zeros((1, len(languages)), np.float32)
    return Model(languages, every, [np.concatenate((x, zero)) for x in bits], [escapes[0], *(np.concatenate((x, zero)) for x in escapes[1:])])


def _built(batches):
    """One row with the model of all counts, so that the driver holds nothing but its bytes. The counts are as many as the sample gives, whatever the table."""
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for pdf in batches:
        for lang, own in pdf.groupby("lang"):
            found.setdefault(lang, []).append((own["code"].to_numpy(np.int64).astype(np.uint64), own["n"].to_numpy(float)))
    languages = sorted(found, key=str.encode)
    # In one order, whatever the partitions.
    counted = []
    for lang in languages:
        codes, n = (np.concatenate(x) for x in zip(*found.pop(lang)))
        order = np.argsort(codes)
        counted.append((codes[order], n[order]))
    yield pd.DataFrame({"model": [pickle.dumps(build(languages, counted) if languages else NOTHING)]})


NOTHING = Model([], [], [], [])


def train_packed(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> bytes | bytearray:
    """docs: doc_id, text, lang of the rows to learn from; null and empty texts and null languages are passed over. Returns the model as identify() takes it."""
    known = docs.filter((F.col("text") != "") & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return pickle.dumps(NOTHING)
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, docs_per_language / n))))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 40)) / float(1 << 40)
    sample = known.filter(place < share[F.col("lang")]).select("lang", "text")
    counts = sample.mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.repartition(1).mapInPandas(_built, "model binary").collect()
    return found[0]["model"] if found else pickle.dumps(NOTHING)


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """As train_packed(), unpacked."""
    return pickle.loads(train_packed(docs, docs_per_language))


def byte_costs(model: Model, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of the bytes at ends under each language, each after the ORDER bytes before it."""
    codes = _codes(b, ends, ORDER + 1)
    found = model.tables[ORDER].find(codes)
    out = model.bits[ORDER].take(found, axis=0, mode="wrap")
    todo = np.nonzero(found < 0)[0]
    for k in range(ORDER, -1, -1):
        own = codes[todo]
        if k:
            context = model.tables[k - 1].find((own & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8))
            found = model.tables[k - 1].find(own & np.uint64((1 << 8 * k) - 1))
            out[todo] += model.escapes[k].take(context, axis=0, mode="wrap") + model.bits[k - 1].take(found, axis=0, mode="wrap")
            todo = todo[found < 0]
        else:
            out[todo] += model.escapes[0] + np.float32(UNIFORM)
        if not len(todo):
            break
    return out


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Bits of each whole text under each language."""
    total = np.zeros((len(texts), len(model.languages)))
    for owners, b, ends in _pieces(texts):
        first = np.nonzero(np.diff(owners, prepend=-1))[0]
        total[owners[first]] += np.add.reduceat(byte_costs(model, b, ends), first, axis=0, dtype=np.float64)
    return total


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """For each text the language of the shortest code, and its share of the probability."""
    asked = [i for i, t in enumerate(texts) if t is not None and model.languages and has_letter(t)]
    out = [("und", 0.0)] * len(texts)
    for i, total in zip(asked, code_lengths(model, [texts[i] for i in asked])):
        best = int(total.argmin())
        out[i] = model.languages[best], float(1 / np.exp2(np.maximum(total[best] - total, -1000)).sum())
    return out


def identify(docs: DataFrame, model: Model | bytes | bytearray, text: str = "text") -> DataFrame:
    """Adds lang_pred and score. The model may be packed."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model) if isinstance(model, Model) else model)
    (own,) = unused(docs, "scored")

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = pickle.loads(sent.value)
        for texts in batches:
            yield pd.DataFrame(predict(known, list(texts)), columns=["lang_pred", "score"])

    return docs.withColumn(own, scored(F.col(text))).withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_packed(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "lang_pred", "score")
