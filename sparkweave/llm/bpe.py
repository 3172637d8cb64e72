"""Operator 5, byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text picks chunk ends, at any character, so that
passages shared by documents give the same chunks wherever they stand; a chunk has
LEAST to MOST bytes. The hashes of all chunks are counted; a bit map of fixed size
(SKETCH_BITS) tells each task which chunks may occur again (with more than some
10^7 shared chunks more and more of the others are taken for shared, which costs
time and changes nothing else). Texts without such chunks are done at once. Of the
others, chunks that occur once are encoded in place, and each shared chunk is encoded
once for the whole table and joined back by its 128-bit hash. Around each seam the
text is encoded again from the last place before it to the first one after it where
words part in any case (PARTS); there the ids agree exactly with those of the chunks,
so the ids are those of the whole text. The decoded bytes are compared with the
text's own digest, and a difference is an error.

Null texts count as empty: no tokens, and the decoded text is empty. Texts with runs
of LONG_RUN and more characters that the pattern takes for one piece, which its engine
cannot bear at any length, are encoded whole by the tokenizers library. The result
has one row for each input row, repeated rows and ids included; an empty table gives
an empty result; other columns are not touched. The vocabulary file is read by the
driver and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

#: Bytes under the rolling hash, and the bits of it that are zero where a chunk ends.
WINDOW = 32
END_BITS = 9
LEAST, MOST = 64, 8192
SKETCH_BITS = 26
ROW_BITS = 15  # of one row of the bit map, as Spark's bitmap functions have it
LONG_RUN = 100_000
#: A chunk is hot from so many occurrences on, or from a thousandth of all, and meets its tokens in SALTS tasks.
HOT, SALTS = 4096, 64
#: Characters of texts whose results a task gives on together.
GIVEN = 1 << 22

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Between these characters words part under the pattern, whatever stands around them: visible ones before white space, and changes between letters, digits and marks, but for the apostrophe before letters. Only characters are named whose kind is beyond doubt.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3"
_MARKS = r"!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
PARTS = re.compile(rf"(?<=[{_LETTERS}0-9'{_MARKS}])(?=[\x20\x09-\x0D])|(?<=[{_LETTERS}])(?=[0-9'{_MARKS}])|(?<=[0-9])(?=[{_LETTERS}'{_MARKS}])|(?<=[{_MARKS}])(?=[{_LETTERS}0-9])|(?<=')(?=[0-9])")
RUNS = regex.compile(r"\s+|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")


def has_long_run(text: str) -> bool:
    """Whether LONG_RUN characters of one kind stand together. A pattern with so many repeats would take over 100 MB."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in RUNS.finditer(text))


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, file: bytes):
        self.file, self.library = file, None
        spec = json.loads(file)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without a normalizer or prefix space is needed")
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take more than their own text are not provided for")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = _alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # The engine merges by the number of the outcome, the file by the place in its list.
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        numbers = [spec["model"]["vocab"][a + b] for a, b in merges]
        if numbers != sorted(numbers) or len(numbers) + 256 != len(ranks):
            raise ValueError("the order of merges differs from that of the vocabulary")
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.special = special
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32

    def encode(self, text: str) -> list[int]:
        if has_long_run(text):
            return self._by_library(text)
        if not self.splits or not any(s in text for s in self.special):
            return self.engine.encode_ordinary(text)
        out = []
        for part in self.splits.split(text):
            out += [self.special[part]] if part in self.special else self.engine.encode_ordinary(part)
        return out

    def _by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file.decode())
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def unpack(self, data: bytes) -> list[int]:
        return np.frombuffer(data, self.kind).tolist()

    def joined(self, parts: list[list[int]]) -> list[int]:
        """The ids of the whole text from those of its chunks."""
        texts = [self.decode(p).decode() for p in parts]
        text, begins = "".join(texts), [0, *itertools.accumulate(map(len, texts))]
        if any(s in text for s in self.special):
            return self.encode(text)
        windows: list[tuple[int, int]] = []
        for seam in begins[1:-1]:
            if windows and seam < windows[-1][1]:
                continue
            low, high = _before(text, seam), _after(text, seam)
            if windows and low < windows[-1][1]:
                low = windows.pop()[0]
            if low < high:
                windows.append((low, high))
        out: list[int] = []
        at, k = 0, 0
        for low, high in [*windows, (len(text), len(text))]:
            while at < low:
                while begins[k + 1] <= at:
                    k += 1
                end = min(low, begins[k + 1])
                first, last = (self._index(parts[k], texts[k], x - begins[k]) for x in (at, end))
                out += parts[k][first:last]
                at = end
            if low < high:
                out += self.encode(text[low:high])
                at = high
        return out

    def _index(self, ids: list[int], text: str, at: int) -> int:
        """Which of the ids of a text begins at a character."""
        if at in (0, len(text)):
            return len(ids) if at else 0
        return int(np.searchsorted(np.cumsum(self.sizes[ids]), len(text[:at].encode()), side="right"))


def _before(text: str, at: int) -> int:
    """The last place up to `at` where words part in any case, or the begin of the text."""
    width = 64
    while True:
        begin = max(0, at - width)
        found = [m.start() for m in PARTS.finditer(text, begin, min(len(text), at + 1))]
        if found or not begin:
            return found[-1] if found else 0
        width *= 4


def _after(text: str, at: int) -> int:
    found = PARTS.search(text, at)
    return found.start() if found else len(text)


@lru_cache(2)
def codec(file: bytes) -> Codec:
    return Codec(file)


def chunk_ends(data: bytes) -> list[int]:
    """Where chunks end: before a character, if the hash of the WINDOW bytes before it has END_BITS zeros and the chunk has LEAST bytes, or MOST bytes at most. The last is the end of the text."""
    b = np.frombuffer(data, np.uint8)
    out: list[int] = []
    last = 0

    def upto(end):
        nonlocal last
        while end - last > MOST:
            last += MOST
            while b[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)

    if len(b) > WINDOW:
        h, k = b.astype(np.uint32) * np.uint32(2654435761), 0x01000193
        step = 1
        while step < WINDOW:  # h[i] covers the `step` bytes from i on
            h = h[:-step] * np.uint32(k) + h[step:]
            k, step = k * k & 0xFFFFFFFF, step * 2
        h = h[:-1]
        h = h ^ h >> np.uint32(15)
        found = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - END_BITS) == 0) & (b[WINDOW:] & 0xC0 != 0x80)
        for end in (np.nonzero(found)[0] + WINDOW).tolist():
            upto(end)
            if end - last >= LEAST:
                out.append(end)
                last = end
    upto(len(b))
    return [*out, len(b)] if len(b) else []


def chunks(data: bytes) -> list[bytes]:
    begin, out = 0, []
    for end in chunk_ends(data):
        out.append(data[begin:end])
        begin = end
    return out


def _hashes(batches):
    for pdf in batches:
        own = [xxhash.xxh3_128_intdigest(c) & (1 << 63) - 1 for t in pdf["text"] if t for c in chunks(t.encode())]
        yield pd.DataFrame({"hash": np.array(own, np.int64)})


def shared_chunks(texts: DataFrame) -> np.ndarray:
    """The bit map of the chunks that occur more than once in the column text: 2 ** SKETCH_BITS bits, however large the table."""
    slot = F.col("hash") % (1 << SKETCH_BITS)
    twice = texts.select("text").mapInPandas(_hashes, "hash long").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select(slot.alias("slot"))
    rows = twice.groupBy(F.shiftright("slot", ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("bits")).collect()
    out = np.zeros((1 << SKETCH_BITS - ROW_BITS, (1 << ROW_BITS) // 8), np.uint8)
    for r in rows:
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _result(c: Codec, ids: list[int], digest: str, want: str) -> tuple:
    decoded = c.decode(ids)
    if hashlib.sha256(decoded).hexdigest() != digest:
        raise ValueError("the decoded text differs from the text")
    if want == "digests":
        return len(ids), hashlib.sha256(",".join([c.text_of[i] for i in ids]).encode()).hexdigest(), digest
    # As numbers of four bytes, not as objects.
    return np.asarray(ids, np.int32), decoded.decode("utf-8")


WANTS = {"digests": ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"], "ids": ["ids array<int>", "decoded string"]}


def _split(file, sketch, keys: list[str], want: str):
    """Rows of texts done, and of the chunks of all others."""
    names = [w.split()[0] for w in WANTS[want]]

    def run(batches):
        c, bits = codec(file.value), sketch.value
        part, count = TaskContext.get().partitionId(), 0
        columns = [*keys, *names, "row_id", "i", "digest", "hash", "bytes", "ids_"]
        for pdf in batches:
            out, size = [], 0
            for row in pdf.itertuples(index=False):
                key, text = row[:-1], row[-1] or ""
                size += len(text)
                if size > GIVEN:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], len(text)
                data = text.encode()
                digest = hashlib.sha256(data).hexdigest()
                found = chunks(data)
                hashes = [xxhash.xxh3_128_digest(x) for x in found]
                slots = [int.from_bytes(h, "big") & (1 << SKETCH_BITS) - 1 for h in hashes]
                again = [bits[s >> 3] >> (s & 7) & 1 for s in slots]
                if not any(again):
                    ids = c.encode(text)
                    out.append((*key, *_result(c, ids, digest, want), None, None, None, None, None, None))
                    continue
                row_id, count = part << 40 | count, count + 1
                for i, (x, h, a) in enumerate(zip(found, hashes, again)):
                    out.append((*key, *[None] * len(names), row_id, i, digest, h if a else None, x if a else None, None if a else c.pack(c.encode(x.decode()))))
            yield pd.DataFrame(out, columns=columns)

    return run


def encode_documents(docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), want: str = "ids") -> DataFrame:
    """The columns `keys` with ids and the decoded text (want="ids"), or with n_tokens, ids_sha256 and decoded_sha256 (want="digests")."""
    spark = docs.sparkSession
    own = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col(text).alias("text"))
    with open(path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    sketch = spark.sparkContext.broadcast(shared_chunks(rows))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    parts = cut(rows.mapInPandas(_split(file, sketch, own, want), ", ".join([*types, *WANTS[want], "row_id long, i int, digest string, hash binary, bytes binary, ids_ binary"])), "chunks")

    def once(data: pd.Series) -> pd.Series:
        c = codec(file.value)
        return pd.Series([c.pack(c.encode(x.decode())) for x in data])

    def whole(digest: pd.Series, found: pd.Series) -> pd.DataFrame:
        c = codec(file.value)
        out = []
        for d, f in zip(digest, found):
            out.append(_result(c, c.joined([c.unpack(p["ids"]) for p in sorted(f, key=lambda p: p["i"])]), d, want))
        return pd.DataFrame(out, columns=[w.split()[0] for w in WANTS[want]])

    names = [w.split()[0] for w in WANTS[want]]
    done = parts.filter("row_id IS NULL").select(*own, *names)
    shared = parts.filter("hash IS NOT NULL")
    known = shared.groupBy("hash").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n")).select("hash", "n", F.pandas_udf(once, "binary")("bytes").alias("ids"))
    known = cut(known, "known")
    # A chunk with more than a thousandth of all occurrences is hot, so that there are at most a thousand.
    is_hot = F.col("n") > max(HOT, (known.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(known.filter(is_hot).select("hash", F.lit(True).alias("hot")))
    place = ["row_id", "i", "digest", *own]
    salt = F.when(F.col("hot"), F.pmod(F.hash("row_id", "i"), F.lit(SALTS))).otherwise(0).alias("salt")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = shared.select("hash", *place).join(hot, "hash", "left").select("hash", *place, salt)
    joined = salted.join(known.select("hash", "ids", F.explode(salts).alias("salt")), ["hash", "salt"]).select(*place, "ids")
    every = joined.unionByName(parts.filter("ids_ IS NOT NULL").select(*place, F.col("ids_").alias("ids")))
    gathered = every.groupBy("row_id", "digest", *own).agg(F.collect_list(F.struct("i", "ids")).alias("found"))
    rest = gathered.withColumn("r", F.pandas_udf(whole, ", ".join(WANTS[want]))("digest", "found")).select(*own, *(F.col(f"r.{n}").alias(n) for n in names))
    return done.unionByName(rest).select(*(F.col(o).alias(k) for k, o in zip(keys, own)), *names)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), vocabulary(), want="digests")
