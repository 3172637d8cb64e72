"""Operator 10, toxicity by a bidirectional gated recurrent network.

A word enters as the sum of an embedding of the word and of embeddings of its
byte n-grams, both hashed. A gated recurrent network reads a window of words in
either direction, attention weighs the states, and a linear unit gives the
window's logit. Windows overlap by WINDOW - STRIDE words and together cover the
whole text; a text's score is the calibrated logit of its highest window.

The network is trained in numpy on the driver, on at most TOXIC and CLEAN labelled
documents, chosen by a hash of the id, and WINDOWS windows of each, spread over its
length. A quarter of them, with CALIBRATED windows each, is kept for the calibration.
Scoring covers all rows and whole texts.

Null, empty and white-space texts have one empty window and get its score. If the
labels hold no or only one class, all scores are that class's rate (0 if none).
Several labels for one id count as the highest, and of several texts the first in
order is learned from. Texts of any length are scored in all their windows. Rows are scored one by one: repeated
rows give repeated results, an empty table an empty result. Other columns are not
touched, but input columns named score and predicted are replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

WINDOW, STRIDE = 64, 48
TOXIC, CLEAN, WINDOWS = 1200, 2400, 8
CALIBRATED = 64
EPOCHS, BATCH, RATE = 6, 128, 0.01
#: Few windows are gone through more often, until there are so many steps.
LEAST_STEPS = 400
WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 1 << 14, 1 << 15, (3, 4, 5)
DIM, HIDDEN, ATTEND = 8, 8, 8
#: Words a task remembers, and how many words it scores at once.
REMEMBERED, AT_ONCE = 200_000, 150_000
EDGE = ".,;:!?\"'()[]{}|*#$%&<>"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(n: int) -> list[int]:
    """Where the windows of n words begin; together they cover all."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its bucket; for each place in all words the buckets of the n-grams that begin there (0: none); where each word begins."""
    data = [b"\x01" + (w.strip(EDGE) or w).encode("utf-8", "surrogatepass") + b"\x02" for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    b = np.frombuffer(b"".join(data) + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    total = int(ends[-1])
    left = np.repeat(ends, sizes) - np.arange(total)
    h = np.zeros(total, np.uint64)
    grams = np.zeros((total, len(GRAMS)), np.int64)
    for k in range(max(GRAMS)):
        h = (h ^ b[k : k + total]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in GRAMS:
            grams[:, GRAMS.index(k + 1)] = np.where(left > k, (h % np.uint64(GRAM_BUCKETS - 1)).astype(np.int64) + 1, 0)
    place = np.arange(total) - np.repeat(starts, sizes)
    mixed = (b[:total] + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2654435761) + np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(31)
    word = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
    return ((word >> np.uint64(20)) % np.uint64(WORD_BUCKETS)).astype(np.int64), grams, starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def vectors(p: dict, found) -> np.ndarray:
    word, grams, starts = found
    by_place = sum(p["grams"][grams[:, k]] for k in range(grams.shape[1]))
    return p["words"][word] + np.add.reduceat(by_place, starts, axis=0)


def forward(p: dict, gates: list[np.ndarray], index: np.ndarray, there: np.ndarray, keep: bool = False):
    """Logits of windows. gates: for each direction the input parts by word; index, there: windows x WINDOW."""
    n, t = index.shape
    states, tape = np.zeros((t, n, 2 * HIDDEN), np.float32), []
    for d in range(2):
        u, h = p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
        for i in range(t) if d == 0 else range(t - 1, -1, -1):
            x, own = gates[d][index[:, i]], h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            m = there[:, i, None]
            if keep:
                tape.append((d, i, h, z, r, new, own[:, 2 * HIDDEN :], m))
            h = np.where(m, new + z * (h - new), h)
            states[i, :, d * HIDDEN : (d + 1) * HIDDEN] = h
    a = np.tanh(states @ p["attend"] + p["attend_b"])
    s = np.where(there.T, a @ p["attend_v"], np.float32(-1e9))
    s = np.exp(s - s.max(0))
    s /= s.sum(0)
    pooled = (s[:, :, None] * states).sum(0) * there.any(1)[:, None]
    logits = pooled @ p["out"] + p["out_b"]
    return (logits, states, tape, a, s, pooled) if keep else logits


def _summed(size: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each number below size, the sum of the rows at it."""
    return np.stack([np.bincount(at, rows[:, k], size) for k in range(rows.shape[1])], 1).astype(rows.dtype)


def gradients(p: dict, found, index: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    x = vectors(p, found)
    gates = [x @ p[f"w{d}"] + p[f"b{d}"] for d in range(2)]
    logits, states, tape, a, s, pooled = forward(p, gates, index, there, True)
    dl = (sigmoid(logits) - y) * weight / len(y)
    g = {"out": pooled.T @ dl, "out_b": dl.sum(keepdims=True)}
    dp = dl[:, None] * p["out"] * there.any(1)[:, None]
    ds = s[:, :, None] * dp
    dw = (states * dp).sum(2)
    de = s * (dw - (s * dw).sum(0))
    g["attend_v"] = np.einsum("tn,tnk->k", de, a)
    da = de[:, :, None] * p["attend_v"] * (1 - a * a)
    g["attend"], g["attend_b"] = np.einsum("tnh,tnk->hk", states, da), da.sum((0, 1))
    ds = ds + da @ p["attend"].T
    dgates = []
    for d in range(2):
        moves = np.zeros((*index.T.shape, 3 * HIDDEN), x.dtype)
        g[f"u{d}"] = np.zeros_like(p[f"u{d}"])
        dh = np.zeros((len(y), HIDDEN), np.float32)
        for _, i, h, z, r, new, own, m in reversed([x for x in tape if x[0] == d]):
            dh = dh + ds[i, :, d * HIDDEN : (d + 1) * HIDDEN]
            on = np.where(m, dh, 0)
            dnew = on * (1 - z) * (1 - new * new)
            dz, dr = on * (h - new) * z * (1 - z), dnew * own * r * (1 - r)
            dx, down = np.concatenate((dz, dr, dnew), 1), np.concatenate((dz, dr, dnew * r), 1)
            moves[i] = dx
            g[f"u{d}"] += h.T @ down
            dh = np.where(m, dh * z, dh) + down @ p[f"u{d}"].T
        dgates.append(_summed(len(x), index.T.ravel(), moves.reshape(-1, 3 * HIDDEN)))
        g[f"w{d}"], g[f"b{d}"] = x.T @ dgates[d], dgates[d].sum(0)
    dx = dgates[0] @ p["w0"].T + dgates[1] @ p["w1"].T
    word, grams, starts = found
    g["words"] = _summed(WORD_BUCKETS, word, dx)
    by_place = np.repeat(dx, np.diff([*starts, len(grams)]), axis=0)
    g["grams"] = sum(_summed(GRAM_BUCKETS, grams[:, k], by_place) for k in range(grams.shape[1]))
    g["grams"][0] = 0
    return g


@dataclass
class Model:
    p: dict
    rate: float  # of the toxic, if there is nothing else to go by
    scale: float = 1.0
    shift: float = 0.0


def initial(seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    shapes = {"words": (WORD_BUCKETS, DIM), "grams": (GRAM_BUCKETS, DIM), "attend": (2 * HIDDEN, ATTEND), "attend_b": (ATTEND,), "attend_v": (ATTEND,), "out": (2 * HIDDEN,), "out_b": (1,)}
    for d in range(2):
        shapes |= {f"w{d}": (DIM, 3 * HIDDEN), f"u{d}": (HIDDEN, 3 * HIDDEN), f"b{d}": (3 * HIDDEN,)}
    p = {k: (r.normal(size=s) * (0.05 if k in ("words", "grams") else 0.3)).astype(np.float32) for k, s in shapes.items()}
    p["grams"][0] = 0
    return p


class Words:
    """Numbers the words met, and holds the input parts of each."""

    def __init__(self, p: dict):
        self.p, self.number, self.gates = p, {}, [np.zeros((1, 3 * HIDDEN), np.float32) for _ in range(2)]

    def index(self, lists: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self.__init__(self.p)
        new = list(dict.fromkeys(w for words in lists for w in words if w not in self.number))
        if new:
            at = len(self.number) + 1
            self.number.update((w, at + i) for i, w in enumerate(new))
            x = vectors(self.p, features(new))
            self.gates = [np.concatenate((g, x @ self.p[f"w{d}"] + self.p[f"b{d}"])) for d, g in enumerate(self.gates)]
        return [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in lists]


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    index = np.zeros((len(rows), WINDOW), np.int64)
    for i, r in enumerate(rows):
        index[i, : len(r)] = r
    return index, index > 0


def logits_of(p: dict, memory: Words, rows: list[np.ndarray]) -> np.ndarray:
    out = [forward(p, memory.gates, *_padded(rows[i : i + 1024])) for i in range(0, len(rows), 1024)]
    return np.concatenate(out)


def fit(texts: list[str], docs: list, y: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """texts: windows; docs: the document of each; y: the document's label."""
    y, docs = np.array(y, np.float32), np.array(docs)
    model = Model(initial(seed), float(y.mean()) if len(y) else 0.0)
    if not 0 < model.rate < 1:
        return model
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in tokens(t)[:WINDOW]], np.int64) for t in texts]
    names, r, p = np.array(list(number), object), np.random.default_rng(seed), model.p
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, use = 0, np.ones(len(rows), bool)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(rows) // BATCH)))
    for epoch in range(epochs):
        order = r.permutation(np.nonzero(use)[0])
        weight = np.where(y > 0, 0.5 / max(1, y[order].sum()), 0.5 / max(1, (1 - y[order]).sum())) * len(order)
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            met, inverse = np.unique(np.concatenate([rows[k] for k in own]) if sum(len(rows[k]) for k in own) else np.zeros(1, np.int64), return_inverse=True)
            at, local = 0, []
            for k in own:
                local.append(inverse[at : at + len(rows[k])] + 1)
                at += len(rows[k])
            index, there = _padded(local)
            g = gradients(p, features(list(names[met])), np.maximum(index - 1, 0), there, y[own], weight[own].astype(np.float32))
            step += 1
            rate = RATE * min(1, step / 20) * (0.2 if 3 * epoch >= 2 * epochs else 1)
            for k in p:
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] * g[k] - square[k])
                p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if epochs // 3 <= epoch < epochs - 1:  # windows of toxic documents that show nothing are not examples; the best one always is
            memory = Words(p)
            found = logits_of(p, memory, memory.index([tokens(t)[:WINDOW] for t in texts]))
            best: dict = {}
            for i, d in enumerate(docs):
                if d not in best or found[i] > found[best[d]]:
                    best[d] = i
            use = (y == 0) | (found > 0)
            use[list(best.values())] = True
    return model


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Fits scale and shift to the logits of documents that the network was not trained on, each class weighed as often as it occurs."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        return
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(y == 1, model.rate / n[1], (1 - model.rate) / n[0])
    x = np.stack(((logits - logits.mean()) / (logits.std() + 1e-9), np.ones(len(y))), 1)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (q - target)))
    model.scale = float(max(w[0], 0.05) / (logits.std() + 1e-9))
    model.shift = float(w[1] - model.scale * logits.mean())


def score_texts(model: Model, memory: Words, texts: list[str | None]) -> list[float]:
    if not 0 < model.rate < 1:
        return [model.rate] * len(texts)
    out: list[float] = []
    pending: list[list[str]] = []

    def flush():
        rows, owner = [], []
        for k, ids in enumerate(memory.index(pending)):
            begins = windows(len(ids))
            rows += [ids[b : b + WINDOW] for b in begins]
            owner += [k] * len(begins)
        top = np.full(len(pending), -np.inf)
        np.maximum.at(top, owner, logits_of(model.p, memory, rows))
        out.extend((1 / (1 + np.exp(-np.clip(model.scale * top + model.shift, -50, 50)))).tolist())
        pending.clear()

    held = 0
    for t in texts:
        pending.append(tokens(t))
        held += len(pending[-1])
        if held > AT_ONCE:
            flush()
            held = 0
    if pending:
        flush()
    return out


def _sampled(batches):
    for pdf in batches:
        rows = []
        for doc, text, y, held in zip(pdf["doc_id"], pdf["text"], pdf["toxic"], pdf["held"]):
            own = tokens(text)
            begins = windows(len(own))
            for k in np.unique(np.linspace(0, len(begins) - 1, min(len(begins), CALIBRATED if held else WINDOWS)).astype(int)):
                rows.append((doc, " ".join(own[begins[k] : begins[k] + WINDOW]), y, held))
        yield pd.DataFrame(rows, columns=["doc_id", "text", "toxic", "held"])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. At most toxic + clean documents are sent to the driver, in windows."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id", F.lit("toxicity"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = [known.filter(F.col("toxic") == v).orderBy(place, "doc_id").limit(n) for v, n in ((1, toxic), (0, clean))]
    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    found = chosen.withColumn("held", held).mapInPandas(_sampled, "doc_id long, text string, toxic int, held boolean").orderBy("doc_id", "text").toPandas()
    own = found[~found["held"]]
    model = fit(list(own["text"]), list(own["doc_id"]), list(own["toxic"]))
    model.rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    rest = found[found["held"]]
    if len(rest) and 0 < model.rate < 1:
        memory = Words(model.p)
        top = rest.assign(z=logits_of(model.p, memory, memory.index([tokens(t) for t in rest["text"]]))).groupby("doc_id").agg(z=("z", "max"), y=("toxic", "first"))
        calibrate(model, top["z"].to_numpy(float), top["y"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Words(sent.value.p)
        for texts in batches:
            yield pd.Series(score_texts(sent.value, memory, list(texts)), dtype="float64")

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    model = train(docs, labels.select("doc_id", "toxic"))
    return score(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")
