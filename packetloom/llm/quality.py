"""Quality scores: random-indexing word vectors pooled by document, a two-layer network, and a temperature for its probabilities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, texts, written

BUCKETS, DIM, NONZERO = 1 << 16, 48, 4
SHAPES = 512
#: Labelled rows that are learned from, at most; those with the lowest hash of doc_id.
FIT_ROWS = 4000
REMEMBERED = 300_000
#: Words whose contexts are added at once, about, and buckets in a row of sums.
WORDS_AT_ONCE, CHUNK = 200_000, 64
FOLDS = 5
#: From this score on, 1 is predicted.
THRESHOLD = 0.3


class Words(dict):
    """Buckets of a word's lower-case form and of its shape (letter cases and marks at its end)."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        core = word.strip("!?.,;:#$%&*|\"'()")
        tail = word[len(word.rstrip("!?.,;:#$%&*|\"'()")) :][:3]
        kind = "9" if any(c.isdigit() for c in core) else "" if not core else "A" if core.isupper() and len(core) > 1 else "Aa" if core[0].isupper() else "a" if core.isalpha() else "-"
        shape = zlib.crc32(f"{kind}{min(len(core), 12)}{tail}".encode("utf-8", "surrogatepass")) % SHAPES
        own = SHAPES + zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % (BUCKETS - SHAPES)
        n = self[word] = own << 12 | shape
        return n


_words = Words()


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    packed = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    return packed >> 12, packed & 4095


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random vectors, one a bucket: the places that are not zero, and -1 or 1 for each."""
    rng = np.random.default_rng(seed)
    return rng.random((BUCKETS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO], rng.choice(np.array((-1, 1)), (BUCKETS, NONZERO))


def context_sums(documents: list[list[str]], places: np.ndarray, signs: np.ndarray, out: np.ndarray, pairs: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the shape of the word and of the words beside it in its document, and counts pairs of shapes beside each
    other; out and pairs are flat."""
    own, shape = buckets([w for words in documents for w in words])
    beside = np.ones(len(own), bool)
    beside[np.cumsum(list(map(len, documents))) - 1] = False
    left = np.flatnonzero(beside[:-1])
    pairs += np.bincount(shape[left] * SHAPES + shape[left + 1], minlength=len(pairs))
    rows, others = np.concatenate((own[left], own[left + 1], own)), np.concatenate((own[left + 1], own[left], shape))
    for i in range(0, len(rows), 3 * WORDS_AT_ONCE):
        part = others[i : i + 3 * WORDS_AT_ONCE]
        out += np.bincount((rows[i : i + 3 * WORDS_AT_ONCE, None] * DIM + places[part]).ravel(), signs[part].ravel(), minlength=len(out))


def all_contexts(docs: DataFrame) -> np.ndarray:
    """Context sums by bucket over all documents with two words or more: one array a task, summed by ranges of buckets."""
    places, signs = index_vectors()

    def per_task(batches):
        out, pairs, held, n = np.zeros(BUCKETS * DIM), np.zeros(SHAPES * SHAPES, np.int64), [], 0
        for batch in batches:
            for text in texts(batch):
                if len(words := text.split()) > 1:
                    held.append(words)
                    n += len(words)
                if n >= WORDS_AT_ONCE:
                    context_sums(held, places, signs, out, pairs)
                    held, n = [], 0
        if held:
            context_sums(held, places, signs, out, pairs)
        index = np.zeros((SHAPES, DIM))
        np.put_along_axis(index, places[:SHAPES], signs[:SHAPES].astype(float), axis=1)
        counts = pairs.reshape(SHAPES, SHAPES)
        out[: SHAPES * DIM] += ((counts + counts.T) @ index).ravel()
        rows = out.astype(np.int32).reshape(-1, CHUNK * DIM)
        used = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(used), CHUNK):
            part = used[i : i + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([r.tobytes() for r in rows[part]], pa.binary())], names=["chunk", "sums"])

    def summed(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[chunk] = out.get(chunk, 0) + np.frombuffer(sums, np.int32).astype(np.int64)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["chunk", "sums"])

    total = np.zeros((BUCKETS // CHUNK, CHUNK * DIM), np.int64)
    for r in docs.select("text").mapInArrow(per_task, "chunk long, sums binary").repartition(16, "chunk").mapInArrow(summed, "chunk long, sums binary").toLocalIterator():
        total[r[0]] = np.frombuffer(r[1], np.int64)
    return total.reshape(BUCKETS, DIM)


def document_vector(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of words and of shapes, and a few ratios of the whole text; all zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(2 * DIM + 6, np.float32)
    own, shape = buckets(words)
    chars = sum(map(len, words))
    ratios = (np.log1p(n) / 10, len(set(words)) / n, chars / n / 10, sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, len(text.split("\n")) / n)
    pooled = np.bincount(own, minlength=BUCKETS) @ vectors if n > BUCKETS else vectors[own].sum(axis=0, dtype=np.float64)
    return np.concatenate((pooled / n, np.bincount(shape, minlength=SHAPES) @ vectors[:SHAPES] / n, ratios)).astype(np.float32)


class TwoLayers:
    """tanh layer and logistic output, fitted with Adam; the temperature is fitted on rows held back."""

    def __init__(self, hidden: int = 24, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 5):
        self.hidden, self.steps, self.rate, self.decay, self.seed, self.temperature = hidden, steps, rate, decay, seed, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> TwoLayers:
        rng = np.random.default_rng(self.seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        back = rng.random(len(x)) < 0.2 if len(x) >= 50 else np.zeros(len(x), bool)
        z, t = (x[~back] - self.mean) / self.std, y[~back]
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for step in range(1, self.steps + 1):
            h = np.tanh(z @ self.w[0] + self.w[1])
            p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])))
            d = (p - t) / max(1, len(t))
            dh = np.outer(d, self.w[2]) * (1 - h * h)
            for i, g in enumerate((z.T @ dh + self.decay * self.w[0], dh.sum(axis=0), h.T @ d + self.decay * self.w[2], d.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - self.rate * m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if back.any():
            raw, own = self.raw(x[back]), y[back]
            loss = lambda temperature: np.logaddexp(0, np.where(own > 0, -raw, raw) / temperature).mean()
            self.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.std, -8, 8) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[np.ndarray, TwoLayers | None]:
    """Word vectors from all documents, and the network from the labelled rows that are not held out. Context sums and document vectors are made on the
    executors."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = own.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most).drop("h")
    sample = written(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").repartition(8), "quality-sample")
    places, signs = index_vectors()
    sums = all_contexts(docs)
    vectors = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    vectors[np.arange(BUCKETS)[:, None], places] += signs

    def pool(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "quality": batch.column(batch.schema.get_field_index("quality")).cast(pa.int64()), "x": [document_vector(t, vectors).astype(float).tolist() for t in texts(batch)]}

    rows = in_batches(sample, pool, "doc_id long, quality long, x array<double>").orderBy("doc_id").collect()
    if not rows:
        return vectors, None
    return vectors, TwoLayers().fit(np.array([r.x for r in rows]), np.array([float(r.quality > 0) for r in rows]))


def score(docs: DataFrame, vectors: np.ndarray, network: TwoLayers | None) -> DataFrame:
    """doc_id and score of every document. Null text is empty; without labels every score is 0.5."""

    def run(batch: pa.RecordBatch) -> dict:
        own = texts(batch)
        p = network.probability(np.array([document_vector(t, vectors) for t in own])) if network else np.full(len(own), 0.5)
        return {"doc_id": batch.column(0), "score": np.round(p, 6)}

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs, *fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
