"""Quality classifier on supervised subword embeddings.

A word's vector is the mean of the learned vectors of its features: the word itself and
its character n-grams, hashed into a fixed number of buckets. Pairs of adjacent words have vectors of their own in the same buckets. A document is the mean of its words' vectors
and of its pairs', half each (of a single word, its vector); a softmax over the classes follows. Embeddings and output weights are trained together by
stochastic gradient descent in numpy.

The model is fitted on a bounded sample of the labelled rows (`max_train` documents, those of the lowest
hash of their id); features are extracted on the executors. Scoring covers every row and whole texts. As the document's logit is
the mean of its words' and pairs' logits, each distinct word is evaluated once for each batch, and
what executors need of the model is one number for each bucket.

Null and empty texts have a zero vector: their score is the output's bias. Null ids count
as the empty id. Where an id has several labels, the mean decides (a tie counts as 1). Rows of
unknown label don't train. Without any usable label every score is 0.5. Repeated rows each
get a row. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entloom.llm.common import id_crc, lower_words_of

GRAMS = (3, 4, 5)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A number for each word, from its bytes between `<` and `>`."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lens.max()), _MULT))
        return np.add.reduceat(data * power[np.arange(len(data)) - np.repeat(starts, lens)], starts)


def pair_features(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The feature of each word with the next one, from the words' numbers in order."""
    with np.errstate(over="ignore"):
        return _mix(hashes[:-1] * _MULT + hashes[1:], 2, buckets)


def word_features(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, number of its word) for the words and their n-grams; `<` and `>` mark a word's ends."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lens)
    with np.errstate(over="ignore"):
        feats, owners = [_mix(word_hashes(words), 1, buckets)], [np.arange(len(words))]
        for n in GRAMS:
            if len(data) < n:
                continue
            m = len(data) - n + 1
            h = np.zeros(m, np.uint64)
            for k in range(n):
                h = h * _MULT + data[k : k + m]
            inside = owner[:m] == owner[n - 1 :]
            feats.append(_mix(h[inside], n, buckets))
            owners.append(owner[:m][inside])
    return np.concatenate(feats), np.concatenate(owners)


def document_features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's features and their weights, which sum to 1: each word's features share its count, and pairs of words have half of the whole."""
    words = lower_words_of(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    feats, owner = word_features(list(number), buckets)
    per = np.bincount(at) / np.bincount(owner, minlength=len(number)) / len(words)
    weights = per[owner]
    if len(words) > 1:
        pairs = pair_features(word_hashes(list(number))[at], buckets)
        feats, weights = np.concatenate((feats, pairs)), np.concatenate((weights / 2, np.full(len(pairs), 0.5 / len(pairs))))
    found, place = np.unique(feats, return_inverse=True)
    return found, np.bincount(place, weights=weights).astype(np.float32)


class Model:
    """Embeddings (buckets x dim), output weights (dim x classes) and bias."""

    def __init__(self, buckets: int, dim: int, classes: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)
        self.rng = rng

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def forward(self, idx: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of documents of `n` features each, and their class probabilities."""
        x = np.zeros((len(n), self.emb.shape[1]), np.float32)
        if len(idx):
            full = n > 0
            x[full] = np.add.reduceat(self.emb[idx] * w[:, None], (np.cumsum(n) - n)[full])
        return x, self.softmax(x @ self.out + self.bias)

    def gradients(self, idx: np.ndarray, w: np.ndarray, n: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean log loss: by output weights, by bias and by each document's vector (its features' share is their weight)."""
        x, p = self.forward(idx, w, n)
        p[np.arange(len(n)), labels] -= 1
        p /= len(n)
        return x.T @ p, p.sum(0), p @ self.out.T

    def fit(self, feats: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, epochs: int = 4, rate: float = 4.0, batch: int = 16, decay: float = 1e-3, clip: float = 1.0) -> None:
        """SGD with a linearly falling rate, decay of the output weights and of the embeddings touched, and steps whose norm is held to `clip`.

        A document's step is spread over its features in proportion to their weights and scaled by the sum of their squares, so that
        its own vector moves alike however many it has. The rate is that of a minibatch's mean gradient: documents that share features don't add up beyond it.
        """
        if not len(labels):
            return
        steps, done = epochs * len(labels), 0
        norm = np.array([float((w * w).sum()) or 1.0 for w in weights], np.float32)

        def held(g: np.ndarray) -> np.ndarray:
            return g * min(1.0, clip / max(float(np.sqrt((g * g).sum())), 1e-12))

        for _ in range(epochs):
            order = self.rng.permutation(len(labels))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                lr = np.float32(rate * (1 - done / steps))
                done += len(part)
                n = np.array([len(feats[i]) for i in part])
                seg = np.repeat(np.arange(len(part)), n)
                idx, w = np.concatenate([feats[i] for i in part]), np.concatenate([weights[i] for i in part])
                out, bias, back = self.gradients(idx, w, n, labels[part])
                self.out -= lr * (held(out) + np.float32(decay) * self.out)
                self.bias -= lr * 0.1 * held(bias)
                if len(idx):
                    back = held(back)
                    self.emb[idx] *= 1 - lr * np.float32(decay)
                    np.subtract.at(self.emb, idx, lr * (w / norm[part][seg])[:, None] * back[seg])
        if not (np.isfinite(self.out).all() and np.isfinite(self.bias).all() and np.isfinite(self.emb).all()):
            raise FloatingPointError("training diverged: weights are not finite")

    def logits(self) -> tuple[np.ndarray, float]:
        """For two classes: each bucket's share in the log odds of class 1, and the bias."""
        return (self.emb @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", *, folds: int = 5, held: int = 0, max_train: int = 4000, buckets: int = 1 << 18, dim: int = 8, epochs: int = 4) -> Model:
    """Fit on at most `max_train` labelled rows whose crc32(doc_id as text) mod `folds` is not `held`."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    # Which rows train is settled on ids alone; only their texts are read.
    chosen = known.where(id_crc(F.col("doc_id")) % folds != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # A repeated id trains once, by its first text.
    rows = rows.groupBy("doc_id", "__label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            got = [document_features(t.as_py(), buckets) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f.tobytes() for f, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())], names=["doc_id", "label", "f", "w"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {id_type}, label int, f binary, w binary").toArrow().sort_by("doc_id")
    model = Model(buckets, dim)
    model.fit([np.frombuffer(x, np.int32) for x in found.column("f").to_pylist()], [np.frombuffer(x, np.float32) for x in found.column("w").to_pylist()], np.array(found.column("label").to_pylist(), dtype=np.int64), epochs)
    return model


def score(docs: DataFrame, model: Model, *, folds: int = 5, held: int = 0, threshold: float = 0.3, memory_words: int = 400_000) -> DataFrame:
    """doc_id, held_out, score (probability of class 1) and predicted for every row. No shuffle."""
    share, bias = model.logits()
    buckets = len(share)
    shared = docs.sparkSession.sparkContext.broadcast((share.tobytes(), bias))

    def run(batches: Iterator[pa.RecordBatch]):
        raw, b0 = shared.value
        part = np.frombuffer(raw, np.float32)
        known: dict[bytes, int] = {}
        means, hashes = np.zeros(0), np.zeros(0, np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                texts = [lower_words_of(t.as_py()) for t in piece.column(2)]
                if len(known) > memory_words:
                    known.clear()
                    means, hashes = means[:0], hashes[:0]
                new = list(set(chain.from_iterable(texts)).difference(known))
                if new:
                    feats, owner = word_features(new, buckets)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    means = np.concatenate((means, np.bincount(owner, weights=part[feats], minlength=len(new)) / np.bincount(owner, minlength=len(new))))
                    hashes = np.concatenate((hashes, word_hashes(new)))
                z = np.full(len(texts), b0)
                for k, words in enumerate(texts):
                    if words:
                        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                        mean = means[at].mean()
                        z[k] += (mean + part[pair_features(hashes[at], buckets)].mean(dtype=np.float64)) / 2 if len(words) > 1 else mean
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["doc_id", "held_out", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", (id_crc(F.col("doc_id")) % folds == held).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
