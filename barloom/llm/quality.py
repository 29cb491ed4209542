"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

A passage is PASSAGE bytes of the text; it is encoded by the frequencies of its byte-class bigrams and of
words that recur a few words later, then by a dense layer. Gated attention weighs the passages of a
document, learned from document labels alone, and the weighted representation is scored. Trained in numpy
on all passages of at most TRAIN_DOCS labelled documents (those whose keys hash lowest); every document is
scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, texts_of
from .textscan import Hasher, chunks, join, words

PASSAGE = 512
TRAIN_DOCS = 4000
THRESHOLD = 0.3
LAGS = (1, 2, 3, 4, 6, 8)
#: Byte classes with their bytes; other letters, punctuation and the bytes of longer characters by rule.
_CLASSES = {1: b" \t", 2: b"\n", 3: b"aeiou", 6: b"0123456789", 7: b".", 8: b",", 9: b"#*$%&|<>", 10: b"!?", 15: b"'\"()[]{}"}


def _table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[0x21:0x7F] = 11
    t[ord("a") : ord("z") + 1] = 4
    t[ord("A") : ord("Z") + 1] = 5
    for k, own in _CLASSES.items():
        for b in own:
            t[b] = k
    t[0x80:0xA0], t[0xA0:0xC0], t[0xC0:] = 13, 14, 12
    return t


_TABLE = _table()
DIM = 256 + len(LAGS) + 2


def passages(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages of each text); an empty text has one passage of zeros."""
    buf, begins = join(raw)
    sizes = np.diff(begins) - 1
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(count) - count
    total = int(count.sum())
    doc = np.repeat(np.arange(len(raw)), sizes + 1)
    where = np.arange(len(buf)) - begins[doc]
    owner = first[doc] + np.minimum(where // PASSAGE, count[doc] - 1)
    kinds = _TABLE[buf]
    pairs = owner[:-1] * 256 + kinds[:-1] * 16 + kinds[1:]
    x = np.zeros((total, DIM), np.float32)
    inside = doc[:-1] == doc[1:]
    x[:, :256] = np.bincount(pairs[inside], minlength=total * 256).reshape(total, 256)
    x[:, :256] /= np.maximum(1, x[:, :256].sum(1, keepdims=True))
    s, e = words(buf)
    if len(s):
        h, own = Hasher(buf)(s, e), owner[s]
        n = np.maximum(1, np.bincount(own, minlength=total))
        for k, lag in enumerate(LAGS):
            same = (h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag])
            x[:, 256 + k] = np.bincount(own[lag:][same], minlength=total) / n
        x[:, 256 + len(LAGS)] = np.bincount(own, weights=e - s, minlength=total) / n / 10
        x[:, 257 + len(LAGS)] = np.log1p(np.bincount(own, minlength=total)) / 5
    return x, count


class Model:
    """tanh encoder, gated attention over a bag, logistic score; plain numpy with Adam."""

    def __init__(self, seed: int = 7, hidden: int = 24, gate: int = 12):
        r = np.random.default_rng(seed)
        scale = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
        self.p = {"w": scale(DIM, hidden), "b": np.zeros(hidden, np.float32), "v": scale(hidden, gate), "u": scale(hidden, gate), "a": scale(gate, 1), "c": scale(hidden, 1), "c0": np.zeros(1, np.float32)}
        self.mean, self.std = np.zeros(DIM, np.float32), np.ones(DIM, np.float32)
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, count: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(count) - count
        z = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = ((t * g) @ p["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        bag = np.add.reduceat(a[:, None] * h, first, axis=0)
        logit = np.clip((bag @ p["c"])[:, 0] + p["c0"][0], -30, 30)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "y": 1 / (1 + np.exp(-logit)), "first": first}

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(count), self.constant)
        return self._forward(x, count)["y"].astype(np.float64)

    def attention(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self._forward(x, count)["a"]

    def gradients(self, x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict:
        p, f = self.p, self._forward(x, count)
        d = ((f["y"] - label) / len(label)).astype(np.float32)
        out = {"c": f["bag"].T @ d[:, None], "c0": d.sum(keepdims=True)}
        d_bag = np.repeat(d[:, None] * p["c"][:, 0], count, axis=0)
        d_a = (d_bag * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["a"] * d_a, f["first"]), count)
        d_e = (f["a"] * (d_a - mean))[:, None]
        out["a"] = (f["t"] * f["g"]).T @ d_e
        d_t, d_g = d_e * p["a"][:, 0] * f["g"] * (1 - f["t"] ** 2), d_e * p["a"][:, 0] * f["t"] * f["g"] * (1 - f["g"])
        out["v"], out["u"] = f["h"].T @ d_t, f["h"].T @ d_g
        d_h = (f["a"][:, None] * d_bag + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - f["h"] ** 2)
        out["w"], out["b"] = f["z"].T @ d_h, d_h.sum(0)
        return out

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> Model:
        if not len(bags) or labels.min() == labels.max():
            self.constant = float(labels[0]) if len(labels) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.std = every.mean(0), np.maximum(every.std(0), 1e-3)
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for k in range(0, len(order), batch):
                own, step = order[k : k + batch], step + 1
                count = np.array([len(bags[i]) for i in own])
                for name, grad in self.gradients(np.concatenate([bags[i] for i in own]), count, labels[own]).items():
                    grad = grad + 1e-4 * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    s[name] = 0.999 * s[name] + 0.001 * grad**2
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Fit on the labelled rows that are not held out; of several labels of a key the smallest holds.

    Without labels of both classes every score is the one label's value, or 0.5 without any label.
    """
    own = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).dropna()
    sample = own.where(~held_out("key")).groupBy("key").agg(F.min("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most)
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")  # sample: `most` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            names, marks = batch.column("key").to_pylist(), batch.column("label").to_pylist()
            for first, raw in chunks(texts_of(batch.column("text"))):
                x, count = passages(raw)
                bags = [x[k : k + n].astype(np.float16).tobytes() for k, n in zip(np.cumsum(count) - count, count)]
                at = slice(first, first + len(raw))
                yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in names[at]]), pa.array(marks[at], pa.float64()), pa.array(bags, pa.binary())], names=["key", "label", "bag"])

    rows = sorted((r.key, r.label, bytes(r.bag)) for r in picked.mapInArrow(run, "key string, label double, bag binary").collect())
    bags = [np.frombuffer(b, np.float16).reshape(-1, DIM).astype(np.float32) for _, _, b in rows]
    return Model().fit(bags, np.array([y for _, y, _ in rows], np.float32))


def _scores(model: Model, texts: Iterable[str | None]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.score(*passages(raw)) for _, raw in chunks(texts))])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row over its whole text; null texts score as empty ones, repeated rows alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, texts_of(batch.column(1))))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is at least threshold, with all their columns.

    Null texts score as empty ones, null keys and repeated rows like any other; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, texts_of(batch.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
