"""Language-model scores by masked pseudo-likelihood.

Every word is predicted from the SIDE words before it and the SIDE words after it by a window network in
numpy: a vector for each context word and place, summed, tanh, and a softmax over word classes. A class
consists of hash buckets and a bucket of words: a word's probability is that of its class, times the
bucket's share of the class, times the word's own share of the bucket. A document's score is the sum of the
conditional log probabilities of all its words.

One pass over the corpus counts all words and, for each bucket, how the SIGNS hash bits of the words next to
its words fall: sums of signs that are a random projection of its neighbours' distribution. Buckets with like
neighbours are one class (k-means over at most BUCKETS rows). Every word's count is used: those of the HOT
most frequent words go to every task, all others are joined to the distinct words of each document, by hash.

The network is trained on every window of the corpus. Documents are dealt by a hash of key and text into
shards of about SHARD_WORDS words and into ROUNDS parts; in each round every shard of its part trains on from
the average of the round before. Dealing and order don't depend on the files' layout, so scores don't either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, discard, materialize, texts_of
from .textscan import Hasher, chunks, join, words

SIDE = 2
PLACES = 2 * SIDE
INPUTS = 1024
CLASSES = 48
KNOWN = INPUTS - 1 - CLASSES
BUCKETS = 1 << 16
SIGNS = 16
HIDDEN = 16
HOT = 1 << 16
BATCH = 8192
RATE = 0.15
ROUNDS = 3
SHARD_WORDS = 4_000_000
FAN = 32
_U = np.uint64
SIZES = (PLACES * INPUTS * HIDDEN, HIDDEN, HIDDEN * CLASSES, CLASSES)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word, ASCII letters folded."""
    buf, begins = join(raw)
    folded = buf + np.where((buf >= 0x41) & (buf <= 0x5A), 0x20, 0).astype(np.uint8)
    starts, ends = words(buf)
    return np.searchsorted(begins, starts, side="right") - 1, Hasher(folded)(starts, ends)


def gather(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(h, n): how often each word occurs in all documents; (bucket, n, s0 ..): the signs of its words' neighbours.

    Null and empty texts have no words; repeated rows count as often as they stand; an empty table gives none.
    """
    signs = [f"s{k}" for k in range(SIGNS)]
    names = ["h", "n", *signs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pseudo")
        sums, pairs = np.zeros((SIGNS, BUCKETS), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held = [np.zeros(0, _U)]
            for _, raw in chunks(texts_of(batch.column(0))):
                doc, h = word_hashes(raw)
                held.append(h)
                inside = np.flatnonzero(doc[1:] == doc[:-1])
                bucket = (h & _U(BUCKETS - 1)).astype(np.int64)
                for k in range(SIGNS):  # the first half looks at the word before, the second at the word after
                    own, other = (inside + 1, inside) if k < SIGNS // 2 else (inside, inside + 1)
                    bit = (h[other] >> _U(32 + k) & _U(1)).astype(np.int64)
                    sums[k] += 2 * np.bincount(bucket[own][bit == 1], minlength=BUCKETS) - np.bincount(bucket[own], minlength=BUCKETS)
                pairs += np.bincount(bucket[inside], minlength=BUCKETS)
            h, n = np.unique(np.concatenate(held), return_counts=True)
            none = pa.nulls(len(h), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), *[none] * SIGNS], names=names)
        seen = np.flatnonzero(np.abs(sums).sum(0) + pairs)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(pairs[seen]), *[pa.array(x[seen]) for x in sums]], names=names)

    raw = materialize(docs.select(F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names)), "gathered")
    counts = materialize(raw.where("s0 IS NULL").groupBy("h").agg(F.sum("n").alias("n")), "words")
    near = materialize(raw.where("s0 IS NOT NULL").groupBy(F.col("h").alias("bucket")).agg(*[F.sum(c).alias(c) for c in names[1:]]), "neighbours")
    discard(raw)
    return counts, near


def alike(points: np.ndarray, weights: np.ndarray, classes: int, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """The class of each weighted point by k-means, seeded and spread by squared distances."""
    r = np.random.default_rng(seed)
    centres = [points[int(np.argmax(weights))]]
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < classes and (far * weights).sum() > 0:
        chance = far * weights
        centres.append(points[r.choice(len(points), p=chance / chance.sum())])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
    own = np.array(centres)
    for _ in range(rounds):
        kind = ((own**2).sum(1) - 2 * points @ own.T).argmin(1)
        mass = np.bincount(kind, weights=weights, minlength=len(own))
        for k in range(points.shape[1]):
            total = np.bincount(kind, weights=weights * points[:, k], minlength=len(own))
            own[:, k] = np.where(mass > 0, total / np.maximum(mass, 1e-12), own[:, k])
    return kind


class Vocabulary:
    """Context ids, classes, buckets' shares and the hot words' own; those of all other words stay in the table of counts."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, buckets: np.ndarray, signs: np.ndarray, pairs: np.ndarray):
        """top: the HOT most frequent words, in order; signs and pairs: of each bucket's neighbours."""
        known = top[:KNOWN]
        order = np.argsort(known)
        self.known, self.rank = known[order], order.astype(np.int64)
        usual = signs.sum(0) / max(1, pairs.sum())
        self.kind = alike((signs - pairs[:, None] * usual) / (pairs[:, None] + 20.0), buckets.astype(float), CLASSES).astype(np.int64)
        total = np.bincount(self.kind, weights=buckets, minlength=CLASSES) + np.bincount(self.kind, minlength=CLASSES)
        self.share = np.log((buckets + 1) / total[self.kind])
        self.buckets = buckets
        place = np.argsort(top)
        self.hot = top[place]
        self.hot_own = np.log(counts[place] / buckets[(self.hot & _U(BUCKETS - 1)).astype(np.int64)])

    def own_shares(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log of the word's share of its bucket, 0 where the word isn't hot; is hot)."""
        if not len(self.hot):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        hot = self.hot[at] == h
        return np.where(hot, self.hot_own[at], 0), hot

    def contexts(self, h: np.ndarray) -> np.ndarray:
        """The last id is the boundary of a text; words beyond the known have the id of their class."""
        out = KNOWN + self.kind[(h & _U(BUCKETS - 1)).astype(np.int64)]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            out = np.where(self.known[at] == h, self.rank[at], out)
        return out

    def windows(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, context ids of shape words x PLACES)."""
        return self.windows_of(*word_hashes(raw), len(raw))

    def windows_of(self, doc: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        line = np.full(len(h) + SIDE * (texts + 1), INPUTS - 1)
        at = np.arange(len(h)) + SIDE * (doc + 1)
        line[at] = self.contexts(h)
        around = [k for k in range(-SIDE, SIDE + 1) if k]
        return doc, (h & _U(BUCKETS - 1)).astype(np.int64), line[at[:, None] + np.array(around)]


def vocabulary(counts: DataFrame, near: DataFrame) -> Vocabulary:
    """From the tables of gather(); without any word all buckets are one class."""
    top = counts.orderBy(F.desc("n"), "h").limit(HOT).collect()  # HOT rows at most
    buckets, table = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, SIGNS + 1))
    for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        buckets[r.b] = r.n
    for r in near.collect():  # BUCKETS rows at most
        table[r.bucket] = r[1:]
    return Vocabulary(np.array([r.h for r in top], np.int64).view(_U), np.array([r.n for r in top], np.int64), buckets, table[:, 1:], table[:, 0])


class Network:
    def __init__(self, flat: np.ndarray | None = None, seen: np.ndarray | None = None, prior: np.ndarray | None = None, seed: int = 5):
        """flat: the parameters, seen: the sums of squared gradients that set the steps; prior: where the classes start."""
        if flat is None:
            r = np.random.default_rng(seed)
            flat = np.concatenate([r.normal(0, 0.3, SIZES[0]), np.zeros(SIZES[1]), r.normal(0, 0.25, SIZES[2]), np.zeros(SIZES[3]) if prior is None else prior])
        self.flat = flat.astype(np.float32)
        a, b, c, _ = np.split(self.flat, np.cumsum(SIZES)[:-1])
        self.table, self.bias, self.out = a.reshape(PLACES * INPUTS, HIDDEN), b, c.reshape(HIDDEN, CLASSES)
        self.prior = self.flat[-CLASSES:]
        self.seen = np.full(len(self.flat), 1e-2, np.float32) if seen is None else seen.astype(np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.bias + self.table[x[:, 0]]
        for k in range(1, PLACES):
            h += self.table[x[:, k] + k * INPUTS]
        h = np.tanh(h)
        y = h @ self.out + self.prior
        y -= y.max(1, keepdims=True)
        return h, y

    def log_probabilities(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, y = self.forward(x)
        return y[np.arange(len(y)), target] - np.log(np.exp(y).sum(1))

    def gradient(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean cross-entropy over a batch, as flat as the parameters."""
        h, y = self.forward(x)
        y = np.exp(y)
        y /= y.sum(1, keepdims=True)
        y[np.arange(len(y)), target] -= 1
        y /= len(y)
        d = (y @ self.out.T) * (1 - h * h)
        cells = (x + np.arange(PLACES) * INPUTS)[:, :, None] * HIDDEN + np.arange(HIDDEN)
        table = np.bincount(cells.ravel(), weights=np.repeat(d[:, None], PLACES, axis=1).ravel(), minlength=SIZES[0])
        return np.concatenate([table, d.sum(0), (h.T @ y).ravel(), y.sum(0)]).astype(np.float32)

    def step(self, x: np.ndarray, target: np.ndarray) -> None:
        g = self.gradient(x, target) * np.float32(len(x) / 64)
        self.seen += g * g
        self.flat -= RATE * g / np.sqrt(self.seen)


def _trained(vocab: Vocabulary, flat: np.ndarray, seen: np.ndarray):
    """Of rows (shard, text), a shard after the other: (shard, n, total) with the parameters and steps after its n words, times n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pseudo")
        shard, n, net = None, 0, Network(flat, seen.copy())

        def told() -> pa.RecordBatch:
            total = n * np.concatenate([net.flat, net.seen]).astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n]), pa.array([total], pa.list_(pa.float64()))], names=["shard", "n", "total"])

        for batch in batches:
            owners = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
            for a, b in zip(edges, edges[1:]):
                if b > a and owners[a] != shard:
                    if n:
                        yield told()
                    shard, n, net = int(owners[a]), 0, Network(flat, seen.copy())
                for _, raw in chunks(texts_of(batch.column(1).slice(a, b - a))):
                    _, bucket, x = vocab.windows(raw)
                    for k in range(0, len(x), BATCH):
                        net.step(x[k : k + BATCH], vocab.kind[bucket[k : k + BATCH]])
                    n += len(x)
        if n:
            yield told()

    return run


def _summed(states: DataFrame, shards: int) -> tuple[int, np.ndarray | None]:
    """(words, sum of the totals), FAN shards at a time and level by level, so no task and no driver ever holds more than FAN."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        return pd.DataFrame({"shard": [int(key[0])], "n": [int(pdf.n.sum())], "total": [np.sum(np.stack(pdf.total.to_list()), axis=0)]})

    while shards > FAN:
        states = states.groupBy(F.floor(F.col("shard") / FAN).alias("above")).applyInPandas(add, "shard long, n long, total array<double>")
        shards = -(-shards // FAN)
    rows = sorted(states.collect(), key=lambda r: r.shard)  # FAN rows at most
    return sum(r.n for r in rows), sum((np.array(r.total) for r in rows[1:]), np.array(rows[0].total)) if rows else None


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", key: str = "doc_id") -> Network:
    """One pass over all windows of the corpus in ROUNDS rounds, averaged by words after each.

    Without any word the start network, which scores classes by their mass. Null keys and repeated rows train like any
    other; ties in the hash of key and text are the same text, so their order doesn't matter.
    """
    mass = np.bincount(vocab.kind, weights=vocab.buckets, minlength=CLASSES) + 1
    net = Network(prior=np.log(mass / mass.sum()))
    shards = max(1, int(-(-vocab.buckets.sum() // (ROUNDS * SHARD_WORDS))))
    place = F.xxhash64(F.col(key), F.col(text))
    rows = docs.select(F.col(text).alias("text"), place.alias("at")).where("text IS NOT NULL")
    for k in range(ROUNDS):
        part = rows.where(F.pmod(F.shiftrightunsigned("at", 40), F.lit(ROUNDS)) == k).withColumn("shard", F.pmod("at", F.lit(shards)))
        dealt = part.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "at", "text").select("shard", "text")
        n, total = _summed(dealt.mapInArrow(_trained(vocab, net.flat, net.seen), "shard long, n long, total array<double>"), shards)
        if n:
            net = Network(*np.split(total / n, 2))
    return net


def score(docs: DataFrame, vocab: Vocabulary, net: Network, key: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(key, n_words, log_likelihood, per_word) of every row over its whole text.

    counts: those of gather(), by default of docs; a word that they lack counts as one of its bucket.
    """
    flat = net.flat
    counts = gather(docs, text)[0] if counts is None else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = Network(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, raw in chunks(texts_of(batch.column(1))):
                doc, h = word_hashes(raw)
                _, bucket, x = vocab.windows_of(doc, h, len(raw))
                own, hot = vocab.own_shares(h)
                own += vocab.share[bucket]
                for k in range(0, len(x), BATCH):
                    own[k : k + BATCH] += model.log_probabilities(x[k : k + BATCH], vocab.kind[bucket[k : k + BATCH]])
                n, total = np.bincount(doc, minlength=len(raw)), np.bincount(doc, weights=own, minlength=len(raw))
                rare = np.flatnonzero(~hot)
                rare = rare[np.lexsort((h[rare], doc[rare]))]
                new = np.ones(len(rare), bool)
                new[1:] = (doc[rare][1:] != doc[rare][:-1]) | (h[rare][1:] != h[rare][:-1])
                begin = np.flatnonzero(new)
                times, rare = np.diff(np.append(begin, len(rare))), rare[begin]
                cuts = pa.array(np.searchsorted(doc[rare], np.arange(len(raw) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (h[rare].view(np.int64), times.astype(np.int32))]
                rows = pa.array(row + np.arange(len(raw)))
                row += len(raw)
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(first, len(raw)), pa.array(n), pa.array(total), *lists], names=["row", "key", "n_words", "total", "rare", "times"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    scored = materialize(rows.mapInArrow(run, f"row long, key {kind}, n_words long, total double, rare array<long>, times array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("h"), F.col("e.times").alias("times"))
    cell = F.col("h").bitwiseAND(F.lit(BUCKETS - 1))
    sums = counts.groupBy(cell.alias("cell")).agg(F.sum("n").alias("mass"))  # BUCKETS rows at most
    own = rare.join(counts.select("h", "n"), "h", "left").join(F.broadcast(sums), cell == F.col("cell"), "left")
    share = F.coalesce(F.ln(F.col("n") / F.col("mass")), -F.log1p(F.coalesce("mass", F.lit(0))))
    added = own.groupBy("row").agg(F.sum(F.col("times") * share).alias("added"))
    total = F.col("total") + F.coalesce("added", F.lit(0.0))
    return scored.join(added, "row", "left").select(F.col("key").alias(key), "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word"))


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count, train and score all documents.

    Null and empty texts have no words, log_likelihood 0 and a null per_word; null keys and repeated rows
    are scored like any other; an empty table gives no rows.
    """
    counts, near = gather(docs, text)
    vocab = vocabulary(counts, near)
    return score(docs, vocab, train(docs, vocab, text, key), key, text, counts)
