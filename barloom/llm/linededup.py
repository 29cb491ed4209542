"""Near-duplicate lines by a segment-partition edit join.

A line is a run of code points between newlines that holds a word. Equal lines form a class, however short.
Two classes of MIN_CHARS or more within MAX_EDITS edits share one of MAX_EDITS + 1 segments at a shifted
place: each class is indexed under (length, segment number, segment) and probes the same keys for every
length it may be linked to, at the places that leave few enough edits to the left and to the right. Buckets
of two classes or more give candidate pairs; a parity signature (an edit flips two of its bits at most)
prunes them, and a banded bit-parallel edit distance decides.

A bucket of more than BUCKET_MAX classes is cut finer, without loss: for one edit its lines are partitioned
into single characters, so that lines meet only if they agree on all but one of them; for more edits by the
bands of the signature, of which one at least is equal in every linked pair.

A line goes if an earlier line, by (key, hash of the text, line number), is equal or linked to it. The first stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, claim, discard, materialize, texts_of
from .textscan import Hasher, mix

MAX_EDITS = 1
MIN_CHARS = 20
BUCKET_MAX = 512
FETCH_MAX = 200_000
_U = np.uint64


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance if it is at most `most`, else most + 1: bit-parallel along a band of the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    k, n = 0, len(b)
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, n = 0, len(b)
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: n - k]
    if not b:
        return len(a)
    beyond, most = most + 1, min(most, len(a))
    width = 2 * most + 2
    full, top = (1 << width) - 1, width - 1
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    # Bit t of a column's vectors stands for row column + most + 1 - width + t; the top bit is the band's lower edge.
    up, down, value, shift = full & ~((1 << (top - most)) - 1), 0, most, most + 1 - width
    edge = top - 1
    for k, c in enumerate(b):
        same = where.get(c, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & full
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right_up = down | (full & ~(zero | up))
        right_down = zero & up
        if k < len(a) - most:
            value += not zero >> top & 1
        else:
            value += (right_up >> edge & 1) - (right_down >> edge & 1)
            edge -= 1
        up = right_down | (full & ~((zero >> 1) | right_up))
        down = (zero >> 1) & right_up
        shift += 1
    return min(value, beyond)


def _plan(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) of every key of a line; those of its own segments come first."""
    out = [(0, i, 0) for i in range(edits + 1)]
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                if less or shift:
                    out.append((less, i, shift))
    return out


def line_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of shape lines x plan, valid): the index keys and the further probe keys of ranges of code points."""
    h, n = Hasher(buf), ends - starts
    plan = _plan(edits)
    keys, valid = np.zeros((len(n), len(plan)), _U), np.zeros((len(n), len(plan)), bool)
    for k, (less, i, shift) in enumerate(plan):
        length = n - less
        base, longer = length // (edits + 1), length % (edits + 1)
        size = base + (i >= edits + 1 - longer)
        at = i * base + np.maximum(0, i - (edits + 1 - longer)) + shift
        fine = (length >= least) & (n >= least) & (at >= 0) & (at + size <= n)
        own = np.where(fine, starts + at, 0)
        keys[:, k] = mix(h(own, np.where(fine, own + size, 0)) + mix((length * 64 + i).astype(_U)))
        valid[:, k] = fine
    return keys, valid


def signature(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The parity of each code point's count, folded to 64 bits."""
    bits = _U(1) << (buf.astype(_U) * _U(37) % _U(64))
    sums = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(bits)]) if len(buf) else np.zeros(1, _U)
    return sums[ends] ^ sums[starts]


def _groups(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, code points with a newline after each text, where each begins with the total at the end)."""
    own: list[str] = []
    size = first = 0

    def points() -> tuple[int, np.ndarray, np.ndarray]:
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])]).astype(np.int64)
        return first, np.frombuffer(("\n".join(own) + "\n").encode("utf-32-le"), np.uint32), begins

    for k, text in enumerate(texts):
        text = text or ""
        if own and size + len(text) > most:
            yield points()
            own, size, first = [], 0, k
        own.append(text)
        size += len(text) + 1
    if own:
        yield points()


def occurrences(docs: DataFrame, key: str, text: str, edits: int, least: int) -> DataFrame:
    """A row for each line with a word: place, 128-bit hash, signature, keys; again: equal to an earlier line of its text."""
    names = [f"k{i}" for i in range(len(_plan(edits)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for batch in batches:
            for first, buf, begins in _groups(texts_of(batch.column(2))):
                breaks = np.flatnonzero(buf == 10)
                ends, starts = breaks, np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
                doc = np.searchsorted(begins, starts, side="right") - 1
                number = np.arange(len(starts)) - np.searchsorted(starts, begins[doc])
                letters = np.concatenate([[0], np.cumsum((buf != 0x20) & ((buf < 0x09) | (buf > 0x0D)))])
                own = letters[ends] > letters[starts]
                doc, number, starts, ends = doc[own], number[own], starts[own], ends[own]
                whole = buf.tobytes()
                digests = b"".join(xxhash.xxh3_128_digest(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist()))
                hashes = np.frombuffer(digests, np.int64).reshape(-1, 2)
                place = np.lexsort((number, hashes[:, 1], hashes[:, 0], doc))
                again = np.zeros(len(doc), bool)
                if len(doc) > 1:
                    same = (doc[place][1:] == doc[place][:-1]) & (hashes[place][1:] == hashes[place][:-1]).all(1)
                    again[place[1:]] = same
                keys, valid = line_keys(buf, starts, ends, edits, least)
                at = pa.array(first + doc)
                cells = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(signature(buf, starts, ends).view(np.int64)), pa.array(again)]
                cells += [pa.array(keys[:, i].copy().view(np.int64), mask=~valid[:, i] | again) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "th", "line", "h1", "h2", "sig", "again", *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, th long, line int, h1 long, h2 long, sig long, again boolean, " + ", ".join(f"{n} long" for n in names)
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")).mapInArrow(run, schema)


def _single_keys(lines: DataFrame) -> DataFrame:
    """(key, own, c) of the finest partition of rows (c, row): all of a line but one character, and all of it.

    Lines of one length that differ in one place share that place's key, and a line shares the key of a line
    that is one character longer without that character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for batch in batches:
            for first, buf, begins in _groups(texts_of(batch.column(1)), 1 << 16):
                starts, ends = begins[:-1], begins[1:] - 1
                h, n = Hasher(buf), ends - starts
                line = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(buf) - len(n)) + line  # of every character; each line is followed by a newline
                a, b = starts[line], ends[line]
                left, right, place = h(a, at), h(at + 1, b), at - a
                changed = mix(left ^ mix(right + mix((place * 2 + 1).astype(_U))) ^ mix(n[line].astype(_U)))
                shorter = h.without(a, at, b)
                key = np.concatenate([changed, shorter, h(starts, ends)])
                own = np.repeat([True, False, True], [len(at), len(at), len(n)])
                ids = batch.column(0).take(pa.array(first + np.concatenate([line, line, np.arange(len(n))])))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), ids], names=["key", "own", "c"])

    return lines.select("c", "row").mapInArrow(run, "key long, own boolean, c long")


def verified(pairs: DataFrame, edits: int) -> DataFrame:
    """Of rows (a, b, text_a, text_b, ...) those within the edits, with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [edit_distance(x, y, edits) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(own, pa.int32())], names=["a", "b", "distance"])
            yield out.filter(pa.array([d <= edits for d in own], pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, distance int")


class LineDedup:
    """The tables of one run: classes (c numbers them), links between them, and the lines that go."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = MAX_EDITS, least: int = MIN_CHARS):
        self.docs, self.key, self.text, self.edits = docs, key, text, edits
        names = [f"k{i}" for i in range(len(_plan(edits)))]
        lines = materialize(occurrences(docs, key, text, edits, least), "lines")
        first = F.min(F.struct("doc_id", "th", "line")).alias("first")
        classes = lines.where("not again").groupBy("h1", "h2").agg(first, F.count("*").alias("n_docs"), F.max("sig").alias("sig"), *[F.max(n).alias(n) for n in names])
        self.classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
        pairs = materialize(self._candidates(names), "pairs")
        texts = materialize(self._fetch(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()), "texts")
        side = lambda s: texts.select(F.col("c").alias(s), F.col("row").alias(f"text_{s}"))
        self.links = materialize(verified(pairs.join(side("a"), "a").join(side("b"), "b"), edits), "links")
        discard(pairs)
        place = lambda s: texts.select(F.col("c").alias(s), F.col("first").alias(f"first_{s}"))
        placed = self.links.join(place("a"), "a").join(place("b"), "b")
        self.later = placed.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
        gone = self.classes.join(self.later, "c", "left").where("n_docs > 1 OR n_links IS NOT NULL")
        gone = gone.select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        own = lines.where("not again").select("doc_id", "th", "line", "h1", "h2").join(gone, ["h1", "h2"]).where("n_links > 0 OR doc_id <> first_doc OR th <> first_th")
        exact = lines.where("again").select("doc_id", "th", "line", F.lit(0).cast("long").alias("n_links"))
        self.dropped = own.select("doc_id", "th", "line", "n_links").union(exact).distinct()

    def _fetch(self, ids: DataFrame) -> DataFrame:
        """(c, first, row) of these classes: the text of each, from its first line."""
        need = self.classes.join(ids, "c").select("c", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"))
        need = broadcast_if(materialize(need, "reps"), FETCH_MAX)
        source = self._rows(F.split(F.col(self.text), "\n").alias("rows"))
        found = source.join(need, ["doc_id", "th"]).select("c", "first", F.get("rows", F.col("first.line")).alias("row"))
        return found.groupBy("c").agg(F.min("first").alias("first"), F.min("row").alias("row"))

    def _rows(self, *more: Column) -> DataFrame:
        return self.docs.select(F.col(self.key).alias("doc_id"), F.xxhash64(F.col(self.text)).alias("th"), *more).where("doc_id IS NOT NULL")

    def _candidates(self, names: list[str]) -> DataFrame:
        """Pairs (a, b) of classes that share a bucket and may be linked by their signatures."""
        edits = self.edits
        keys = F.filter(F.array(*[F.struct(F.lit(i <= edits).alias("own"), F.col(n).alias("key")) for i, n in enumerate(names)]), lambda x: x["key"].isNotNull())
        rows = self.classes.select("c", "sig", F.explode(keys).alias("e")).select("e.key", "e.own", "c", "sig")
        met = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("n_own")).where("n > 1 AND n_own > 0")
        shared = materialize(rows.join(met.select("key", "n"), "key"), "buckets")
        near = 2 * edits
        small, crowded = shared.where(F.col("n") <= BUCKET_MAX).drop("n"), shared.where(F.col("n") > BUCKET_MAX).drop("n")
        if edits == 1:
            found = self._pairs(small, near)
            if crowded.limit(1).count():
                found = found.union(self._pairs(self._cut_finely(crowded), near))
            return found.distinct()
        bands, width = near + 1, -(-64 // (near + 1))
        cut = F.explode(F.array(*[F.xxhash64("key", F.lit(k), F.shiftrightunsigned("sig", width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(bands)]))
        return self._pairs(small.unionByName(crowded.withColumn("key", cut)), near).distinct()

    def _cut_finely(self, crowded: DataFrame) -> DataFrame:
        """The rows (key, own, c, sig) of the finest partition that share a key."""
        ids = crowded.select("c").distinct()
        keys = materialize(_single_keys(self._fetch(ids)), "single")
        met = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("n_own")).where("n > 1 AND n_own > 0")
        return keys.join(met.select("key"), "key").join(self.classes.select("c", "sig"), "c").select("key", "own", "c", "sig")

    @staticmethod
    def _pairs(rows: DataFrame, near: int) -> DataFrame:
        a, b = rows.where("own").alias("a"), rows.alias("b")
        linked = (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & (~F.col("b.own") | (F.col("a.c") < F.col("b.c")))
        close = F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) <= near
        return a.join(b, linked & close).select(F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b"))

    def by_document(self) -> DataFrame:
        """(doc_id, th, lines, n_dropped, n_links) of the documents that lose a line; th: the hash of the text."""
        return self.dropped.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.countDistinct("line").alias("n_dropped"), F.sum("n_links").alias("n_links"))

    def report(self) -> DataFrame:
        """(doc_id, n_lines, n_dropped, n_links) of every row; a null text has no lines, a null key loses none."""
        size = F.when(F.col(self.text).isNull(), 0).otherwise(F.size(F.split(F.col(self.text), "\n"))).cast("long")
        own = self.docs.select(F.col(self.key).alias("doc_id"), F.xxhash64(F.col(self.text)).alias("th"), size.alias("n_lines"))
        gone = self.by_document().select("doc_id", "th", "n_dropped", "n_links")
        return own.join(gone, ["doc_id", "th"], "left").select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def apply(self, count: str | None = "n_chars") -> DataFrame:
        """The documents without the lines that go, all columns kept; documents that lose their last word go."""
        names = self.docs.columns
        own = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(self.key).alias("doc_id"), F.xxhash64(F.col(self.text)).alias("th"))
        own = own.join(self.by_document().select("doc_id", "th", "lines"), ["doc_id", "th"], "left")
        held, cut = F.col("row")[self.text], F.col("lines").isNotNull()
        left = F.array_join(F.filter(F.split(held, "\n"), lambda _, k: ~F.array_contains("lines", k)), "\n")
        own = own.withColumn("new", F.when(cut, left).otherwise(held))
        own = own.where(~cut | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
        cells = {self.text: F.col("new")}
        if count in names:
            cells[count] = F.when(cut, F.char_length("new")).otherwise(F.col("row")[count]).cast(self.docs.schema[count].dataType)
        return own.select(*[cells.get(c, F.col("row")[c]).alias(c) for c in names])


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineDedup:
    """Find the lines of all documents that repeat an earlier line, exactly or within the edits.

    Keys may be of any type that has an order. Rows with a null key keep their text and are no earlier line for
    others; rows that repeat a key and its text count as one document, rows of one key with different texts as
    several, in the order of the texts' hashes; null, empty and blank texts have no line that takes part; an empty
    table gives empty tables.
    """
    return LineDedup(docs, key, text)
