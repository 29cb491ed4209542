"""Benchmark decontamination by template canonicalisation.

Words are runs of letters and digits (any byte above 127 counts as a letter), folded to lower case for
ASCII and Latin-1. Numbers, units and names become typed placeholders: a number starts with a digit or is
a number word, a unit is in UNITS, a name begins upper-case inside a sentence and is not all upper-case.
Every WINDOW canonical words of a document are hashed; those that a fixed-size bitmap of the benchmark's
window hashes doesn't rule out are hash-joined to the benchmark's windows, and matches on one alignment of
a document and an item are one passage. Its slots must be consistent: a placeholder's value in the item
always stands for the same value in the document, which passages that were re-parameterised keep and chance
matches of templates don't. A consistent passage is a leak when its windows cover at least min(COVER, words
of the item) words.

A window with fewer than LITERALS literal words is hashed by its surface words, so it matches verbatim but
not with other parameters. Whether a capitalised word is a name can't be told where a sentence begins; a
window that starts with such a word is hashed both ways, with the word as it is and as a name.

Items of fewer than WINDOW words are matched as a whole, those of fewer than TEMPLATE words verbatim, and those
of fewer than LEAST words never. Windows that more than COMMON items share don't propose passages unless an item
has no other; they count once a rarer window of the same item has proposed one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, claim, materialize, texts_of
from .textscan import Hasher, chunks, join, mix

WINDOW = 8
COVER = 13
TEMPLATE = 5
LEAST = 3
COMMON = 256
LITERALS = 3
BITMAP_BITS = 24
BROADCAST_MAX = 100_000
#: Words that stand for a unit or a number.
UNITS = "kg g mg km m cm mm mi ft in lb oz l ml s sec min h hr hours hour minutes minute seconds days day weeks week months month years year miles meters metres grams liters litres pounds inches feet dollars dollar euros euro cents percent"
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
_U = np.uint64
_NUM, _NAME, _UNIT = _U(0x1111), _U(0x2222), _U(0x3333)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _hash_words(names: str) -> np.ndarray:
    raw = names.split()
    buf, begins = join([x.encode() for x in raw])
    return np.sort(Hasher(buf)(begins[:-1], begins[1:] - 1))


_UNIT_HASHES, _NUMBER_HASHES = _hash_words(UNITS), _hash_words(NUMBERS)


def canonical(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, canonical hash, surface hash, is a placeholder, may be a name) of every word, in order."""
    before = np.concatenate([[np.uint8(10)], buf[:-1]])
    after = np.concatenate([buf[1:], [np.uint8(10)]])
    inside = _LETTER[buf] | (((buf == 0x2E) | (buf == 0x2C)) & _DIGIT[before] & _DIGIT[after])
    general = (buf == 0xE2) & (after == 0x80)  # quotes, dashes and other general punctuation
    general[1:] |= (buf[1:] == 0x80) & (buf[:-1] == 0xE2)
    general[2:] |= (buf[1:-1] == 0x80) & (buf[:-2] == 0xE2)
    nbsp = (buf == 0xC2) & (after < 0xC0) & (after >= 0x80)
    nbsp[1:] |= (buf[:-1] == 0xC2)
    inside &= ~general & ~nbsp
    upper = (buf >= 0x41) & (buf <= 0x5A)
    wide = (before == 0xC3) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
    folded = buf + np.where(upper | wide, 0x20, 0).astype(np.uint8)
    edge = np.concatenate([[False], inside, [False]])
    edges = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = edges[0::2], edges[1::2]
    h = Hasher(folded)(starts, ends)
    surface = h
    number = _DIGIT[buf[starts]] | np.isin(h, _NUMBER_HASHES)
    unit = np.isin(h, _UNIT_HASHES)
    capitals = np.concatenate([[0], np.cumsum(upper | wide)])
    n_upper = capitals[ends] - capitals[starts]
    two = np.minimum(starts + 1, len(buf) - 1)
    begins_upper = upper[starts] | (wide[two] & (buf[starts] == 0xC3)) if len(starts) else np.zeros(0, bool)
    solid = np.maximum.accumulate(np.where(buf != 0x20, np.arange(len(buf)), -1))
    last = np.where(starts > 0, solid[np.maximum(starts - 1, 0)], -1)
    mark = np.where(last >= 0, buf[np.maximum(last, 0)], 10)
    opens = np.isin(mark, np.frombuffer(b".!?:;\n\"'|", np.uint8))
    capital = begins_upper & (n_upper == 1) & ~number & ~unit
    name = capital & ~opens
    out = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    doc = np.searchsorted(begins, starts, side="right") - 1
    return doc, out, surface, number | unit | name, capital & opens


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` canonical words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * _U(0xD6E8FEB86659FD93) + words[k : k + n]
        return mix(total + _U(width))


def _hash_at(words: np.ndarray, at: np.ndarray, width: int, start: np.uint64 | None) -> np.ndarray:
    """The hash of the windows at these places with `start` for the first word, or if None of surface words."""
    total = np.zeros(len(at), _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * _U(0xD6E8FEB86659FD93) + (words[at + k] if k or start is None else start)
        return mix(total + _U(width if start is not None else width + 64))


def _windows(texts: Iterable[str | None], widths: tuple[int, ...], keep=None) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, width, hash, surface hashes of the placeholders, first word taken for a name) of windows within one text that keep() lets pass."""
    for first, raw in chunks(texts):
        buf, begins = join(raw)
        doc, words, surface, slot, either = canonical(buf, begins)
        starts = np.searchsorted(doc, np.arange(len(raw)))
        slots = np.concatenate([[0], np.cumsum(slot)])
        for width in widths:
            h = window_hashes(words, width)
            every = np.flatnonzero(doc[: len(h)] == doc[width - 1 : width - 1 + len(h)])
            literal = width - (slots[every + width] - slots[every])
            also = either[every] & (width >= TEMPLATE)
            at, named = np.concatenate([every, every[also]]), np.repeat([False, True], [len(every), also.sum()])
            literal = np.concatenate([literal, literal[also] - 1])
            h = h[at]
            for rows, source, start in ((named, words, _NAME), ((literal < min(LITERALS, width)) | (width < TEMPLATE), surface, None)):
                own = np.flatnonzero(rows)
                h[own] = _hash_at(source, at[own], width, start)
            if keep is not None:
                fine = keep(h)
                at, named, h = at[fine], named[fine], h[fine]
            values = []
            for i, n in zip(at.tolist(), named.tolist()):
                mask = slot[i : i + width].copy()
                mask[0] |= n
                values.append(surface[i : i + width][mask].view(np.int64).tolist())
            yield first + doc[at], at - starts[doc[at]], np.full(len(at), width), h, values, named


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item_words, at, width, h, item_values, named) of every window of every item; named: its first word is taken for a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for owner, text in zip(owners, texts):
                buf, begins = join([(text or "").encode()])
                n = len(canonical(buf, begins)[0])
                if n < LEAST:
                    continue
                for _, at, _, h, values, named in _windows([text], (min(n, WINDOW),)):
                    cells = [pa.array([owner] * len(at), pa.int64()), pa.array([n] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array([min(n, WINDOW)] * len(at), pa.int32()), pa.array(h.view(np.int64)), pa.array(values, pa.list_(pa.int64())), pa.array(named)]
                    yield pa.RecordBatch.from_arrays(cells, names=["item_id", "item_words", "at", "width", "h", "item_values", "named"])

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item_id long, item_words int, at int, width int, h long, item_values array<long>, named boolean")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** BITMAP_BITS bits over the hashes, however many there are."""
    low = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    cells = windows.select(F.shiftright(low, 5).alias("cell"), F.expr(f"shiftleft(1L, cast((h & {(1 << BITMAP_BITS) - 1}) & 31 as int))").alias("bit"))
    bits = np.zeros(1 << BITMAP_BITS - 5, np.uint32)
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r.cell] = r.bits
    return bits


def _hits(found: DataFrame, bench: DataFrame, *on: str) -> DataFrame:
    met = found.join(bench, ["h", "width", *on]).where(F.size("item_values") == F.size("values"))
    return met.select("doc_id", "item_id", "item_words", "width", "at", "named", (F.col("place") - F.col("at")).alias("shift"), F.arrays_zip("item_values", "values").alias("slots"))


def _hits_of_pairs_and_classes(found: DataFrame, bench: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hits, class hits, members, pairs): the hits of documents and items that a rare window joins, which are pairs; those of common windows with a class's first item; its items."""
    marked = materialize(bench.join(shared, ["h", "width"], "left"), "marked")
    rare, common = marked.where("n IS NULL").drop("n"), marked.where("n IS NOT NULL").drop("n")
    first = materialize(_hits(found, broadcast_if(rare, BROADCAST_MAX)), "rare-hits")
    pairs = first.select("doc_id", "item_id").distinct()
    of_common = found.join(common.select("h", "width").distinct(), ["h", "width"], "left_semi")
    parts = common.groupBy("item_id").agg(F.sort_array(F.collect_set(F.struct("at", "h", "width", "item_values", "named", "item_words"))).alias("part"))
    members = materialize(parts.join(parts.groupBy("part").agg(F.min("item_id").alias("class"), F.count("*").alias("n_items")), "part").drop("part"), "classes")
    reps = common.join(members.where("item_id = class"), "item_id", "left_semi")
    hits = first.unionByName(_hits(of_common.join(pairs, "doc_id"), common, "item_id"))
    return hits, _hits(of_common, broadcast_if(reps, BROADCAST_MAX)), members, pairs


def _judged(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, covered, n_slots): the largest consistent passage of each document and item."""
    passage = hits.groupBy("doc_id", "item_id", "shift").agg(
        F.max("item_words").alias("item_words"), F.max("width").alias("width"),
        F.collect_set(F.when(~F.col("named"), F.col("at"))).alias("sure"), F.collect_set(F.when(~F.col("named"), F.col("slots"))).alias("slots"),
        F.collect_set(F.when(F.col("named"), F.struct("at", "slots"))).alias("named"),
    )  # fmt: skip  # each has a place for each word of the item at most
    extra = F.filter("named", lambda x: ~F.array_contains("sure", x["at"]))
    passage = passage.withColumns({"at": F.sort_array(F.array_union("sure", F.transform(extra, lambda x: x["at"]))), "slots": F.array_distinct(F.flatten(F.concat("slots", F.transform(extra, lambda x: x["slots"]))))})
    gaps = F.transform("at", lambda x, k: F.least(F.col("width"), F.coalesce(F.get("at", k + 1) - x, F.col("width"))))
    one = F.size(F.array_distinct(F.transform("slots", lambda x: x["item_values"])))
    told = passage.select("doc_id", "item_id", "item_words", F.size("at").alias("n_windows"), F.aggregate(gaps, F.lit(0), lambda x, y: x + y).alias("covered"), F.size("slots").alias("n_slots"), (one == F.size("slots")).alias("one"))
    told = told.where("one AND covered >= item_words")
    best = told.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "covered", "n_slots")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_windows").cast("long").alias("n_windows"), F.col("best.covered").cast("long").alias("covered"), F.col("best.n_slots").cast("long").alias("n_slots"))


def _search(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame | None]:
    """(leaks, leaks of classes, members, pairs): those of classes hold for all members but the pairs, which leaks has; without common windows leaks has all."""
    spark: SparkSession = docs.sparkSession
    windows = benchmark_windows(items, item_key, item_text)
    bench = materialize(windows.withColumn("item_words", F.least("item_words", F.lit(COVER))), "benchmark")  # as many as a leak must cover
    bits = spark.sparkContext.broadcast(_bitmap(bench))
    widths = tuple(sorted(r.width for r in bench.select("width").distinct().collect()))  # at most WINDOW of them

    def keep(h: np.ndarray) -> np.ndarray:
        low = h & _U((1 << BITMAP_BITS) - 1)
        return bits.value[low >> _U(5)] >> (low & _U(31)).astype(np.uint32) & np.uint32(1) != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontamination")
        for batch in batches:
            for doc, at, width, h, values, _ in _windows(texts_of(batch.column(1)), widths, keep):
                cells = [batch.column(0).take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(values, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "place", "width", "h", "values"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, place int, width int, h long, values array<long>")
    shared = materialize(bench.groupBy("h", "width").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") > COMMON), "shared")
    if not shared.limit(1).count():
        return _judged(_hits(found, broadcast_if(bench, BROADCAST_MAX))), None, None, None
    hits, of_classes, members, pairs = _hits_of_pairs_and_classes(materialize(found, "found"), bench, shared)
    return _judged(hits), materialize(_judged(of_classes).withColumnRenamed("item_id", "class"), "class-leaks"), members, pairs


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, covered, n_slots) of every document and item with a consistent passage.

    Keys are integers, any other that doesn't cast to one is an error. Null and empty texts, null keys and items shorter than LEAST words never match; repeated rows count
    once; where several passages of a document match an item the largest is told; no items, no rows.
    """
    own, of_classes, members, pairs = _search(docs, items, key, text, item_key, item_text)
    if of_classes is None:
        return own
    every = of_classes.join(broadcast_if(members, BROADCAST_MAX), "class").join(pairs, ["doc_id", "item_id"], "left_anti")
    return own.unionByName(every.drop("class", "n_items"))


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, with all columns; rows with a null key stay. Classes aren't expanded into their items."""
    own, of_classes, members, pairs = _search(docs, items, key, text, "item_id", "text")
    found = own.select("doc_id")
    if of_classes is not None:
        judged = pairs.join(members, "item_id").groupBy("doc_id", "class").agg(F.count("*").alias("n_judged"))
        sizes = members.select("class", "n_items").distinct()
        rest = of_classes.join(sizes, "class").join(judged, ["doc_id", "class"], "left").where("n_items > coalesce(n_judged, 0)")
        found = found.unionByName(rest.select("doc_id"))
    return docs.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
