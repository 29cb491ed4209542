"""SimHash near-duplicates: segment popcounts as a grid, Manhattan distance as the lower bound, exact check.

A fingerprint's 64 bits are 32 segments of two bits; the vector of their popcounts (0, 1 or 2 each)
changes by at most one in L1 norm for each bit that differs, so fingerprints within MAX_BITS bits lie
within that Manhattan distance. The vector is cut in five blocks. Two differing bits touch two blocks at
most, so two linked vectors agree on at least three: every choice of three blocks is one grid, and the
equal cells of the ten grids hold every link. Pairs of a cell pass the Manhattan bound, then the exact
Hamming distance.

A cell of more than CELL_MAX fingerprints is never paired. Its members are linked through the words one
bit away from them: two fingerprints are within two bits if and only if they share such a word (or one is
the other's), and at most 65 fingerprints share one, so this is exact too and linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, components, materialize

MAX_BITS = 2
SHINGLE = 3
CELL_MAX = 128
SALT = 16
BLOCKS = (7, 7, 6, 6, 6)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit SimHash per text; null and empty texts have 0."""
    out, digest = np.zeros(len(texts), np.uint64), xxhash.xxh64_intdigest
    for begin in range(0, len(texts), 256):
        hashes, owner = [], []
        for k, text in enumerate(texts[begin : begin + 256]):
            words = (text or "").encode().lower().split()
            if not words:
                continue
            if len(words) <= width:
                own = [digest(b" ".join(words), 42)]
            else:
                joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
                starts = [0, *(ends[:-width]).tolist()]
                own = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
            hashes.append(np.array(own, np.uint64))
            owner.append(np.full(len(own), k))
        if not hashes:
            continue
        rows = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
        own, n = np.concatenate(owner) * 256, min(256, len(texts) - begin)
        total = np.bincount(own >> 8, minlength=n)
        for byte in range(8):
            counts = np.bincount(own + rows[:, byte], minlength=n * 256).reshape(n, 256) @ _BITS
            on = (2 * counts > total[:, None]).astype(np.uint64) << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))
            out[begin : begin + n] |= np.bitwise_or.reduce(on, axis=1)
    return out


def add_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(key, fp long) of every row, in one narrow pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            column = batch.column(1)
            fps = np.concatenate([np.zeros(0, np.uint64), *(fingerprints(column.slice(k, 1024).to_pylist(), width) for k in range(0, len(column), 1024))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _masks() -> list[int]:
    """For each choice of three blocks, the bits of the packed vector (two for each segment) in them."""
    own, at = [], 0
    for n in BLOCKS:
        own.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    return [m - (1 << 64) if m >> 63 else m for m in (sum(x) for x in combinations(own, len(BLOCKS) - MAX_BITS))]


EVEN = 0x5555555555555555


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fingerprints fp within two bits."""
    even, odd = F.col("fp").bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(EVEN))
    packed = distinct.select("fp", F.shiftleft(even.bitwiseAND(odd), 1).bitwiseOR(even.bitwiseXOR(odd)).alias("vec"))  # two bits a segment
    cells = packed.select("fp", "vec", F.posexplode(F.array(*[F.col("vec").bitwiseAND(F.lit(m)) for m in _masks()])).alias("grid", "cell"))
    sizes = materialize(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    small = cells.join(sizes.where(F.col("n") <= CELL_MAX).select("grid", "cell"), ["grid", "cell"])
    x = F.col("l.vec").bitwiseXOR(F.col("r.vec"))
    low = x.bitwiseAND(F.lit(EVEN))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN)).bitwiseAND(F.bitwise_not(low))
    manhattan = F.bit_count(low) + 2 * F.bit_count(high)
    exact = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")))
    pairs = small.alias("l").join(
        small.alias("r"),
        (F.col("l.grid") == F.col("r.grid")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.fp") < F.col("r.fp")) & (manhattan <= MAX_BITS) & (exact <= MAX_BITS),
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    crowded = cells.join(sizes.where(F.col("n") > CELL_MAX).select("grid", "cell"), ["grid", "cell"]).select("fp").distinct()
    middles = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)) for k in range(64)])).alias("middle"))
    stars = middles.groupBy("middle").agg(F.collect_set("fp").alias("of")).where("size(of) > 1")  # of has 65 members at most
    stars = stars.select(F.array_min("of").alias("a"), F.explode("of").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long, component_id) of every row: component_id is the smallest key linked to it.

    Null and empty texts have fingerprint zero and are linked like any other; rows with a null key keep
    their row and never name a component; repeated rows stay; an empty table gives no rows.
    """
    marks = materialize(add_fingerprints(docs, text, key), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "distinct")
    edges = links(distinct.select("fp"))
    linked = components(edges)
    named = linked.join(distinct, linked.id == distinct.fp).select("fp", "component", "first")
    names = named.groupBy("component").agg(F.min("first").alias("name"))
    shared = distinct.join(named.join(names, "component").select("fp", "name"), "fp", "left").where("n > 1 OR name IS NOT NULL")
    shared = shared.select("fp", F.coalesce("name", "first").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    salted = marks.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))  # copies share a fingerprint, but not a key
    return salted.join(shared, ["fp", "_salt"], "left").select(key, "fp", F.coalesce("component_id", key).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep the document with the smallest key of each component, with all columns.

    Rows with a null key stay; rows that repeat a key stay together if one of them is kept.
    """
    gone = near_duplicates(docs, text, key).groupBy(key).agg(F.min(F.col(key) > F.col("component_id")).alias("gone")).where("gone").select(key)
    return docs.join(gone, key, "left_anti")
