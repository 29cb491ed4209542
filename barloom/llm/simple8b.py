"""Simple-8b word-aligned coding of token ids, and its files.

A 64-bit word holds a 4-bit selector on top and 60 bits of payload: selector s packs COUNTS[s] ids of
WIDTHS[s] bits, lowest first. Selector 0 is the escape: the next word is one raw 64-bit id, for ids of
more than 60 bits. Ids are coded in blocks of BLOCK; a block starts at a word of its own and the payload
lists each block's first word, so blocks decode alone and all at once.

A file is a Parquet part of segments, a row each: part and segment number, ids before the segment in its
part, the documents' ids and lengths, and the payload: 4 bytes magic, block size, ids, words, the blocks'
first words (32-bit each), then the words, all little-endian. Parts are in ascending order of doc_id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

MAGIC = b"S8B1"
BLOCK = 1024
SEGMENT = 1 << 19
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_HEAD = struct.Struct("<4sIQI")
_U = np.uint64


_SMALL = np.array([sum(x >> w != 0 for w in WIDTHS) for x in range(1 << 16)], np.uint8)
_STEPS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (12, 8), 30: (15, 15), 60: (30, 30)}


def _selectors(need: np.ndarray, block: int) -> np.ndarray:
    """The selector that packs most ids from each place on, without leaving its block.

    The most demanding of c ids is the maximum of two shorter runs; rows are padded with 255, which fits nothing.
    """
    if not len(need):
        return np.zeros(0, np.int64)
    rows = -(-len(need) // block)
    grid = np.full((rows, block + max(COUNTS)), 255, np.uint8)
    whole = len(need) // block
    grid[:whole, :block] = need[: whole * block].reshape(whole, block)
    if whole < rows:
        grid[whole, : len(need) - whole * block] = need[whole * block :]
    flat = grid.reshape(-1)
    runs = {1: flat}
    sel = np.where(flat < len(WIDTHS), np.uint8(len(WIDTHS) - 1), np.uint8(0))
    for count, (a, b) in _STEPS.items():
        most = np.full(len(flat), 255, np.uint8)
        np.maximum(runs[a][:-a], runs[b][a:], out=most[:-a])
        runs[count] = most
        fits = most <= COUNTS.index(count, 1)
        np.copyto(sel, np.uint8(COUNTS.index(count, 1)), where=fits)
    return sel.reshape(rows, -1)[:, :block].reshape(-1)[: len(need)].astype(np.int64)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The payload of any unsigned ids of up to 64 bits."""
    n = len(ids)
    v = np.ascontiguousarray(ids, dtype=_U)
    need = np.zeros(n, np.uint8)  # the first selector wide enough for an id, len(WIDTHS) if it must be escaped
    if n and int(v.max()) < len(_SMALL):
        need = _SMALL[v.astype(np.int64)]
    else:
        for width in WIDTHS:
            need += v >> _U(width) != 0
    sel = _selectors(need, block)
    at = np.arange(0, n, block)
    take = np.zeros(len(at) * block, np.int64)
    take[:n] = np.array(COUNTS)[sel]
    after = np.arange(len(at) * (block + 1)).reshape(-1, block + 1)  # the next word's place; a block that is done stays where it ends
    after[:, :block] += take.reshape(-1, block)
    after = after.reshape(-1)
    live = np.arange(len(at)) * (block + 1)
    steps = [live]
    while not np.array_equal(live, moved := after[live]):  # a step of all blocks at once
        steps.append(live := moved)
    walked = np.stack(steps, axis=1).reshape(-1)
    walked = walked[after[walked] > walked]
    starts = walked - walked // (block + 1)
    chosen = sel[starts]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), _U)
    for s in np.unique(chosen).tolist():
        own = chosen == s
        if s == 0:
            words[place[own] + 1] = v[starts[own]]
            continue
        first = starts[own]
        word = v[first] | (_U(s) << _U(60))
        for k in range(1, COUNTS[s]):
            word |= v[first + k] << _U(k * WIDTHS[s])
        words[place[own]] = word
    firsts = place[np.searchsorted(starts, at)] if n else np.zeros(0, np.int64)
    return _HEAD.pack(MAGIC, block, n, len(words)) + firsts.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def _open(payload: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    magic, block, n, n_words = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b payload")
    blocks = -(-n // block)
    firsts = np.frombuffer(payload, "<u4", blocks, _HEAD.size)
    return block, n, firsts, np.frombuffer(payload, "<u8", n_words, _HEAD.size + 4 * blocks)


def _unpack(words: np.ndarray) -> np.ndarray:
    sel = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    at = np.flatnonzero(sel == 0)
    k = 0
    while k < len(at):  # a raw word may look like any other, so escapes are taken in order
        if not raw[at[k]]:
            raw[at[k] + 1] = True
        k += 1
    heads = ~raw
    counts = np.where(heads, np.array(COUNTS + (0,))[sel], 0)
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), _U)
    for s in np.unique(sel[heads]).tolist():
        own = np.flatnonzero(heads & (sel == s))
        if s == 0:
            out[place[own]] = words[own + 1]
            continue
        mask = _U((1 << WIDTHS[s]) - 1)
        first, word = place[own], words[own]
        for k in range(COUNTS[s]):
            out[first + k] = word >> _U(k * WIDTHS[s]) & mask
    return out


def decode(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids [start, stop), reading only the blocks that hold them."""
    block, n, firsts, words = _open(payload)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, _U)
    low, high = start // block, -(-stop // block)
    own = words[firsts[low] : firsts[high] if high < len(firsts) else len(words)]
    return _unpack(own)[start - low * block : stop - low * block]


_SEGMENTS = "part int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append end_id, and write the ids in ascending order of key to files at path.

    Keys are integers, any other that doesn't cast to one is an error. Null and empty texts hold the end id alone; a null key comes first; rows that repeat a key stay, in
    order of their texts; an empty table writes a folder without segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u2")
        keys: list = []
        ids: list[np.ndarray] = []
        held = before = segment = 0

        def row() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            cells = [[part], [segment], [before], [held], [keys], [lengths], [encode(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names=["part", "segment", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for own, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.concatenate([enc.ids(words.as_py()), end])
                if held and held + len(got) > SEGMENT:
                    yield row()
                    before, segment, held, keys, ids = before + held, segment + 1, 0, [], []
                keys.append(own)
                ids.append(got)
                held += len(got)
        if held:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: ids are little-endian unsigned 32-bit words."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode(r["payload"]).astype("<u4")
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                places = pa.array(np.concatenate([[0], 4 * ends]), pa.int32())
                cells = pa.Array.from_buffers(pa.binary(), len(ends), [None, places.buffers()[1], pa.py_buffer(ids)])
                starts = r["base"] + r["before"] + ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), cells], names=["doc_id", "start", "n_tokens", "ids"])

    placed = files.select("part", "before", "doc_ids", "lengths", "payload").join(F.broadcast(bases), "part")  # 12 bytes for each file
    return placed.select("base", "before", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
