"""Bounded-space online packing: OPEN windows a partition, best fit, the fullest goes when none fits.

Each partition streams its documents' ids. Documents of CAPACITY ids or more give full windows first and
their rest is placed like any other piece: in the open window that it leaves fullest. When none has room
the fullest window is emitted; if that would pad more than GAP ids, the piece is cut to fill it. What is
still open at a partition's end is merged over MERGE partitions at a time by best fit, and what would be
padded more than GAP there is joined and cut, its last rest into powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

CAPACITY = 4096
OPEN = 64
GAP = 64
MERGE = 16

_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Windows:
    """At most `most` open windows; pieces are (doc, start, doc_tokens, ids)."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN, gap: int = GAP):
        self.capacity, self.most, self.gap = capacity, most, gap
        self.rooms: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, piece: tuple) -> Iterator[list]:
        """Yields the windows that this piece makes full or pushes out."""
        doc, start, total, ids = piece
        while len(ids) >= self.capacity:
            yield [(doc, start, total, ids[: self.capacity])]
            start, ids = start + self.capacity, ids[self.capacity :]
        if not len(ids):
            return
        k = bisect_left(self.rooms, (len(ids), -1))
        if k < len(self.rooms):
            free, window = self.rooms.pop(k)
        elif len(self.rooms) < self.most:
            free, window = self.capacity, self.made
            self.made += 1
            self.held[window] = []
        else:
            free, window = self.rooms.pop(0)
            pieces = self.held.pop(window)
            if free > self.gap:
                pieces.append((doc, start, total, ids[:free]))
                start, ids = start + free, ids[free:]
            yield pieces
            yield from self.place((doc, start, total, ids))
            return
        self.held[window].append((doc, start, total, ids))
        if free == len(ids):
            yield self.held.pop(window)
        else:
            insort(self.rooms, (free - len(ids), window))

    def rest(self) -> list[list]:
        out = [self.held[w] for _, w in self.rooms]
        self.rooms, self.held = [], {}
        return out


def merge(windows: list[list], capacity: int = CAPACITY, gap: int = GAP) -> list[list]:
    """Best fit over whole windows, largest first; what still has a gap is joined and cut."""
    size = lambda w: sum(len(p[3]) for p in w)
    rooms: list[tuple[int, int]] = []
    bins: list[list] = []
    for w in sorted(windows, key=size, reverse=True):
        n = size(w)
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            free, b = rooms.pop(k)
            bins[b] = bins[b] + w
        else:
            free, b = capacity, len(bins)
            bins.append(w)
        insort(rooms, (free - n, b))
    out = [bins[b] for free, b in rooms if free <= gap]
    loose = [p for free, b in rooms if free > gap for p in bins[b]]
    total = sum(len(p[3]) for p in loose)
    cuts = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if total % capacity >> k & 1]
    for room in cuts:
        own = []
        while room:
            doc, start, n, ids = loose[0]
            own.append((doc, start, n, ids[:room]))
            if len(ids) > room:
                loose[0] = (doc, start + room, n, ids[room:])
                room = 0
            else:
                loose.pop(0)
                room -= len(ids)
        out.append(own)
    return out


def _rows(window: list, sequence: int) -> list[tuple]:
    out, at = [], 0
    for doc, start, total, ids in window:
        out.append((doc, start, len(ids), total, sequence, at, ids.astype("<u4").tobytes()))
        at += len(ids)
    return out


_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
_KINDS = [pa.int64()] * 6 + [pa.binary()]


def pack(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, windows: int = OPEN, gap: int = GAP) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents, each id in one.

    Keys are integers, any other that doesn't cast to one is an error. Null and empty texts hold the end id alone; null
    keys and repeated rows are documents of their own; an empty table gives no rows. ids are little-endian unsigned 32-bit words. A sequence's pieces lie gapless
    from offset 0; a consumer pads it to capacity unless its length is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, state = np.array([end_id], "<u2"), Windows(capacity, windows, gap)
        number = part << 32

        def batch_of(rows: list[tuple], still_open: bool) -> pa.RecordBatch:
            cells = [pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)]
            return pa.RecordBatch.from_arrays([*cells, pa.array([part] * len(rows), pa.int32()), pa.array([still_open] * len(rows))], names=[*_NAMES, "part", "open"])

        rows: list[tuple] = []
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([enc.ids(words.as_py()), end])
                for window in state.place((doc, 0, len(ids), ids)):
                    rows += _rows(window, number)
                    number += 1
                if len(rows) >= 1024:
                    yield batch_of(rows, False)
                    rows = []
        if rows:
            yield batch_of(rows, False)
        rows = []
        for window in state.rest():
            rows += _rows(window, number)
            number += 1
        if rows:
            yield batch_of(rows, True)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        own = []
        for _, w in pdf.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=True):
            own.append([(None if pd.isna(d) else int(d), s, n, np.frombuffer(i, "<u4")) for d, s, n, i in zip(w.doc_id, w.start, w.doc_tokens, w.ids)])
        number = (1 << 62) + (int(pdf.part.min()) // MERGE << 32)
        out = [r for k, w in enumerate(merge(own, capacity, gap)) for r in _rows(w, number + k)]
        return pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = materialize(source.mapInArrow(run, _PIECES + ", part int, open boolean"), "windows")
    last = first.where("open").groupBy(F.floor(F.col("part") / MERGE)).applyInPandas(join, _PIECES)
    return first.where("not open").select(*_NAMES).unionByName(last)
