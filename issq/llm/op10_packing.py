"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Class k holds pieces of length capacity // k, and a sequence of class k takes
exactly k of them, so each class fills its sequences with a fixed count and
workers need not know of each other (no shuffle). A document's remainder is
cut greedily: the largest class length that fits, then again on the rest. The
rest shrinks at least quadratically, so documents fall into few pieces. When
what is left is within ``slack`` of a class length it takes that slot and the
difference is padding. At the end of a worker's input each class has at most
k - 1 pieces open (a bounded number); they are joined, cut at the capacity,
and the last stretch is cut into powers of two, which need no padding.

Defined results: null text counts as empty, and an empty document is its one
end token; ids may be null or repeat; an empty table gives no rows. Sequence
ids are (partition << 40) + a counter, the same when a task runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.llm import textkernel as tk
from issq.llm.bpe import coder
from issq.llm.common import session_limits

CAPACITY = 4096
END_ID = 2
#: Classes above this number are only those whose length is a power of two.
FINE_CLASSES = 64
SLACK = 0.01
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Classes:
    """Slot lengths and how a length is cut into them."""

    def __init__(self, capacity: int = CAPACITY, slack: float = SLACK):
        self.capacity, self.slack = capacity, slack
        counts = [k for k in range(1, capacity + 1) if k <= FINE_CLASSES or (capacity % k == 0 and k & (k - 1) == 0)]
        self.count = {capacity // k: k for k in reversed(counts)}  # of equal lengths the smaller k
        self.lengths = sorted(self.count, reverse=True)
        self._memo: dict[int, list[tuple[int, int]]] = {}

    def cut(self, n: int) -> list[tuple[int, int]]:
        """(length, slot) pieces of n tokens, in order."""
        whole, rest = divmod(n, self.capacity)
        out = [(self.capacity, self.capacity)] * whole
        if rest:
            if rest not in self._memo:
                got, left = [], rest
                while left:
                    over = min((s for s in self.lengths if s >= left), default=0)
                    if over - left <= self.slack * over:
                        got.append((left, over))
                        break
                    slot = next(s for s in self.lengths if s <= left)
                    got.append((slot, slot))
                    left -= slot
                self._memo[rest] = got
            out = out + self._memo[rest]
        return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, slack: float, end_id: int) -> Iterator[pa.RecordBatch]:
    model, classes = coder(path), Classes(capacity, slack)
    next_id = TaskContext.get().partitionId() << 40
    open_: dict[int, list] = {}  # slot -> [sequence id, pieces, offset]
    waiting: dict[int, list] = {}  # slot -> pieces of the sequence being filled
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    id_type = None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found)) if found else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:]], names=names)

    for batch in batches:
        id_type = batch.schema.field(0).type
        texts = tk.no_nulls(batch.column(1))
        for a, b in tk.pieces(texts):
            ids, off, *_ = model.encode(texts.slice(a, b - a))
            keys, found = batch.column(0).slice(a, b - a).to_pylist(), []
            for d, key in enumerate(keys):
                mine = np.append(ids[off[d] : off[d + 1]], np.uint32(end_id)).astype("<u4")
                start = 0
                for length, slot in classes.cut(len(mine)):
                    piece = (key, start, length, mine[start : start + length].tobytes(), len(mine))
                    start += length
                    bin_ = waiting.setdefault(slot, [])
                    bin_.append(piece)
                    if len(bin_) == classes.count[slot]:
                        at = 0
                        for key_, s, n, data, total in bin_:
                            found.append((key_, s, n, zlib.crc32(data), total, next_id, at))
                            at += n
                        next_id += 1
                        bin_.clear()
            if found:
                yield rows(found)
    # Open sequences: fewer than k pieces of each class, whatever the input's size.
    found, used, room = [], 0, None
    total = sum(p[2] for bin_ in waiting.values() for p in bin_)
    for slot in classes.lengths:
        for key, start, n, data, doc in waiting.get(slot, []):
            while n:
                if not room:
                    room = capacity if total >= capacity else 1 << (total.bit_length() - 1)
                    used = 0
                take = min(n, room - used)
                found.append((key, start, take, zlib.crc32(data[: 4 * take]), doc, next_id, used))
                start, n, data, used, total = start + take, n - take, data[4 * take :], used + take, total - take
                if used == room:
                    next_id, room = next_id + 1, None
    if found:
        yield rows(found)


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: float = SLACK, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (see the module's docstring)."""
    session_limits(df.sparkSession)
    schema = PIECES.format(id=df.schema[id_col].dataType.simpleString())
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer_path, capacity, slack, end_id), schema)
