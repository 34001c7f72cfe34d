"""Benchmark decontamination with SimHash item windows.

Shingles (five words) of the benchmark items are filed in an inverted list. In
a document only items with enough hits to reach the threshold at all are looked
at (similarity 3/4 needs 3/7 of both sizes in common), and of its windows as
long as the item only those that hold as many. Each of these is fingerprinted:
``BITS`` bits, each the sign of a sum over the window's shingles, the k-th
occurrence of a shingle having a hash of its own. A multi-index cuts the bits
into ``BLOCKS`` blocks: fingerprints within Hamming distance ``RADIUS`` agree in
at least ``BLOCKS - RADIUS`` of them, so windows that do not are dropped, and
none within the radius is. The rest is verified by the exact weighted Jaccard
similarity of the shingles, weights being how often a shingle occurs; 0.75 and
more is a leak.

As every occurrence is an element of weight 1, the weighted Jaccard similarity
is the plain one of these elements, and shingles that repeat do not dominate
the sums. At similarity 0.75 the cosine of the two is 6/7 at least, and so a
bit differs with probability 0.172 (0.19 for sets of three and four, where sums
can be 0): 44 of 256 bits with a deviation of 6.0; the radius of 80 lies more
than five deviations out. Unrelated fingerprints agree in 32 of 128 blocks with
a deviation of 4.9, so the 48 needed let one in a thousand pass.

Items are indexed in blocks of bounded text size, one after the other on the
driver, and sent to the workers as broadcast files; documents are scanned once,
where they lie, without a shuffle. With several blocks a worker holds one at a
time and takes larger pieces of text.

Defined results: null, empty and blank texts match nothing, on either side.
With fewer than five words the whole sequence is one shingle, so short items
match only documents that are that sequence; a document shorter than an item
is one window. Texts of any length are searched whole. Items that repeat are
reported each; ids may be null or repeat; empty tables give no rows. Other
columns are not touched, and their names may be those of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.llm import textkernel as tk
from issq.llm.common import session_limits

BITS = 256
BLOCKS = 128
RADIUS = 80
#: Threshold NUM / DEN.
NUM, DEN = 3, 4
#: Text bytes of the items held by a worker at a time.
ITEM_BYTES = 32 << 20
#: Text bytes searched at a time where the items are several blocks.
WIDE_PIECE = 48 << 20
#: Windows fingerprinted at a time.
WINDOWS = 2048
_SHIFTS = np.arange(64, dtype=np.uint64)
_SALTS = (0x1234567, 0x89ABCDEF, 0x3C6EF372, 0x5BE0CD19)  # one for 64 bits


def bit_signs(shingle: np.ndarray) -> np.ndarray:
    """One row of +1/-1 a shingle."""
    halves = [((tk.mix(shingle + np.uint64(salt))[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int16) for salt in _SALTS]
    return np.hstack(halves) * 2 - 1


def ranked(shingle: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A hash of its own for each occurrence of a shingle; the first keeps it."""
    return np.where(rank > 0, tk.mix(shingle ^ tk.mix(rank.astype(np.uint64))), shingle)


def window_sums(shingle: np.ndarray, width: int) -> np.ndarray:
    """One row of ``BITS`` sums for each window of ``width`` shingles."""
    n = len(shingle)
    order = np.argsort(shingle, kind="stable")
    same = np.cumsum(np.concatenate([[0], shingle[order][1:] != shingle[order][:-1]])) * (n + width + 1)
    place, own = same + order, np.arange(n)
    enter, leave = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    # Occurrences before it in the window it ends, behind it in the one it starts.
    enter[order] = own - np.searchsorted(place, np.maximum(place - width + 1, same))
    leave[order] = np.searchsorted(place, place + width) - own - 1
    signs = bit_signs(ranked(shingle, enter))
    came = np.zeros((n + 1, BITS), dtype=np.int32)
    np.cumsum(signs, axis=0, out=came[1:])
    went = came
    other = np.flatnonzero(enter != leave)
    if len(other):
        signs[other] = bit_signs(ranked(shingle[other], leave[other]))
        went = np.zeros((n + 1, BITS), dtype=np.int32)
        np.cumsum(signs, axis=0, out=went[1:])
    return came[width:] - went[: n - width + 1]


def in_blocks(prints: np.ndarray) -> np.ndarray:
    """Block values of fingerprints: one small number a block."""
    width = BITS // BLOCKS
    return (prints.reshape(len(prints), BLOCKS, width) @ (1 << np.arange(width))).astype(np.uint8)


class Items:
    """Shingle sets, inverted list and fingerprint blocks of the items."""

    def __init__(self, ids: list, texts: list[str | None]):
        arr = pa.array([t or "" for t in texts], pa.string())
        _, _, _, at, words = tk.words_of(arr)
        sh, off = tk.shingles(words, at)
        self.ids = [i for i, n in zip(ids, np.diff(off)) if n]
        self.sets = [np.unique(sh[a:b], return_counts=True) for a, b in zip(off[:-1], off[1:]) if b > a]
        self.size = np.array([int(c.sum()) for _, c in self.sets], dtype=np.int64)
        prints = np.array([bit_signs(ranked(np.repeat(k, c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c))).sum(axis=0) > 0 for k, c in self.sets])
        self.blocks = in_blocks(prints.reshape(len(self.sets), BITS))
        owner = np.repeat(np.arange(len(self.sets)), [len(k) for k, _ in self.sets])
        keys = np.concatenate([k for k, _ in self.sets]) if self.sets else np.zeros(0, dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.gate = np.zeros(1 << 20, dtype=bool)
        self.gate[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def near(self, blocks: np.ndarray, item: int) -> np.ndarray:
        """Which windows can lie within the radius of the item's fingerprint."""
        return (blocks == self.blocks[item]).sum(axis=1) >= BLOCKS - RADIUS

    def similarity(self, window: np.ndarray, item: int) -> float:
        keys, counts = np.unique(window, return_counts=True)
        own, weights = self.sets[item]
        pos = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        common = np.minimum(counts[pos], weights)[keys[pos] == own].sum()
        return float(common) / float(len(window) + self.size[item] - common)

    def hits(self, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the document's shingles that are an item's, by item
        and place, for items with enough of them."""
        some = np.flatnonzero(self.gate[(shingle >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, shingle[some], "left"), np.searchsorted(self.keys, shingle[some], "right")
        times = hi - lo
        at = np.repeat(some, times)
        item = self.owner[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(int(times.sum()))] if times.any() else at
        keep = np.bincount(item, minlength=len(self.size))[item] >= needed(np.minimum(self.size, len(shingle)), self.size)[item]
        order = np.argsort(item[keep], kind="stable")
        return at[keep][order], item[keep][order]

    def leaks(self, shingle: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Best window of each leaked item in one document's shingles:
        (item, similarity, first shingle, shingles)."""
        at, item = self.hits(shingle)
        if not len(at):
            return []
        runs = np.append(np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])), len(item))
        starts: dict[int, list[tuple[int, np.ndarray]]] = {}  # by window length: (item, windows that hold enough hits)
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
            k, places = int(item[a]), at[a:b]
            width = min(int(self.size[k]), len(shingle))
            top = len(shingle) - width
            need = int(needed(width, self.size[k]))
            inner = np.arange(max(int(places[0]) - width + 1, 0), min(int(places[-1]), top) + 1)
            spread = inner[np.searchsorted(places, inner + width) - np.searchsorted(places, inner) >= need]
            if len(spread):
                starts.setdefault(width, []).append((k, spread))
        best = []
        for width, wanted in starts.items():
            found = {k: (0.0, 0) for k, _ in wanted}
            every = np.unique(np.concatenate([s for _, s in wanted]))
            for a in range(0, len(every), WINDOWS):
                some = every[a : a + WINDOWS]
                blocks = np.concatenate([
                    in_blocks(window_sums(shingle[int(run[0]) : int(run[-1]) + width], width)[run - run[0]] > 0)
                    for run in np.split(some, np.flatnonzero(np.diff(some) > width) + 1)
                ])
                for k, own in wanted:
                    mine = np.flatnonzero(np.isin(some, own, assume_unique=True))
                    for w in mine[self.near(blocks[mine], k)].tolist():
                        s = self.similarity(shingle[some[w] : some[w] + width], k)
                        if s > found[k][0]:
                            found[k] = (s, int(some[w]))
            best += [(k, s, w, width) for k, (s, w) in found.items() if s * DEN >= NUM]
        return sorted(best)


def needed(width, size):
    """Least weight in common at the threshold: 3/7 of both sizes."""
    return -(-NUM * (width + size) // (NUM + DEN))


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _scan(texts: pa.Array, blocks: list, wide: bool) -> Iterator[tuple]:
    """(items, row, bytes, starts, ends, leaks) of the rows that leak."""
    for a, b in tk.pieces(texts, WIDE_PIECE if wide else tk.PIECE):
        part = texts.slice(a, b - a)
        _, starts, ends, at, words = tk.words_of(part)
        sh, off = tk.shingles(words, at)
        raw, offsets = tk.buffers(part)
        for block in blocks:
            items = block.value
            touched = np.flatnonzero(items.gate[(sh >> np.uint64(44)).astype(np.int64)])
            for d in np.unique(np.searchsorted(off, touched, side="right") - 1).tolist():
                found = items.leaks(sh[off[d] : off[d + 1]])
                if found:
                    yield items, a + d, raw, int(offsets[d]), starts[at[d] : at[d + 1]], ends[at[d] : at[d + 1]], found
            if wide:
                del items, block._value  # read again for the next piece: one block is held


def _rows(batches: Iterator[pa.RecordBatch], blocks: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    wide = len(blocks) > 1
    for batch in gathered(batches, WIDE_PIECE if wide else 0):
        out = []
        for items, row, raw, base, starts, ends, found in _scan(tk.no_nulls(batch.column(1)), blocks, wide):
            for k, s, first, width in found:
                last = min(first + width + tk.SHINGLE - 1, len(starts))
                points = [int(((raw[base:x] & 0xC0) != 0x80).sum()) for x in (starts[first], ends[last - 1])]
                out.append((batch.column(0)[row].as_py(), items.ids[k], s, first, last - first, *points))
        cols = list(zip(*out)) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _filter(batches: Iterator[pa.RecordBatch], blocks: list, text_col: str) -> Iterator[pa.RecordBatch]:
    wide = len(blocks) > 1
    for batch in gathered(batches, WIDE_PIECE if wide else 0):
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[[row for _, row, *_ in _scan(tk.no_nulls(batch.column(text_col)), blocks, wide)]] = False
        yield batch.filter(pa.array(keep))


def item_blocks(bench: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcasts of the items in blocks of bounded text size, gathered and
    indexed one at a time."""
    rows = bench.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, out = int(total // ITEM_BYTES) + 1, []
    for k in range(n):
        part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).orderBy("id", "text").collect()
        items = Items([r["id"] for r in part], [r["text"] for r in part])
        if items.ids:
            out.append(bench.sparkSession.sparkContext.broadcast(items))
    return out


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document row, leaked item): doc_id, item_id, similarity
    (of the best window, the first of equals), first_word, n_words, start and
    stop (code points, end exclusive)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    session_limits(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", bench.schema[item_col].dataType), T.StructField("similarity", T.DoubleType()),
        *[T.StructField(c, T.LongType()) for c in ("first_word", "n_words", "start", "stop")],
    ])
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = item_blocks(bench, item_col, item_text)
    if not blocks:
        return docs.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(lambda it: _rows(it, blocks, arrow), schema)


def without_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns kept."""
    session_limits(docs.sparkSession)
    blocks = item_blocks(bench, item_col, item_text)
    return docs.mapInArrow(lambda it: _filter(it, blocks, text_col), docs.schema) if blocks else docs
