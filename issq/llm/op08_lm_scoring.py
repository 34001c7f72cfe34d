"""Language-model scoring with a hidden Markov model.

Tokens are words and one end per document. The most frequent words have ids of
their own and every state its distribution over them; all other words share
the id "rare", and which rare word it is follows from corpus counts with
absolute discounting, what is discounted going to a spelling model (bytes given
the two before). Together this gives every text a probability.

1. Word counts of all training documents: each task merges its own, sends them
   by hash bucket, buckets are summed. N, V, the frequent words and the
   discount come from these.
2. Every document becomes ids; its rare words go to their buckets, meet the
   counts there and come back as sums by document. Frequent words are looked
   up before, so no bucket gets more than an even share: a rare word occurs at
   most N / ``HEADS`` times in training.
3. Baum-Welch: a bounded sample sets the start, then each round sums expected
   counts over all training documents, partition by partition, by slices of
   the vocabulary. Long documents train in segments.
4. The scaled forward recursion scores every whole document exactly.

Words are told apart by 64-bit hashes of their lowered bytes.

Defined results: null text counts as empty, i.e. one end token; without
training rows N = V = 0 and the model is uniform; null ids count as '' for
holding out; ids may repeat (one row out per row in); an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.llm import hmm
from issq.llm import textkernel as tk
from issq.llm.common import Scratch, even_keys, held_out, parts, session_limits

#: Ids: 0 rare, 1 end, then the frequent words.
RARE, END = 0, 1
HEADS = 16_384
STATES = 12
ROUNDS = 2
#: Blocks of documents whose ids set the start of training.
SAMPLE_BLOCKS = 4
BLOCK_BYTES = 6 << 20
MERGE = 1_500_000
SLICES = 64
ROUTED = "key int, kind int, block long, n long, a binary, b binary, c binary, d binary"
_NAMES = ["key", "kind", "block", "n", "a", "b", "c", "d"]
COUNT, SPELL, TOP, ASK, IDS, REPLY = range(6)

# Spelling: context classes of bytes; 0 stands for the word's edge.
CLASSES = 48
_KIND = np.zeros(256, dtype=np.int32)
for _b in range(256):
    if 97 <= _b < 123:
        _KIND[_b] = _b - 96
    elif 48 <= _b < 58:
        _KIND[_b] = 27
    elif _b < 128:
        _KIND[_b] = 28 + _b % 4
    elif _b < 192:
        _KIND[_b] = 32 + _b % 12
    else:
        _KIND[_b] = 44 + min(_b - 192, 3)
CELLS = CLASSES * CLASSES * 256


def _row(key: int, kind: int, block: int = 0, n: int = 0, a=b"", b=b"", c=b"", d=b"") -> tuple:
    raw = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in (a, b, c, d)]
    return (key, kind, block, n, *raw)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 8
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(ids, held out, texts) in blocks of about ``BLOCK_BYTES``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(2).nbytes
        if size >= BLOCK_BYTES:
            yield from _cut(held)
            held, size = [], 0
    if held:
        yield from _cut(held)


def _cut(held: list[pa.RecordBatch]):
    table = pa.Table.from_batches(held).combine_chunks()
    texts = tk.no_nulls(table.column(2))
    ids, out = table.column(0).combine_chunks(), table.column(1).combine_chunks()
    for a, b in tk.pieces(texts, BLOCK_BYTES):
        yield ids.slice(a, b - a), out.slice(a, b - a), texts.slice(a, b - a)


def cells(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spelling cell of every byte, and of the end of every word."""
    kind = _KIND[buf]
    one, two = np.zeros_like(kind), np.zeros_like(kind)
    one[1:], two[2:] = kind[:-1], kind[:-2]
    one[starts], two[starts] = 0, 0
    more = starts[ends - starts > 1] + 1
    two[more] = 0
    last = kind[ends - 1]
    prior = np.where(ends - starts > 1, kind[np.maximum(ends - 2, 0)], 0)
    return (two * CLASSES + one) * 256 + buf, (prior * CLASSES + last) * 256 + 32


def merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, c = h[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[head], np.add.reduceat(c, head) if len(h) else c


def _split(h: np.ndarray, n: int) -> list[np.ndarray]:
    """Indexes by bucket; h is sorted, and stays so within a bucket."""
    bucket = ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n)))


def _count(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    hashes, counts, size = [], [], 0
    spelled = np.zeros(CELLS, dtype=np.int64)

    def send() -> Iterator[pa.RecordBatch]:
        h, c = merged(hashes, counts)
        for k, i in enumerate(_split(h, len(keys))):
            if len(i):
                yield _batch([_row(keys[k], COUNT, n=len(i), a=h[i], b=c[i].astype(np.int32))])

    for _, out, texts in blocks(batches):
        train = texts.filter(pc.invert(out))
        if not len(train):
            continue
        buf, starts, ends, _, h = tk.words_of(train)
        u, first, c = np.unique(h, return_index=True, return_counts=True)
        at_byte, at_end = cells(buf, starts, ends)
        lens = (ends - starts)[first]
        pos = np.repeat(starts[first] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum())) if len(first) else first
        spelled += np.bincount(at_byte[pos], minlength=CELLS) + np.bincount(at_end[first], minlength=CELLS)
        hashes.append(u)
        counts.append(c)
        size += len(u)
        if size > MERGE:
            h, c = merged(hashes, counts)
            hashes, counts, size = [h], [c], len(h)
            if size > MERGE // 2:
                yield from send()
                hashes, counts, size = [], [], 0
    yield from send()
    step = -(-CELLS // SLICES)
    for s in range(SLICES):
        part = spelled[s * step : (s + 1) * step]
        some = np.flatnonzero(part)
        if len(some):
            yield _batch([_row(keys[s % len(keys)], SPELL, block=s, a=some.astype(np.int32), b=part[some])])


def _sum_counts(batches: Iterator[pa.RecordBatch], n_buckets: int, heads: int) -> Iterator[pa.RecordBatch]:
    hashes, counts, key = [], [], 0
    step = -(-CELLS // SLICES)
    spelled: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == COUNT:
                key = r["key"]
                hashes.append(np.frombuffer(r["a"], dtype=np.uint64))
                counts.append(np.frombuffer(r["b"], dtype=np.int32).astype(np.int64))
            else:
                some = np.frombuffer(r["a"], dtype=np.int32)
                spelled.setdefault(r["block"], np.zeros(step, dtype=np.int64))[some] += np.frombuffer(r["b"], dtype=np.int64)
        if len(hashes) > 64:
            h, c = merged(hashes, counts)
            hashes, counts = [h], [c]
    h, c = merged(hashes, counts)
    for a in range(0, len(h), 1 << 18):
        hh, cc = h[a : a + (1 << 18)], c[a : a + (1 << 18)]
        facts = np.array([len(hh), cc.sum(), (cc == 1).sum(), (cc == 2).sum()], dtype=np.int64)
        yield _batch([_row(key, COUNT, n=len(hh), a=hh, b=cc, d=facts)])
    # A bucket's share of the frequent words, with room for chance.
    top = np.argsort(-c, kind="stable")[: 4 * heads // n_buckets + 64]
    if len(top):
        yield _batch([_row(key, TOP, n=len(top), a=h[top], b=c[top])])
    for s, x in spelled.items():
        yield _batch([_row(key, SPELL, block=s, a=x)])


class Lexicon:
    """What every worker knows of the corpus: bounded whatever its size."""

    def __init__(self, heads: np.ndarray, head_counts: np.ndarray, n_types: int, n_words: int, ones: int, twos: int, n_docs: int, spelled: np.ndarray):
        order = np.argsort(heads)
        self.heads = heads[order]
        self.head_counts = head_counts[order].astype(np.int64)
        self.gate = np.zeros(1 << 18, dtype=bool)
        self.gate[(self.heads >> np.uint64(46)).astype(np.int64)] = True
        self.n_docs = n_docs
        self.tokens = n_words + n_docs
        self.types = n_types + (n_docs > 0)
        rare_types, self.rare_tokens = n_types - len(heads), n_words - int(head_counts.sum())
        self.discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
        self.novel = self.discount * rare_types / self.rare_tokens if self.rare_tokens else 1.0
        two = spelled.reshape(CLASSES, CLASSES, 256).astype(np.float64)
        one = two.sum(axis=0)
        base = (one + 0.1) / (one.sum(axis=1, keepdims=True) + 25.6)
        self.spelling = np.log10((two + 2.0 * base[None]) / (two.sum(axis=2, keepdims=True) + 2.0)).astype(np.float32).ravel()

    @property
    def size(self) -> int:
        return len(self.heads) + 2

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + self.types + 1.0))

    def floor(self) -> np.ndarray:
        x = np.concatenate([[self.rare_tokens + 1.0, self.n_docs + 1.0], self.head_counts])
        return x / x.sum()

    def rare(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of a rare word's probability among rare words."""
        known = np.maximum(c - self.discount, 0) / self.rare_tokens if self.rare_tokens else 0.0
        mass = np.log10(self.novel) + spelled
        return np.where(c > 0, np.log10(known * (c > 0) + 10.0 ** np.maximum(mass, -300)), mass)


def _encode(batches: Iterator[pa.RecordBatch], lex: Lexicon, keys: list[int]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for doc_ids, out, texts in blocks(batches):
        n = len(texts)
        buf, starts, ends, at, h = tk.words_of(texts)
        ids = np.zeros(len(h), dtype=np.int16)
        if len(lex.heads):
            i = np.flatnonzero(lex.gate[(h >> np.uint64(46)).astype(np.int64)])
            j = np.minimum(np.searchsorted(lex.heads, h[i]), len(lex.heads) - 1)
            hit = lex.heads[j] == h[i]
            ids[i[hit]] = (j[hit] + 2).astype(np.int16)
        doc = np.repeat(np.arange(n), np.diff(at))
        seq = np.full(len(h) + n, END, dtype=np.int16)
        seq[np.arange(len(h)) + doc] = ids
        held = out.to_numpy(zero_copy_only=False)
        keys_ = pa.array(doc_ids).cast(pa.int64())
        known = keys_.is_valid().to_numpy(zero_copy_only=False)
        plain = keys_.fill_null(0).to_numpy(zero_copy_only=False)
        yield _batch([_row(keys[number % len(keys)], IDS, number, n, seq, (at + np.arange(n + 1)).astype(np.int64), np.stack([plain, known, held], axis=1).astype(np.int64), b"")])
        rare = np.flatnonzero(ids == RARE)
        if len(rare):
            at_byte, at_end = cells(buf, starts, ends)
            total = np.zeros(len(buf) + 1)
            np.cumsum(lex.spelling[at_byte], out=total[1:])
            spelled = (total[ends[rare]] - total[starts[rare]] + lex.spelling[at_end[rare]]).astype(np.float32)
            order = np.argsort(h[rare])
            hr, dr, sr = h[rare][order], doc[rare][order].astype(np.uint32), spelled[order]
            small = np.uint16 if n <= 65536 else np.uint32
            yield _batch([_row(keys[k], ASK, number, n, hr[i], dr[i].astype(small), sr[i]) for k, i in enumerate(_split(hr, len(keys))) if len(i)])
        number += 1


def _answer(batches: Iterator[pa.RecordBatch], lex: Lexicon) -> Iterator[pa.RecordBatch]:
    """Documents' ids pass through; questions wait for the bucket's counts."""
    hashes, counts, asked = [], [], []
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        if (kinds == IDS).any():
            yield batch.filter(pa.array(kinds == IDS))
        for r in batch.filter(pa.array(kinds != IDS)).to_pylist():
            if r["kind"] == COUNT:
                hashes.append(np.frombuffer(r["a"], dtype=np.uint64))
                counts.append(np.frombuffer(r["b"], dtype=np.int64))
            else:
                asked.append((r["block"], r["n"], r["a"], r["b"], r["c"]))
    h, c = merged(hashes, counts)
    for block, n, a, b, s in asked:
        ask = np.frombuffer(a, dtype=np.uint64)
        doc = np.frombuffer(b, dtype=np.uint16 if n <= 65536 else np.uint32).astype(np.int64)
        found = np.zeros(len(ask), dtype=np.int64)
        if len(h):
            pos = np.minimum(np.searchsorted(h, ask), len(h) - 1)
            found = np.where(h[pos] == ask, c[pos], 0)
        some = np.unique(doc)
        total = lambda x: np.bincount(doc, weights=x, minlength=n)[some]
        yield _batch([_row(0, REPLY, block, len(some), some.astype(np.int32), total(lex.base(found)), total(lex.rare(found, np.frombuffer(s, dtype=np.float32).astype(float))), total(found > 0).astype(np.int32))])


def _read_ids(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["a"], dtype=np.int16).astype(np.int64), np.frombuffer(r["b"], dtype=np.int64), np.frombuffer(r["c"], dtype=np.int64).reshape(-1, 3)


def _only(ids: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(offsets)
    return ids[np.repeat(keep, lens)], np.concatenate([[0], np.cumsum(lens[keep])])


def _expected(batches: Iterator[pa.RecordBatch], p: hmm.Params, keys: list[int]) -> Iterator[pa.RecordBatch]:
    counts, some = hmm.Counts(p.states, len(p.emit)), False
    for batch in batches:
        for r in batch.to_pylist():
            ids, offsets, facts = _read_ids(r)
            ids, offsets = _only(ids, offsets, facts[:, 2] == 0)
            if len(ids):
                hmm.expect(ids, offsets, p, counts)
                some = True
    if some:
        small = np.concatenate([counts.start, counts.follow, counts.move.ravel()])
        for s, part in enumerate(np.array_split(counts.emit, SLICES)):
            yield _batch([_row(keys[s % len(keys)], COUNT, s, a=part.astype(np.float32), b=small if s == 0 else b"")])


def _sum_expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            got = [np.frombuffer(r["a"], dtype=np.float32).astype(float), np.frombuffer(r["b"], dtype=float)]
            old = sums.get(r["block"])
            sums[r["block"]] = got if old is None else [x + y for x, y in zip(old, got)]
    if sums:
        yield _batch([_row(0, COUNT, s, a=x, b=y) for s, (x, y) in sums.items()])


def _final(table: pa.Table, lex: Lexicon, p: hmm.Params) -> pa.Table:
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == IDS)
    ids, offsets, facts = _read_ids(own)
    n = own["n"]
    base, rare, known = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    for r in sorted((r for r in rows if r["kind"] == REPLY), key=lambda r: (r["a"], r["b"])):
        d = np.frombuffer(r["a"], dtype=np.int32)
        base[d] += np.frombuffer(r["b"], dtype=float)
        rare[d] += np.frombuffer(r["c"], dtype=float)
        known[d] += np.frombuffer(r["d"], dtype=np.int32)
    count = np.concatenate([[0, lex.n_docs], lex.head_counts])
    value = lex.base(count)
    value[RARE] = 0
    base += tk.sums(value[ids], offsets)
    known += tk.sums(((count > 0) & (np.arange(len(count)) != RARE)).astype(np.int64)[ids], offsets)
    score = hmm.log10_likelihood(ids, offsets, p) + rare
    return pa.table({
        "doc_id": pa.array(facts[:, 0], mask=facts[:, 1] == 0), "held_out": pa.array(facts[:, 2] == 1), "n_tokens": np.diff(offsets), "n_known": known,
        "train_tokens": np.full(n, lex.tokens, dtype=np.int64), "base_score": base, "score": score,
    })


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, heads: int = HEADS, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``df``; see the module's docstring. Integer ids."""
    spark = df.sparkSession
    session_limits(spark)
    n_parts = parts(spark)
    keys = even_keys(spark, n_parts)
    scratch = Scratch(spark, "lm")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(id_col, modulus, remainder).alias("out"), F.col(f"`{text_col}`").alias("text"))
    n_docs = rows.where(~F.col("out")).count()
    counted = rows.where(~F.col("out")).mapInArrow(lambda it: _count(it, keys), ROUTED).repartition(n_parts, "key")
    counted = scratch.table(counted.mapInArrow(lambda it: _sum_counts(it, n_parts, heads), ROUTED), "counts")
    facts = np.zeros(4, dtype=np.int64)
    for r in counted.where(F.col("kind") == COUNT).groupBy(F.spark_partition_id()).agg(F.collect_list("d").alias("d")).collect():
        for d in r["d"]:
            facts += np.frombuffer(d, dtype=np.int64)
    top = [(np.frombuffer(r["a"], dtype=np.uint64), np.frombuffer(r["b"], dtype=np.int64)) for r in counted.where(F.col("kind") == TOP).select("a", "b").collect()]
    h, c = (np.concatenate([t[k] for t in top]) for k in (0, 1)) if top else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    best = np.lexsort((h, -c))[:heads]
    step = -(-CELLS // SLICES)
    spelled = np.zeros(step * SLICES, dtype=np.int64)
    for r in counted.where(F.col("kind") == SPELL).select("block", "a").collect():
        spelled[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["a"], dtype=np.int64)
    lex = Lexicon(h[best], c[best], int(facts[0]), int(facts[1]), int(facts[2]), int(facts[3]), n_docs, spelled[:CELLS])
    shared = spark.sparkContext.broadcast(lex)
    asked = rows.mapInArrow(lambda it: _encode(it, shared.value, keys), ROUTED)
    routed = counted.where(F.col("kind") == COUNT).unionByName(asked).repartition(n_parts, "key")
    routed = scratch.table(routed.mapInArrow(lambda it: _answer(it, shared.value), ROUTED), "routed")
    scratch.drop("counts")
    ids = routed.where(F.col("kind") == IDS)
    # Numbers first: sorting whole blocks would send some from every task.
    first = start_blocks(ids)
    sample = [_read_ids(r.asDict()) for r in ids.where(F.col("block").isin(first)).orderBy("block").collect()]
    params = train(ids, sample, lex, states, rounds, keys)
    known = spark.sparkContext.broadcast(params)
    return routed.groupBy("block").applyInArrow(lambda t: _final(t, shared.value, known.value), SCORES)


def start_blocks(ids: DataFrame, n: int = SAMPLE_BLOCKS) -> list[int]:
    """Numbers of the blocks that training starts on: by hash, so that they come
    from the whole table, as low numbers are all of the first partition."""
    return [r["block"] for r in ids.select("block").orderBy(F.xxhash64("block"), "block").limit(n).collect()]


def train(ids: DataFrame, sample: list, lex: Lexicon, states: int, rounds: int, keys: list[int]) -> hmm.Params:
    floor = lex.floor()
    kept = [_only(i, o, f[:, 2] == 0) for i, o, f in sample]
    kept = [(i, o) for i, o in kept if len(i)]
    m = lex.size
    if not kept:
        one = np.full(states, 1.0 / states)
        return hmm.Params(one, one, np.full((states, states), 1.0 / states), np.repeat(floor[:, None], states, axis=1))
    all_ids = np.concatenate([i for i, _ in kept])
    offsets = np.concatenate([[0]] + [np.diff(o) for _, o in kept]).cumsum()
    p = hmm.first_guess(all_ids, offsets, states, m, floor)
    for _ in range(4):
        counts = hmm.Counts(states, m)
        hmm.expect(all_ids, offsets, p, counts)
        p = counts.params(floor)
    spark, n_parts = ids.sparkSession, len(keys)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)
        summed = ids.mapInArrow(lambda it: _expected(it, now.value, keys), ROUTED).repartition(n_parts, "key").mapInArrow(_sum_expected, ROUTED)
        got = {r["block"]: (np.frombuffer(r["a"], dtype=float), np.frombuffer(r["b"], dtype=float)) for r in summed.select("block", "a", "b").collect()}
        now.unpersist()
        if not got:
            break
        counts = hmm.Counts(states, m)
        counts.emit = np.concatenate([got[s][0] for s in range(SLICES) if s in got]).reshape(m, states)
        small = got[0][1]
        counts.start, counts.follow, counts.move = small[:states], small[states : 2 * states], small[2 * states :].reshape(states, states)
        p = counts.params(floor)
    return p
