"""Near duplicates: Jaccard self-join of word shingle sets by PartEnum.

A set's features are its distinct five-word shingles (64-bit hashes). Size
bands are octaves: the space of band (U/2, U] cuts the hash domain into n(U)
partitions. Two sets of sizes a <= b with similarity of 3/4 differ in at most
(a + b) // 7 features, so of any more non-empty partitions one has the same
content in both. Each set therefore signs single partitions (the subsets that
the enumeration leaves when one of two partitions of a group must agree), as
many from the front of the domain as the largest partner in the band can need,
in its own band and, where a partner can be larger than it, in the next one.
Features that many documents share (found in a sample; any list is right) are
left out of the domain at first, so that a common passage does not bring
unrelated sets together. Whether a set really has enough non-empty partitions
is checked for every partner size; one that has not signs at the next level as
well: finer partitions, then each feature, then partitions of all features
with the common ones, then each of them. Two sets meet at the first level that
one of them passes. Of sets that reach the levels with common features, those
still marked "met" have so many uncommon ones that any two of them share one
or cannot link; such pairs are not candidates there. Hence no pair is lost,
whatever the hashes do.

Hot groups. Equal sets are one node. Within a block of documents, sets similar
to an earlier one follow it (verified), and sign under its name: a group of
near copies sends one entry a block and signature, however large it is. A
follower lies within a known distance of its leader, and Jaccard distance is a
metric, so a verified leader pair tells when followers cannot link; otherwise
they are compared themselves.

Candidates. In a signature group every node is verified against the group's
first. Groups that then still lie in several components are compared block by
block. A histogram of each set over the hash domain bounds the distance of a
pair from below, so only pairs that it leaves possible, in different
components, are listed and verified. So every link between different texts is either verified
or inside one component already.

Defined results: null, empty and blank texts have no shingles and link with
nothing (equal ones neither); with fewer than five words the whole sequence is
one shingle; rows with equal sets are linked, also when ids repeat; null ids
are the last choice for component_id; an empty table gives no rows. Texts of any
length are whole sets (a very long one is a block of its own). Other columns of
the input are not read, so their names may clash with the result's; a result
column gets a trailing underscore where the id column has its name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.llm import textkernel as tk
from issq.llm.common import Scratch, even_join, even_keys, free_name, parts, session_limits
from issq.operators.components import components

#: Similarity threshold NUM / DEN; k(a, b) below follows from it.
NUM, DEN = 3, 4
BLOCK_BYTES = 2 << 20
#: Text bytes of a block that are split into words at a time.
TEXT_BYTES = 1 << 20
#: Bands up to this size give every feature a partition of its own, nearly.
FINE = 32
#: Fronts are this much longer than a set without left-out features needs.
SLACK = 1.06
#: Followers are at most this far from their leader: the nearer they are, the
#: less often a leader's pair leaves open whether followers link.
BALL = 0.08
#: Nodes of a signature group that a task compares with as many others.
BLOCK = 512
#: Groups above this size do not list the pairs that another such group lists.
BIG = 64
#: The sample that shows which features are common: texts in it (expected, by
#: hash), least count of a feature among them, and features kept. None of it
#: changes the result, only the number of candidates.
SAMPLE_TEXTS, SAMPLE_COUNT, SAMPLE_FEATURES = 20_000, 2, 250_000
#: Parts of a bucket, sorted by Spark and read one after the other.
TURNS = 16
#: Nodes of a signature group in one row; larger groups are several rows.
CHUNK = 4096
#: The bit of a signature that tells sets that need not meet each other there.
MET = np.uint64(1 << 16)
ROUTED = "key int, kind int, n long, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["key", "kind", "n", "a", "b", "c", "d", "e"]
MEMBER, SIGN, EDGE, GROUP = range(4)


def differing(a, b):
    """Most features in which sets of these sizes may differ and still link:
    a + b - 2 * overlap, with the overlap at least NUM / (NUM + DEN) of a + b."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


@lru_cache(maxsize=64)
def space(upper: int, fineness: int = 1) -> tuple[int, np.ndarray]:
    """Partitions n of the band (upper/2, upper], and by size b (index) how
    many from the front sets of that size sign; never falls with b."""
    b = np.arange(upper + 1)
    if upper <= FINE or fineness > 1:
        n = 16 * upper if upper <= FINE else fineness * math.ceil(0.33 * upper + 0.5 * math.sqrt(upper))
        return n, np.full(upper + 1, n, dtype=np.int64)
    n = math.ceil(0.33 * upper + 0.5 * math.sqrt(upper))
    filled = 1 - np.exp(-np.maximum(b, 1) / n)
    need = SLACK * (differing(b, b) + 1)
    front = need / filled + 2.0 * np.sqrt(need / filled * (1 - filled)) / filled + 1
    front[: upper // 2 + 1] = 0
    return n, np.minimum(np.maximum.accumulate(np.ceil(front)), n).astype(np.int64)


def band(size: np.ndarray) -> np.ndarray:
    """The smallest power of two at or above each size."""
    return (1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)).astype(np.int64)


def signatures(sets: np.ndarray, off: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set index) of non-empty sorted sets. hot: sorted features to
    leave out at first."""
    size = np.diff(off)
    own, largest = band(size), size * DEN // NUM
    cold, cold_off = sets, off
    if len(hot):
        gate = np.zeros(1 << 20, dtype=bool)
        gate[(hot >> np.uint64(44)).astype(np.int64)] = True
        keep = np.ones(len(sets), dtype=bool)
        maybe = np.flatnonzero(gate[(sets >> np.uint64(44)).astype(np.int64)])
        keep[maybe] = hot[np.minimum(np.searchsorted(hot, sets[maybe]), len(hot) - 1)] != sets[maybe]
        total = np.zeros(len(sets) + 1, dtype=np.int64)
        np.cumsum(keep, out=total[1:])
        cold, cold_off = sets[keep], total[off]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for shift in (1, 2):
        spaces = own * shift
        take = np.ones(len(size), dtype=bool) if shift == 1 else largest > own
        low, high = np.maximum(size, spaces // 2 + 1), np.minimum(largest, spaces)
        for upper in np.unique(spaces[take]).tolist():
            todo = np.flatnonzero(take & (spaces == upper))
            tag = [np.uint64((upper * 8 + level) * 0x9E3779B97F4A7C15 % 2**64) for level in range(5)]
            for level, fineness in ((0, 1), (1, 2)):
                sig, owner, enough = _signed(cold, cold_off, todo, size, low, high, *space(upper, fineness), tag[level])
                out.append((sig & ~MET, owner))
                todo = todo[~enough]
            if not len(todo):
                continue
            most, n_cold = differing(size, high), np.diff(cold_off)
            out += [(tk.mix(cold[cold_off[s] : cold_off[s + 1]] + tag[2]) & ~MET, np.full(n_cold[s], s)) for s in todo.tolist()]
            todo = todo[n_cold[todo] <= most[todo]]
            if not len(todo):
                continue
            met = np.where(2 * n_cold > most, MET, np.uint64(0))
            sig, owner, enough = _signed(sets, off, todo, size, low, high, *space(upper), tag[3])
            out.append((sig & ~MET | met[owner], owner))
            out += [(tk.mix(sets[off[s] : off[s + 1]] + tag[4]) & ~MET | met[s], np.full(size[s], s)) for s in todo[~enough].tolist()]
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _signed(sets, off, which, size, low, high, n, front, tag):
    """Signatures of the partitions at the front, and for which sets they are
    enough to meet every partner."""
    lens = np.diff(off)[which]
    item = np.repeat(np.arange(len(which)), lens)
    local = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(lens, out=local[1:])
    x = sets[np.repeat(off[:-1][which] - local[:-1], lens) + np.arange(int(local[-1]))]
    part = (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
    inside = part < front[high[which]][item]
    x, part, item = x[inside], part[inside], item[inside]
    if not len(x):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(len(which), dtype=bool)
    head = np.ones(len(x), dtype=bool)
    head[1:] = (part[1:] != part[:-1]) | (item[1:] != item[:-1])
    at = np.flatnonzero(head)
    part, item = part[at], item[at]
    sig = tk.mix(np.add.reduceat(tk.mix(x), at) + tk.mix(part.astype(np.uint64) + tag))
    # For every partner size b from low to high: is the (differing + 1)-th
    # non-empty partition within the front that sets of size b sign?
    runs = np.searchsorted(item, np.arange(len(which) + 1))
    a, lo, hi = size[which], low[which], high[which]
    k0 = differing(a, lo)
    count = differing(a, hi) - k0 + 1
    who = np.repeat(np.arange(len(which)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + k0[who]
    b = np.clip((DEN + NUM) // (DEN - NUM) * k - a[who], lo[who], hi[who])
    place = np.minimum(runs[who] + k, len(part) - 1)
    fine = (k < np.diff(runs)[who]) & (part[place] < front[b])
    enough = np.bincount(who[~fine], minlength=len(which)) == 0
    return sig, which[item], enough


def histogram(items: np.ndarray, size: int) -> bytes:
    """Counts of a set's features over equal parts of the hash domain, one byte
    each: more parts than features for small sets, up to four features a part
    for large ones."""
    shift = histogram_bits(size)
    return np.minimum(np.bincount((items >> np.uint64(64 - shift)).astype(np.int64), minlength=1 << shift), 255).astype(np.uint8).tobytes()


def histogram_bits(size: int) -> int:
    length = int(size).bit_length()
    return max(min(length, 10), length - 2, 2)


def least_distance(x: bytes, y: bytes, nx: int, ny: int) -> float:
    """A lower bound of the Jaccard distance of two sets from histograms."""
    p, q = np.frombuffer(x, dtype=np.uint8).astype(np.int64), np.frombuffer(y, dtype=np.uint8).astype(np.int64)
    if len(p) > len(q):
        p, q = q, p
    if (p == 255).any() or (q == 255).any():
        return 0.0
    apart = int(np.abs(p - q.reshape(len(p), -1).sum(axis=1)).sum())
    return 2 * apart / (nx + ny + apart)


def jaccard_parts(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    pos = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    common = int((y[pos] == x).sum()) if len(y) else 0
    return common, len(x) + len(y) - common


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    full = [(r[0], r[1], r[2], *[x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in r[3:]], *[b""] * (8 - len(r))) for r in rows]
    cols = list(zip(*full)) if full else [[]] * 8
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)


def set_nodes(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (0 for an empty one)."""
    size = np.diff(off)
    name = np.zeros(len(size), dtype=np.uint64)
    full = size > 0
    if full.any():
        name[full] = tk.mix(np.add.reduceat(tk.mix(sets ^ np.uint64(0x5BF03635)), off[:-1][full]) + size[full].astype(np.uint64))
        name[full] = np.maximum(name[full], np.uint64(1))
    return name.view(np.int64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The set of every text, and where each begins; a piece at a time, as the
    temporaries are many times the size of the text."""
    sets, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for a, b in tk.pieces(texts, TEXT_BYTES):
        _, _, _, at, words = tk.words_of(texts.slice(a, b - a))
        found, off = tk.distinct(*tk.shingles(words, at))
        sets.append(found)
        sizes.append(np.diff(off))
    return np.concatenate(sets), np.cumsum(np.concatenate(sizes))


def _sign(batches: Iterator[pa.RecordBatch], keys: list[int], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, size, turn = [], 0, 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK_BYTES:
            for rows in _sign_block(held, keys, turn, hot):
                yield _batch(rows)
            held, size, turn = [], 0, turn + 1
    if held:
        for rows in _sign_block(held, keys, turn, hot):
            yield _batch(rows)


def _sign_block(held: list[pa.RecordBatch], keys: list[int], turn: int, hot: np.ndarray) -> Iterator[list[tuple]]:
    from pyspark import TaskContext

    table = pa.Table.from_batches(held).combine_chunks()
    ids, all_texts = table.column(0).combine_chunks(), tk.no_nulls(table.column(1))
    for a, b in tk.pieces(all_texts, BLOCK_BYTES):
        sets, off = shingle_sets(all_texts.slice(a, b - a))
        node, size = set_nodes(sets, off), np.diff(off)
        uniq, first = np.unique(node, return_index=True)
        first = np.sort(first[uniq != 0])
        some = np.repeat(off[:-1][first] - np.concatenate([[0], np.cumsum(size[first])[:-1]]).astype(np.int64), size[first]) + np.arange(int(size[first].sum()))
        sub, sub_off = sets[some], np.concatenate([[0], np.cumsum(size[first])])
        sig, owner = signatures(sub, sub_off, hot)
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        plain = sig & ~MET
        lead, dist = _leaders(plain[np.argsort(plain, kind="stable")], owner[np.argsort(plain, kind="stable")], sub, sub_off)
        names = node[first]
        by_node = dict(zip(names.tolist(), range(len(first))))
        row = np.array([by_node.get(x, -1) for x in node.tolist()], dtype=np.int64)
        leader = np.where(row >= 0, names[lead[row]] if len(first) else 0, 0)
        far = np.where(row >= 0, dist[row] if len(first) else 0.0, 0.0)
        key = ids.slice(a, b - a).cast(pa.int64())
        known = key.is_valid().to_numpy(zero_copy_only=False)
        facts = np.stack([key.fill_null(0).to_numpy(zero_copy_only=False), known.astype(np.int64), node, size, leader]).astype(np.int64)
        yield [[keys[(TaskContext.get().partitionId() + turn) % len(keys)], MEMBER, b - a, facts, far, *_histograms(sets, off)]]
        owner = lead[owner]
        keep = np.ones(len(sig), dtype=bool)
        both = np.lexsort((sig, owner, sig & ~MET))  # of one node, unmarked before marked
        sig, owner = sig[both], owner[both]
        keep[1:] = ((sig[1:] ^ sig[:-1]) & ~MET != 0) | (owner[1:] != owner[:-1])
        sig, named = sig[keep], names[owner[keep]] if len(first) else names
        # Bucket and turn of a signature in one number.
        place = ((sig >> np.uint64(17)) % np.uint64(len(keys) * TURNS)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(keys) * TURNS + 1))
        yield [_signed_row(keys[k // TURNS], k % TURNS, sig[order[x:y]], named[order[x:y]]) for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]


def _histograms(sets: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    all_ = [histogram(sets[a:b], b - a) if b > a else b"" for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return b"".join(all_), np.array([len(h) for h in all_], dtype=np.int64)


def _signed_row(key: int, turn: int, sig: np.ndarray, node: np.ndarray) -> tuple:
    """Sorted signatures as six byte planes of their upper 48 bits (enough
    beside the bucket: chance collisions are verified away), and the nodes by
    number in a list."""
    planes = (sig >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    names, number = np.unique(node, return_inverse=True)
    return key, SIGN, turn, planes, number.astype("<u2" if len(names) <= 65536 else "<u4"), names


def _read_signed(r: dict) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(r["a"], dtype=np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, :6] = planes.T
    names = np.frombuffer(r["c"], dtype=np.int64)
    return wide.view("<u8").ravel(), names[np.frombuffer(r["b"], dtype="<u2" if len(names) <= 65536 else "<u4")]


def _leaders(sig: np.ndarray, owner: np.ndarray, sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's leader (itself, or an earlier set verified as similar that
    leads itself) and the distance to it."""
    n = len(off) - 1
    lead, dist = np.arange(n), np.zeros(n)
    if not len(sig):
        return lead, dist
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    low = np.minimum.reduceat(owner, head)
    start = np.repeat(low, np.diff(np.append(head, len(sig))))
    other = owner != start
    if not other.any():
        return lead, dist
    pair, times = np.unique(owner[other] * n + start[other], return_counts=True)
    order = np.lexsort((-times, pair // n))
    tried: dict[int, int] = {}
    followed: set[int] = set()
    for p in pair[order].tolist():
        s, l = divmod(p, n)
        if lead[s] != s or lead[l] != l or tried.get(s, 0) >= 3:
            continue
        tried[s] = tried.get(s, 0) + 1
        common, union = jaccard_parts(sets[off[s] : off[s + 1]], sets[off[l] : off[l + 1]])
        if union - common <= BALL * union and s not in followed:
            lead[s], dist[s] = l, 1 - common / union
            followed.add(l)
    return lead, dist


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by kind and turn; the signatures of one turn are held."""
    sigs, nodes, turn = [], [], -1
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        if (kinds == MEMBER).any():
            yield batch.filter(pa.array(kinds == MEMBER))
        for r in batch.filter(pa.array(kinds == SIGN)).select(["n", "a", "b", "c"]).to_pylist():
            if r["n"] != turn:
                yield from _met(sigs, nodes)
                sigs, nodes, turn = [], [], r["n"]
            sig, node = _read_signed(r)
            sigs.append(sig)
            nodes.append(node)
    yield from _met(sigs, nodes)


def _met(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group's first node with the others, and larger groups."""
    if not sigs:
        return
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    sigs.clear()
    nodes.clear()
    met, sig = (sig & np.uint64(1)).astype(bool), sig >> np.uint64(1)
    order = np.argsort(sig)
    sig, node, met = sig[order], node[order], met[order]
    same = np.zeros(len(sig), dtype=bool)
    same[1:] = sig[1:] == sig[:-1]
    multi = same.copy()
    multi[:-1] |= same[1:]
    sig, node, met = sig[multi], node[multi], met[multi]
    # A node once a group, unmarked if any of its entries is.
    order = np.lexsort((met, node, sig))
    sig, node, met = sig[order], node[order], met[order]
    keep = np.ones(len(sig), dtype=bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, met = sig[keep], node[keep], met[keep]
    order = np.lexsort((node, met, sig))  # unmarked ones first
    sig, node, met = sig[order], node[order], met[order]
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(head, len(sig)))
    useful = (sizes > 1) & ~met[head] if len(head) else np.zeros(0, dtype=bool)
    live = np.repeat(useful, sizes)
    pivot = np.repeat(node[head], sizes) if len(head) else node
    other = live & (node != pivot)
    if not other.any():
        return
    pairs = np.stack([np.minimum(pivot, node)[other], np.maximum(pivot, node)[other]], axis=1)
    edges = np.unique(pairs, axis=0)
    yield _batch([(0, EDGE, len(edges), edges[:, 0], edges[:, 1])])
    # Larger groups, each list of nodes once, named by its hash, in chunks: how
    # many of it are unmarked, its size, and where the chunk starts.
    seen, rows = set(), []
    free = np.add.reduceat(~met, head)
    big = useful & (sizes > 2)
    for h, n, f in zip(head[big].tolist(), sizes[big].tolist(), free[big].tolist()):
        name = hashlib.blake2b(node[h : h + n].tobytes() + f.to_bytes(8, "little"), digest_size=8).digest()
        if name not in seen:
            seen.add(name)
            for at in range(0, n, CHUNK):
                rows.append((0, GROUP, f, node[h + at : h + min(at + CHUNK, n)], name, np.array([n, at], dtype=np.int64)))
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            facts = np.frombuffer(r["a"], dtype=np.int64).reshape(5, -1)
            stops = np.concatenate([[0], np.cumsum(np.frombuffer(r["d"], dtype=np.int64))]).astype(np.int32)
            parts_ = pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops), pa.py_buffer(r["c"])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(facts[0], mask=facts[1] == 0), *[pa.array(facts[k]) for k in (2, 3, 4)], pa.array(np.frombuffer(r["b"], dtype=float)), parts_],
                names=["doc_id", "node", "n", "leader", "dist", "histogram"],
            )


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], dtype=np.int64)) for c in "ab"], names=["a", "b"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        facts = np.array([np.frombuffer(r["c"], dtype=np.int64) for r in rows]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array([int.from_bytes(r["b"], "little", signed=True) for r in rows], pa.int64()), pa.array([r["n"] for r in rows], pa.int64()),
            pa.array(facts[:, 0]), pa.array(facts[:, 1]), pa.array([np.frombuffer(r["a"], dtype=np.int64) for r in rows], pa.list_(pa.int64())),
        ], names=["g", "free", "size", "start", "nodes"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, want = tk.no_nulls(batch.column(0)), batch.column(1).to_numpy()
        for a, b in tk.pieces(texts):
            sets, off = shingle_sets(texts.slice(a, b - a))
            same = np.flatnonzero(set_nodes(sets, off) == want[a:b])
            blobs = [sets[off[i] : off[i + 1]].tobytes() for i in same.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(want[a:b][same]), pa.array(blobs, pa.binary())], names=["node", "items"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, off = shingle_sets(tk.no_nulls(batch.column(0)))
        _, first = np.unique(set_nodes(sets, off), return_index=True)
        for i in first.tolist():
            yield pa.RecordBatch.from_arrays([pa.array(sets[off[i] : off[i + 1]].view(np.int64))], names=["x"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their histograms do not rule out."""
    for batch in batches:
        rows = zip(*[batch.column(k).to_pylist() for k in range(2, 7)])
        keep = [least_distance(x, y, nx, ny) <= room + 1e-9 for x, nx, y, ny, room in rows]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible pairs of the rows of each group, repeats left out as far as a
    bounded memory goes."""
    found = np.zeros((0, 2), dtype=np.int64)

    def table(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        lists, names = batch.column(0), batch.column(1).to_numpy()
        cuts, flat = lists.offsets.to_numpy(), lists.values
        group_at, group_of = flat.field("groups").offsets.to_numpy(), flat.field("groups").values.to_numpy()
        sets: dict[int, tuple[set, set]] = {}

        def listed(i: int) -> tuple[set, set]:
            """All big groups of a row's node, and those where it is unmarked."""
            if i not in sets:
                own = group_of[group_at[i] : group_at[i + 1]]
                sets[i] = set((own >> 1).tolist()), set((own[own & 1 == 0] >> 1).tolist())
            return sets[i]

        side, node, label, n = (flat.field(c).to_numpy() for c in ("side", "node", "label", "n"))
        free, radius = flat.field("free").to_numpy(zero_copy_only=False), flat.field("radius").to_numpy()
        raw, at = tk.buffers(flat.field("histogram"))
        out = []
        for s, e, name in zip(cuts[:-1].tolist(), cuts[1:].tolist(), (names >> 1).tolist()):
            width = int((at[s + 1 : e + 1] - at[s:e]).min(initial=1 << 40)) if e > s else 0
            bars = np.zeros((e - s, max(width, 1)), dtype=np.int32)
            full = np.zeros(e - s, dtype=bool)
            for i in range(e - s):
                own = raw[at[s + i] : at[s + i + 1]]
                full[i] = (own == 255).any()
                bars[i] = own.reshape(width, -1).sum(axis=1)
            one, two = (np.flatnonzero(side[s:e] == k) for k in (0, 1))
            within = not len(two)
            for k, i in enumerate(one.tolist()):
                j = one[k + 1 :] if within else two
                p, q = s + i, s + j
                room = 1 - NUM / DEN + radius[p] + radius[q] + 1e-9
                ok = (label[p] != label[q]) & (free[p] | free[q]) & (node[p] != node[q])
                j, q, room = j[ok], q[ok], room[ok]
                apart = np.abs(bars[i] - bars[j]).sum(axis=1, dtype=np.int64) * ~(full[i] | full[j])
                apart = np.maximum(apart, np.abs(n[p] - n[q]))
                q = q[2 * apart / (n[p] + n[q] + apart) <= room]
                if len(q):
                    all_p, free_p = listed(p)
                if len(q) and name in all_p:
                    q = q[[min((free_p & all_q) | (all_p & free_q)) == name for all_q, free_q in map(listed, q.tolist())]]
                if len(q):
                    out.append(np.stack([np.minimum(node[p], node[q]), np.maximum(node[p], node[q])], axis=1))
        if out:
            found = np.unique(np.concatenate([found, *out]), axis=0)
        if len(found) > 1_000_000:
            yield table(found)
            found = found[:0]
    yield table(found)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        got = [jaccard_parts(np.frombuffer(x[i].as_buffer(), dtype=np.uint64), np.frombuffer(y[i].as_buffer(), dtype=np.uint64)) for i in range(batch.num_rows)]
        common, union = (np.array([g[k] for g in got], dtype=np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(DEN * common >= NUM * union), pa.array(1 - common / np.maximum(union, 1))], names=["a", "b", "linked", "dist"]
        )


class Join:
    """The join's tables, all written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        session_limits(self.spark)
        self.scratch = Scratch(self.spark, "jaccard")
        self.docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
        n = parts(self.spark)
        keys = even_keys(self.spark, n)
        hot = self._common()
        routed = self.docs.mapInArrow(lambda it: _sign(it, keys, hot), ROUTED).repartition(n, "key").sortWithinPartitions("kind", "n").mapInArrow(_group, ROUTED)
        routed = self.scratch.table(routed, "routed")
        of = lambda kind: routed.where(F.col("kind") == kind)
        self.members = of(MEMBER).mapInArrow(_members, "doc_id long, node long, n long, leader long, dist double, histogram binary")
        self.members = self.scratch.table(self.members, "members")
        self.edges = self.scratch.table(of(EDGE).select("a", "b").mapInArrow(_edges, "a long, b long").distinct(), "edges")
        self.groups = self.scratch.table(of(GROUP).select("n", "a", "b", "c").mapInArrow(_lists, "g long, free long, size long, start long, nodes array<long>").dropDuplicates(["g", "start"]), "groups")
        self.scratch.drop("routed")
        self.follow = self.members.where("node <> leader").select("leader", "node", "dist").distinct()
        self.balls = self.follow.groupBy("leader").agg(F.max("dist").alias("radius"))
        facts = self.members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("histogram").alias("histogram"))
        facts = facts.join(self.balls.select(F.col("leader").alias("node"), "radius"), "node", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))
        self.facts = self.scratch.table(facts, "facts")

    def _common(self) -> np.ndarray:
        """Features that many texts of a bounded sample share, sorted."""
        every = self.docs.count() // SAMPLE_TEXTS + 1
        some = self.docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
        top = some.mapInArrow(_features, "x long").groupBy("x").count().where(F.col("count") >= SAMPLE_COUNT).orderBy(F.desc("count"), "x").limit(SAMPLE_FEATURES)
        return np.sort(top.select("x").toArrow().column(0).to_numpy().view(np.uint64))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The node pairs that sizes and histograms leave possible, or that may
        have followers that link."""
        facts = self.facts
        one = facts.select(F.col("node").alias("a"), F.col("histogram").alias("x"), F.col("n").alias("nx"), F.col("radius").alias("ra"))
        two = facts.select(F.col("node").alias("b"), F.col("histogram").alias("y"), F.col("n").alias("ny"), F.col("radius").alias("rb"))
        room = 1 - NUM / DEN + F.col("ra") + F.col("rb")
        near = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").where(1 - F.least("nx", "ny") / F.greatest("nx", "ny") <= room + 1e-9)
        return near.select("a", "b", "x", "nx", "y", "ny", room.alias("room")).mapInArrow(_possible, "a long, b long")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked, dist) of a written table of node pairs."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # One row of each node stands for it; its text gives the set again.
        chosen = self.members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")).alias("m"))
        chosen = chosen.select("node", F.col("m.doc_id").alias("want"))
        rows = self.docs.join(chosen, F.col("id").eqNullSafe(F.col("want"))).select("text", "node")
        sets = self.scratch.table(rows.mapInArrow(_wanted, "node long, items binary"), f"{name}-sets").dropDuplicates(["node"])
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        out = self.scratch.table(both.mapInArrow(_verify, "a long, b long, linked boolean, dist double"), name)
        self.scratch.drop(f"{name}-sets")
        return out

    def followers(self, near: DataFrame, labels: DataFrame) -> DataFrame:
        """Possible pairs between the followers of leaders that do not link but
        are near enough that followers might, in different components."""
        radius = self.balls
        ends = near.where("not linked").join(radius.select(F.col("leader").alias("a"), F.col("radius").alias("ra")), "a", "left").join(
            radius.select(F.col("leader").alias("b"), F.col("radius").alias("rb")), "b", "left")
        ends = ends.where(F.col("dist") <= 1 - NUM / DEN + F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0)) + 1e-9).where("ra is not null or rb is not null")
        ends = labelled(labelled(ends, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b", F.xxhash64("a", "b").alias("g"))
        ends = self.scratch.table(ends, "ends")
        itself = ends.select(F.col("a").alias("leader"), F.col("a").alias("node")).union(ends.select("b", F.col("b").alias("c"))).distinct()
        all_ = self.follow.select("leader", "node").union(itself).distinct()
        one = ends.select("g", F.col("a").alias("leader"), F.lit(0).alias("side")).union(ends.select("g", "b", F.lit(1)))
        rows = labelled(one.join(all_, "leader"), labels, "node", "label").withColumn("free", F.lit(True))
        blocked = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(4)).cast("int"))
        blocked = blocked.withColumn("other", F.explode(F.array(*[F.lit(k) for k in range(4)])))
        lo, hi = F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))
        return self._possible_pairs(blocked.select("g", lo.alias("lo"), hi.alias("hi"), "side", "node", "label", "free", F.array(F.shiftleft(F.shiftrightunsigned("g", 1), 1)).alias("groups")), exact=True)

    def rest_of_groups(self, labels: DataFrame) -> DataFrame:
        """Possible pairs of one signature group in different components. Large
        groups are cut in blocks, and blocks are compared by twos, so a task
        holds two of them however large a group is."""
        rows = self.groups.select("g", "free", (F.col("size") > BIG).alias("big"), ((F.col("size") - 1) / BLOCK).cast("int").alias("last"), "start", F.posexplode("nodes").alias("pos", "node"))
        at = F.col("start") + F.col("pos")
        rows = rows.select("g", "big", "last", "node", (at < F.col("free")).alias("free"), (at / BLOCK).cast("int").alias("block"))
        rows = labelled(rows, labels, "node", "label")
        mixed = rows.groupBy("g").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("g")
        rows = self.scratch.table(rows.join(mixed, "g", "left_semi"), "mixed")
        # Of big groups, one only lists a pair: the least that holds both and has
        # one of them unmarked. The lowest bit of a group's number marks. A node
        # is in no more groups than it has signatures, a few for each shingle.
        number = F.shiftleft(F.shiftrightunsigned("g", 1), 1).bitwiseOR(F.when(F.col("free"), 0).otherwise(1).cast("long"))
        held = rows.where("big").groupBy("node").agg(F.collect_set(number).alias("groups"))
        rows = rows.join(held, "node", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<bigint>"))).withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        rows = rows.select("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "label", "free", "groups")
        return self._possible_pairs(rows, exact=False)

    def _possible_pairs(self, rows: DataFrame, exact: bool) -> DataFrame:
        """Pairs of both sides of each (g, lo, hi), or within the side where it
        is the only one, that sizes and histograms leave possible."""
        facts = self.facts.select("node", "n", F.lit(0.0).alias("radius") if exact else F.col("radius"), "histogram")
        item = F.struct("side", "node", "label", "free", "n", "radius", "histogram", "groups")
        held = rows.join(facts, "node").groupBy("g", "lo", "hi").agg(F.collect_list(item).alias("rows"))
        return held.select("rows", "g").mapInArrow(_compare, "a long, b long").distinct()

    def solve(self) -> DataFrame:
        """(node, label) over all links."""
        done = self.verify(self.scratch.table(self.possible(self.edges), "first-pairs"), "first")
        links = self.follow.select(F.col("leader").alias("a"), F.col("node").alias("b")).union(done.where("linked").select("a", "b"))
        labels = components(links, self.scratch, "c")
        for step, find in enumerate((lambda: self.rest_of_groups(labels), lambda: self.followers(done, labels))):
            pairs = self.scratch.table(find().join(done.select("a", "b"), ["a", "b"], "left_anti"), f"pairs{step}")
            if pairs.limit(1).count():
                checked = self.verify(pairs, f"checked{step}")
                done = done.unionByName(checked)
                labels = self.merged(labels, checked.where("linked"), f"c{step}")
        return labels

    def merged(self, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Labels after more links: only links between components count, once
        for each two of them."""
        ends = labelled(labelled(links.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la <> lb")
        above = components(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), self.scratch, name)
        moved = labelled(labels, above, "label", "top").select("node", F.col("top").alias("label"))
        fresh = above.join(labels.select("node"), "node", "left_anti")
        return self.scratch.table(moved.unionByName(fresh), f"{name}-labels")


def labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias("node_"), F.col("label").alias("label_"))
    found = df.join(own, F.col(node) == F.col("node_"), "left").withColumn("label_", F.coalesce("label_", node))
    return found.drop("node_").withColumnRenamed("label_", name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row (see the docstring)."""
    join = Join(docs, id_col, text_col)
    scratch = join.scratch
    # Equal texts are one node and a family one label: both can be hot keys.
    labels = join.solve().select("node", "label")
    rows = even_join(join.members.select("doc_id", "node", "n"), labels, "node", "left")
    rows = scratch.table(rows.select("doc_id", "n", F.coalesce("label", "node").alias("label")), "labelled")
    least = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = even_join(rows, least, "label", "left").withColumn("least", F.when(F.col("n") > 0, F.col("least")))
    names: list[str] = []
    for c in ("n_shingles", "component_id"):
        names.append(free_name([id_col] + names, c))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias(names[0]), F.coalesce("least", "doc_id").alias(names[1]))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; all columns
    kept. Rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col).toDF("id", "n", "least")
    gone = free_name(docs.columns, "gone")
    dropped = found.where("id <> least").select(F.col("id").alias(gone)).distinct()
    return docs.join(dropped, F.col(f"`{id_col}`") == F.col(f"`{gone}`"), "left_anti")
