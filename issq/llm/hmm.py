"""A hidden Markov model over token ids, in numpy: expected counts by scaled
forward-backward on segments, and exact sequence likelihoods."""

from __future__ import annotations

import numpy as np

#: Tokens in a training segment; longer documents train as several segments.
SEGMENT = 192
#: Documents up to this many tokens are scored step by step side by side;
#: longer ones by products of transfer matrices over stretches.
DIRECT = 1500
STRETCH = 64


class Params:
    """start (K), follow (K, for segments inside a document), move (K x K) and
    emit (M x K)."""

    def __init__(self, start, follow, move, emit):
        self.start, self.follow, self.move, self.emit = start, follow, move, emit

    @property
    def states(self) -> int:
        return len(self.start)


class Counts:
    def __init__(self, k: int, m: int):
        self.start, self.follow, self.move, self.emit = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((m, k))

    def params(self, floor: np.ndarray) -> Params:
        """Maximum likelihood with a little of the overall distribution
        (``floor`` sums to 1) in every state, so no token is impossible."""
        share = lambda x, eps: (x + eps) / (x + eps).sum(axis=-1, keepdims=True)
        emit = self.emit + 5.0 * floor[:, None]
        return Params(share(self.start, 0.1), share(self.follow, 0.1), share(self.move, 0.1), emit / emit.sum(axis=0, keepdims=True))


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and whether a document begins there."""
    lens = np.diff(offsets)
    per = -(-lens // SEGMENT)
    doc = np.repeat(np.arange(len(lens)), per)
    nth = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    start = offsets[:-1][doc] + nth * SEGMENT
    return start, np.minimum(SEGMENT, offsets[1:][doc] - start), nth == 0


def expect(ids: np.ndarray, offsets: np.ndarray, p: Params, out: Counts, block: int = 1500) -> float:
    """Add expected counts of the documents to ``out``; log likelihood of the
    segments."""
    start, lens, first = segments(offsets)
    order = np.argsort(-lens, kind="stable")
    total = 0.0
    for a in range(0, len(order), block):
        o = order[a : a + block]
        total += _expect(ids, start[o], lens[o], first[o], p, out)
    return total


def _expect(ids, start, lens, first, p: Params, out: Counts) -> float:
    longest, n, k = int(lens[0]), len(lens), p.states
    live = np.searchsorted(-lens, -np.arange(longest), side="left")
    tok = np.zeros((longest, n), dtype=np.int64)
    for t in range(longest):
        tok[t, : live[t]] = ids[start[: live[t]] + t]
    seen = p.emit[tok]  # longest x n x k
    alpha = np.empty((longest, n, k))
    scale = np.ones((longest, n))
    for t in range(longest):
        m = live[t]
        x = np.where(first[:m, None], p.start, p.follow) if t == 0 else alpha[t - 1, :m] @ p.move
        x = x * seen[t, :m]
        s = x.sum(axis=1)
        alpha[t, :m], scale[t, :m] = x / s[:, None], s
    beta = np.ones((n, k))
    gammas, tokens = [], []
    for t in range(longest - 1, -1, -1):
        m = live[t]
        g = alpha[t, :m] * beta[:m]
        gammas.append(g)
        tokens.append(tok[t, :m])
        if t:
            right = seen[t, :m] * beta[:m] / scale[t, :m, None]
            out.move += p.move * (alpha[t - 1, :m].T @ right)
            beta[:m] = right @ p.move.T
        else:
            out.start += g[first].sum(axis=0)
            out.follow += g[~first].sum(axis=0)
    g, tk_ = np.concatenate(gammas), np.concatenate(tokens)
    for j in range(k):
        out.emit[:, j] += np.bincount(tk_, weights=g[:, j], minlength=len(p.emit))
    return float(np.log(scale).sum())


def log10_likelihood(ids: np.ndarray, offsets: np.ndarray, p: Params) -> np.ndarray:
    """Exact log10 probability of each document's ids (none is empty)."""
    lens = np.diff(offsets)
    out = np.zeros(len(lens))
    short = np.flatnonzero((lens <= DIRECT) & (lens > 0))
    if len(short):
        order = short[np.argsort(-lens[short], kind="stable")]
        n, start = lens[order], offsets[:-1][order]
        live = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
        x, total = None, np.zeros(len(order))
        for t in range(int(n[0])):
            m = live[t]
            x = (np.repeat(p.start[None], m, axis=0) if t == 0 else x[:m] @ p.move) * p.emit[ids[start[:m] + t]]
            s = x.sum(axis=1)
            x /= s[:, None]
            total[:m] += np.log10(s)
        out[order] = total
    for d in np.flatnonzero(lens > DIRECT).tolist():
        out[d] = _long(ids[offsets[d] : offsets[d + 1]], p)
    return out


def _long(ids: np.ndarray, p: Params) -> float:
    """The same recursion with the matrix product taken over stretches in
    parallel, then along the stretches."""
    k = p.states
    x = p.start * p.emit[ids[0]]
    total = np.log10(x.sum())
    x = x / x.sum()
    rest = ids[1:]
    whole = len(rest) // STRETCH
    grid = rest[: whole * STRETCH].reshape(whole, STRETCH)
    m = np.repeat(np.eye(k)[None], whole, axis=0)
    logs = np.zeros(whole)
    for t in range(STRETCH):
        m = (m.reshape(-1, k) @ p.move).reshape(whole, k, k) * p.emit[grid[:, t]][:, None, :]
        if t % 4 == 3 or t == STRETCH - 1:
            s = m.sum(axis=(1, 2))
            m /= s[:, None, None]
            logs += np.log10(s)
    for i in range(whole):
        x = x @ m[i]
        s = x.sum()
        total += np.log10(s) + logs[i]
        x = x / s
    for w in rest[whole * STRETCH :]:
        x = (x @ p.move) * p.emit[w]
        s = x.sum()
        total += np.log10(s)
        x = x / s
    return float(total)


def first_guess(ids: np.ndarray, offsets: np.ndarray, k: int, m: int, floor: np.ndarray, rounds: int = 12, seed: int = 7) -> Params:
    """Documents in ``k`` clusters by their tokens (hard EM of a mixture of
    unigrams); each cluster's tokens start a state."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    part = np.random.default_rng(seed).integers(0, k, n)
    emit = np.repeat(floor[:, None], k, axis=1)
    for _ in range(rounds):
        counts = np.zeros((m, k))
        np.add.at(counts, (ids, part[doc]), 1.0)
        emit = counts + 50.0 * floor[:, None]
        emit /= emit.sum(axis=0, keepdims=True)
        logs = np.log(emit)
        score = np.stack([np.bincount(doc, weights=logs[ids, j], minlength=n) for j in range(k)], axis=1)
        part = score.argmax(axis=1)
    share = np.bincount(part, minlength=k) + 1.0
    return Params(share / share.sum(), share / share.sum(), np.full((k, k), 0.05 / k) + 0.95 * np.eye(k), emit)
