"""Quality of documents from a linear-chain conditional random field.

Every line of a text is labelled good or bad by a two-state chain whose node
potentials see the line's own features and those of its neighbours. Exact
forward-backward marginals, weighted by line length, are averaged into the
document's quality, which a two-parameter logistic curve fitted on the same
labelled rows turns into a probability.

Only documents are labelled, so line labels are found in rounds: all lines of
a good document are good; of a bad one those are bad that the current node
model takes for bad, at least its worst line.

Inputs of a score: the text only. Defined results: null, empty and blank texts
have one empty line; without labels of both kinds the score is 0.5. Texts of any
length are read whole, in fitting as well. Ids may be null or repeat; an empty
table gives an empty result. Other columns are not read, so their names may
clash; a result column gets a trailing underscore where the id column has its
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.llm import textkernel as tk
from issq.llm.common import held_out, session_limits
from issq.llm.labelled import MAX_ROWS, fit_logistic, judged, labelled_sample, sigmoid

_CLASS = np.zeros(256, dtype=np.int8)  # 0 other
for _b in range(256):
    if chr(_b).isalpha() and _b < 128:
        _CLASS[_b] = 1 if chr(_b).islower() else 2
    elif 48 <= _b < 58:
        _CLASS[_b] = 3
    elif 33 <= _b < 127:
        _CLASS[_b] = 4  # ASCII marks
    elif _b >= 128:
        _CLASS[_b] = 5
_END_MARKS = np.zeros(256, dtype=bool)
_END_MARKS[[ord(c) for c in ".,;:!?"]] = True


def line_features(texts: pa.Array):
    """(features by line, n+1 line offsets, line weights) of texts without
    nulls; a text without line breaks is one line."""
    buf, offsets = tk.buffers(texts)
    breaks = np.flatnonzero(buf == 10)
    doc_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    n = len(texts)
    per_doc = np.bincount(doc_of_break, minlength=n) + 1
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(per_doc, out=at[1:])
    begin = np.empty(int(at[-1]), dtype=np.int64)
    is_first = np.zeros(len(begin), dtype=bool)
    is_first[at[:-1]] = True
    begin[is_first] = offsets[:-1]
    begin[~is_first] = breaks + 1
    end = np.empty_like(begin)
    is_last = np.zeros(len(begin), dtype=bool)
    is_last[at[1:] - 1] = True
    end[is_last] = offsets[1:]
    end[~is_last] = breaks
    size = end - begin
    wide = np.maximum(size, 1).astype(float)
    kind = _CLASS[buf]
    total = np.zeros(len(buf) + 1, dtype=np.int32 if len(buf) < 2**31 else np.int64)

    def count(mask: np.ndarray, head: np.ndarray = begin, tail: np.ndarray = end) -> np.ndarray:
        np.cumsum(mask, out=total[1:])
        return (total[tail] - total[head]).astype(float)

    marks = kind == 4
    double = np.zeros(len(buf), dtype=bool)
    if len(buf) > 1:
        double[1:] = (buf[1:] == buf[:-1]) & marks[1:]
    rows = [count(kind == k) / wide for k in (2, 3, 4, 5)]
    rows.append(count(_END_MARKS[buf]) / wide)
    rows.append(count(double) / wide)
    rows += [count(buf == ord(c)) / wide for c in "|!*"]
    starts, ends, _ = tk.word_spans(buf, offsets)
    line = np.searchsorted(begin, starts, side="right") - 1
    hashes = tk.span_hashes(buf, starts, ends)
    n_lines = len(begin)
    words = np.bincount(line, minlength=n_lines).astype(float)
    many = np.maximum(words, 1)
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    key = np.sort((line.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28)))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    uniq = np.bincount((key[fresh] >> np.uint64(36)).astype(np.int64), minlength=n_lines)
    long_words = np.bincount(line[(ends - starts) > 15], minlength=n_lines)
    alone = np.bincount(line[marks[starts] & marks[ends - 1]], minlength=n_lines) if len(starts) else np.zeros(n_lines)
    capital = np.bincount(line[kind[starts] == 2], minlength=n_lines) if len(starts) else np.zeros(n_lines)
    rows += [
        np.bincount(line[again], minlength=n_lines) / many, 1 - uniq / many, long_words / many, alone / many, capital / many,
        np.log1p(words) / 5, np.where(words > 0, size / many / 20, 0), size == 0,
    ]
    text_hash = np.zeros(n_lines, dtype=np.uint64)
    np.bitwise_xor.at(text_hash, line, tk.mix(hashes + np.arange(len(hashes), dtype=np.uint64) - np.searchsorted(starts, begin)[line].astype(np.uint64)))
    same = np.zeros(n_lines, dtype=bool)
    same[1:] = (text_hash[1:] == text_hash[:-1]) & (words[1:] > 0)
    same[at[:-1]] = False
    rows.append(same)
    own = np.stack(rows, axis=1).astype(np.float64)
    own = np.hstack([own, np.sqrt(own[:, :9])])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[at[:-1]], after[at[1:] - 1] = 0, 0
    edge = np.stack([is_first, is_last], axis=1).astype(float)
    return np.hstack([own, before, after, edge]), at, wide


def forward_backward(node: np.ndarray, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1 by line, summed pair marginals (2 x 2), and the log
    of all partition functions. node: log potential of state 1 against 0."""
    n, longest = len(at) - 1, int(np.diff(at).max(initial=0))
    order = np.argsort(-np.diff(at), kind="stable")
    lens, first = np.diff(at)[order], at[:-1][order]
    alpha = np.empty((len(node), 2))
    scale = np.empty(len(node))
    e = np.exp(np.clip(node, -30, 30))
    t_ = np.exp(move)
    live = np.searchsorted(-lens, -np.arange(longest), side="left")
    for t in range(longest):
        i = first[: live[t]] + t
        a = np.stack([np.ones(len(i)), e[i]], axis=1)
        if t:
            a *= alpha[i - 1] @ t_
        s = a.sum(axis=1)
        alpha[i], scale[i] = a / s[:, None], s
    beta = np.ones((len(node), 2))
    pair = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        i = first[: live[t]] + t
        right = np.stack([np.ones(len(i)), e[i]], axis=1) * beta[i] / scale[i][:, None]
        pair += t_ * (alpha[i - 1].T @ right)
        beta[i - 1] = right @ t_.T
    return alpha[:, 1] * beta[:, 1] / (alpha * beta).sum(axis=1), pair, float(np.log(scale).sum())


class Model:
    def __init__(self, weights: np.ndarray, move: np.ndarray, curve: tuple[float, float]):
        self.weights, self.move, self.curve = weights, move, curve

    def raw(self, texts: pa.Array) -> np.ndarray:
        x, at, wide = line_features(texts)
        node = x @ self.weights[:-1] + self.weights[-1]
        good, _, _ = forward_backward(node, at, self.move)
        return tk.sums(good * wide, at) / tk.sums(wide, at)

    def score(self, texts: pa.Array) -> np.ndarray:
        return curve(self.raw(texts), self.curve)


def curve(raw: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    return sigmoid(ab[0] * stretch(raw) + ab[1])


def stretch(raw: np.ndarray) -> np.ndarray:
    p = np.clip(raw, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(sample: pa.Table, rounds: int = 3, steps: int = 150) -> Model:
    y = np.asarray(sample["y"].to_pylist(), dtype=np.int64)
    width = None
    if not len(y) or y.min() == y.max():
        width = line_features(pa.array([""]))[0].shape[1]
        return Model(np.zeros(width + 1), np.zeros((2, 2)), (0.0, 0.0))
    texts = tk.no_nulls(sample["text"])
    got = [line_features(texts.slice(a, b - a)) for a, b in tk.pieces(texts)]
    x = np.vstack([g[0] for g in got])
    lens = np.concatenate([np.diff(g[1]) for g in got])
    at = np.concatenate([[0], np.cumsum(lens)])
    doc = np.repeat(np.arange(len(y)), lens)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = (balance / np.maximum(lens, 1) ** 0.5)[doc]
    state = y[doc].astype(float)
    for _ in range(rounds):
        w = fit_logistic(x, state, l2=0.5, rounds=25, weight=weight)
        p = sigmoid(x @ w[:-1] + w[-1])
        worst = np.minimum.reduceat(p, at[:-1])[doc]
        state = np.where(y[doc] == 1, 1.0, ((p > 0.5) & (p > worst)).astype(float))
    # The chain's likelihood, node weights and moves together (Adam).
    theta = np.concatenate([w, np.zeros(4)])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    target_pair = np.zeros((2, 2))
    inner = np.ones(len(doc), dtype=bool)
    inner[at[:-1]] = False
    i = np.flatnonzero(inner)
    np.add.at(target_pair, (state[i - 1].astype(int), state[i].astype(int)), 1.0)
    xb = np.hstack([x, np.ones((len(x), 1))])
    for t in range(1, steps + 1):
        good, pair, _ = forward_backward(xb @ theta[:-4], at, theta[-4:].reshape(2, 2))
        g = np.concatenate([xb.T @ (good - state) + 1.0 * theta[:-4], (pair - target_pair).ravel() + 1.0 * theta[-4:]]) / len(y)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
    raw = np.concatenate([model.raw(texts.slice(a, b - a)) for a, b in tk.pieces(texts)])
    fitted = fit_logistic(stretch(raw)[:, None], y.astype(float), l2=0.01)
    model.curve = (float(max(fitted[0], 0.0)), float(fitted[1]))
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tk.no_nulls(batch.column(1))
        for a, b in tk.pieces(texts, tk.PIECE // 2):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(texts.slice(a, b - a)))], names=["id", "score"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    session_limits(docs.sparkSession)
    return train(labelled_sample(docs, labels, "quality", 3, 1, max_rows))


def quality(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    session_limits(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(lambda it: _score(it, model), f"id {df.schema[id_col].dataType.simpleString()}, score double")
    return judged(out, id_col, held_out("id", 3, 1))
