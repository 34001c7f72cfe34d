"""Toxicity by weak supervision.

Many voters look at a document: fixed insult and pattern voters, and lexicon
voters, two for each kind of feature (whole words, and word beginnings of four
lengths). A generative label model (EM) estimates each voter's
class-conditional accuracy and the voters' residual correlations, which
discount voters that repeat each other. A linear classifier is then trained on
the posterior labels alone and scores every document. The given labels are no
voter and no target: they serve to mine the lexicons' entries and cuts, and the
share of toxic rows that the label model starts from.

Inputs of a score: the text only. Defined results: null or blank text scores
as a text without words (the classifier's intercept); without any usable
labels every document scores 0 by the fixed voters' absence of evidence, i.e.
the share of toxic rows is taken as 0.1 and only the fixed insult voter counts.
Texts of any length are read whole, in fitting as well. Ids may be null or
repeat; an empty table gives an empty result. Other columns are not read, so
their names may clash; a result column gets a trailing underscore where the id
column has its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issq.llm import textkernel as tk
from issq.llm.common import held_out, session_limits
from issq.llm.labelled import judged, labelled_sample, sigmoid

#: General insults in English, a voter that needs no labels (fixed values).
INSULTS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown"]
#: Byte lengths of the word beginnings used as features; 0 is the whole word.
HEADS = (0, 5, 6, 7, 8)
FEATURES = 1500
#: Labelled rows that the voters and the classifier are fitted on, at most.
MAX_ROWS = 4000
MIN_DOCS = 3
#: Lexicon voters of each kind of feature: entries by rank among that kind.
LEXICONS = ((0, 40), (40, 400))
#: Share of the rows labelled 0 that a lexicon voter must not call toxic.
CLEAN = 0.99
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def trimmed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without ASCII punctuation at their ends (at least one byte)."""
    starts, ends = starts.copy(), ends.copy()
    for moving, step, at in ((ends, -1, -1), (starts, 1, 0)):
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[PUNCT[buf[moving[todo] + at]] & (ends[todo] - starts[todo] > 1)]
            moving[todo] += step
    return starts, ends


def features(texts: pa.Array):
    """(n+1 word offsets, list of feature hash arrays by HEADS, masks of the
    words long enough, share of shouting words, marks) of texts without nulls."""
    raw, offsets = tk.buffers(texts)
    buf = tk.lowered(raw)
    starts, ends, at = tk.word_spans(buf, offsets)
    s, e = trimmed(buf, starts, ends)
    hashes = tk.span_hashes(buf, s, *[e if not h else np.minimum(s + h, e) for h in HEADS]) if len(s) else [np.zeros(0, dtype=np.uint64)] * len(HEADS)
    hashes = [h ^ np.uint64(0x51ED270B * (k + 1)) for k, h in enumerate(hashes)]
    masks = [np.ones(len(s), dtype=bool) if not h else (e - s) > h for h in HEADS]
    total = np.zeros(len(raw) + 1, dtype=np.int64)
    upper = (raw >= 65) & (raw <= 90)
    np.cumsum(upper, out=total[1:])
    capital = total[offsets[1:]] - total[offsets[:-1]]
    np.cumsum(raw == 33, out=total[1:])
    marks = total[offsets[1:]] - total[offsets[:-1]]
    length = np.maximum(np.diff(offsets), 1)
    return at, hashes, masks, capital / length, marks / length


class Model:
    """Mined features with weights, and what the voters contribute."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], float(bias)
        self.gate = np.zeros(1 << 16, dtype=bool)
        self.gate[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(self, at, hashes, masks):
        """(document, feature index) of every occurrence of a mined feature."""
        docs, cols = [], []
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for h, mask in zip(hashes, masks):
            i = np.flatnonzero(self.gate[(h & np.uint64(0xFFFF)).astype(np.int64)] & mask)
            j = np.minimum(np.searchsorted(self.keys, h[i]), len(self.keys) - 1)
            hit = self.keys[j] == h[i]
            docs.append(np.searchsorted(at, i[hit], side="right") - 1)
            cols.append(j[hit])
        return np.concatenate(docs), np.concatenate(cols)

    def values(self, at, hashes, masks):
        """Sparse (document, feature, value); value: dampened density."""
        docs, cols = self.matches(at, hashes, masks)
        n = max(len(self.keys), 1)
        pair, count = np.unique(docs * n + cols, return_counts=True)
        docs, cols = pair // n, pair % n
        words = np.maximum(np.diff(at), 1)[docs] if len(docs) else np.zeros(0)
        return docs, cols, damp(count, words)

    def score(self, texts: pa.Array) -> np.ndarray:
        at, hashes, masks, *_ = features(texts)
        docs, cols, value = self.values(at, hashes, masks)
        z = np.bincount(docs, weights=self.weights[cols] * value, minlength=len(texts)) if len(docs) else np.zeros(len(texts))
        return sigmoid(z + self.bias)


def damp(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(100.0 * count / (words + 20.0))


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 from votes (rows x voters; -1 abstains, else 0 or
    1), the accuracy table [voter, class, vote], and the voters' discounts."""
    n, m = votes.shape
    table = np.empty((m, 2, 3))
    table[:, 0], table[:, 1] = (0.3, 0.5, 0.2), (0.3, 0.2, 0.5)  # abstain, 0, 1
    discount = np.ones(m)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    share = prior
    for step in range(rounds):
        logit = np.log(share / (1 - share)) + np.einsum("nmv,mv->nm", onehot, np.log(table[:, 1]) - np.log(table[:, 0])) @ discount
        q = sigmoid(logit)
        for y, w in ((0, 1 - q), (1, q)):
            counts = np.einsum("n,nmv->mv", w, onehot) + np.array([1.0, 1.0, 1.0])
            table[:, y] = counts / counts.sum(axis=1, keepdims=True)
        share = min(max(q.mean(), 0.01), 0.99)
        if step >= 3:  # residual correlation, given the class
            x = votes.astype(float)
            expected = sum(w[:, None] * (table[:, y, 2] - table[:, y, 0])[None] for y, w in ((0, 1 - q), (1, q)))
            r = x - expected
            sd = np.sqrt((r * r).mean(axis=0)) + 1e-6
            rho = np.clip((r.T @ r) / n / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(rho, 0)
            discount = 1.0 / (1.0 + rho.sum(axis=1))
    return q, table, discount


def train(sample: pa.Table, n_features: int = FEATURES) -> Model:
    texts = tk.no_nulls(sample["text"]) if sample.num_rows else pa.array([], pa.string())
    y = np.asarray(sample["y"].to_pylist(), dtype=np.int64)
    fixed = tk.words_of(pa.array([" ".join(INSULTS)]))[4] ^ np.uint64(0x51ED270B)
    if not len(y) or y.min() == y.max():
        return Model(fixed, np.full(len(fixed), 4.0), np.log(0.1 / 0.9))
    n, found, kinds = len(y), [], {}
    parts = [(a, texts.slice(a, b - a)) for a, b in tk.pieces(texts)]
    # Mining: mean dampened density by class, against its spread; one kind of
    # feature at a time, and piece by piece, to bound the memory.
    for k in range(len(HEADS)):
        keys_, docs_, values_ = [], [], []
        for base, part in parts:
            at, hashes, masks, *_ = features(part)
            doc = np.repeat(np.arange(len(part)), np.diff(at))[masks[k]]
            key, inv = np.unique(hashes[k][masks[k]], return_inverse=True)
            pair, count = np.unique(inv * len(part) + doc, return_counts=True)
            keys_.append(key[pair // len(part)])
            docs_.append((pair % len(part) + base).astype(np.int32))
            values_.append(damp(count, np.diff(at)[pair % len(part)]).astype(np.float32))
        key, f = np.unique(np.concatenate(keys_), return_inverse=True)
        d, v = np.concatenate(docs_), np.concatenate(values_)
        docs_with = np.bincount(f, minlength=len(key))
        s1, s0 = (np.bincount(f, weights=v * (y[d] == c), minlength=len(key)) for c in (1, 0))
        sq = np.bincount(f, weights=v * v, minlength=len(key))
        m1, m0 = s1 / y.sum(), s0 / (n - y.sum())
        var = sq / n - ((s1 + s0) / n) ** 2
        strength = np.where((docs_with >= MIN_DOCS) & (m1 > m0), (m1 - m0) / np.sqrt(var + 1e-4) * np.sqrt(n), 0)
        keep = np.argsort(-strength)[:n_features]
        found += [(strength[i], key[i]) for i in keep if strength[i] > 0]
        kinds |= dict.fromkeys(key[keep].tolist(), k)
        del keys_, docs_, values_, key, f, d, v
    found.sort(key=lambda x: (-x[0], x[1]))
    seen, ranked = set(), []
    for item in found:
        if item[1] not in seen:
            seen.add(item[1])
            ranked.append(item)
    ranked = [(np.inf, k) for k in fixed] + [x for x in ranked if x[1] not in set(fixed.tolist())]
    ranked = ranked[:n_features]
    keys = np.array([x[1] for x in ranked], dtype=np.uint64)
    rank = {k: r for r, k in enumerate(keys.tolist())}
    model = Model(keys, np.zeros(len(keys)), 0.0)
    got, hits, capital, marks = [], np.zeros(n), np.zeros(n), np.zeros(n)
    for base, part in parts:
        at, hashes, masks, capital_, marks_ = features(part)
        d, c, v = model.values(at, hashes, masks)
        got.append((d + base, c, v))
        rows = slice(base, base + len(part))
        capital[rows], marks[rows] = capital_, marks_
        hits[rows] = tk.sums(np.isin(hashes[0], fixed).astype(np.int64), at)
    d, c, v = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.array([rank[k] for k in model.keys.tolist()], dtype=np.int64)
    # Voters
    votes = []
    votes.append(np.where(hits > 0, 1, -1))
    votes.append(np.where(marks > 0.01, 1, -1))
    votes.append(np.where(capital > 0.3, 1, -1))
    kind = np.array([kinds.get(k, 0) for k in model.keys.tolist()])
    for k in range(len(HEADS)):
        own = np.argsort(np.where(kind == k, order, len(keys)))[: (kind == k).sum()]  # features of this kind by rank
        for lo, hi in LEXICONS:
            chosen = np.zeros(len(keys), dtype=bool)
            chosen[own[lo:hi]] = True
            inside = chosen[c]
            amount = np.bincount(d[inside], weights=v[inside], minlength=n)
            if amount.max() > 0:
                votes.append(np.where(amount > np.quantile(amount[y == 0], CLEAN), 1, np.where(amount <= 0, 0, -1)))
    target, _, _ = label_model(np.stack(votes, axis=1), float(y.mean()))
    weights, bias = fit_sparse(d, c, v, len(keys), target, start=np.where(np.isin(model.keys, fixed), 2.0, 0.0))
    return Model(model.keys, weights, bias)


def fit_sparse(d, c, v, n_cols: int, y: np.ndarray, start: np.ndarray, l2: float = 0.3, rounds: int = 400, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse (row, column, value) with Adam; weights
    are shrunk towards ``start``."""
    w, b, n = start.copy(), float(np.log(y.mean() / (1 - y.mean()))), len(y)
    m, s = np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(d, weights=w[c] * v, minlength=n) + b)
        r = p - y
        g = np.append(np.bincount(c, weights=r[d] * v, minlength=n_cols) + l2 * (w - start), r.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tk.no_nulls(batch.column(1))
        for a, b in tk.pieces(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(texts.slice(a, b - a)))], names=["id", "score"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    session_limits(docs.sparkSession)
    return train(labelled_sample(docs, labels, "toxic", 5, 0, max_rows))


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    session_limits(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(lambda it: _score(it, model), f"id {df.schema[id_col].dataType.simpleString()}, score double")
    return judged(out, id_col, held_out("id", 5, 0))


def _keep(batches: Iterator[pa.RecordBatch], model: Model, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tk.no_nulls(batch.column(text_col))
        keep = np.ones(batch.num_rows, dtype=bool)
        for a, b in tk.pieces(texts):
            keep[a:b] = model.score(texts.slice(a, b - a)) < 0.5
        yield batch.filter(pa.array(keep))


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, all columns kept."""
    session_limits(df.sparkSession)
    return df.mapInArrow(lambda it: _keep(it, model, text_col), df.schema)
