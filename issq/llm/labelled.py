"""A bounded sample of labelled rows for fitting, and small numpy fitters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issq.llm.common import free_name, held_out

#: Bounds of the sample a classifier is fitted on: labelled rows, and bytes of
#: their texts together. Rows are taken in the order of a hash of their id until
#: a bound is met, so neither bound looks at a single text's length.
MAX_ROWS = 8000
MAX_BYTES = 192 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> pa.Table:
    """Columns doc_id, text, y of labelled documents that are not held out, null
    texts as empty, in the order of a hash of the id: at most ``max_rows``, and
    whole texts of ``max_bytes`` together (one row at least)."""
    picked = (
        labels.select(F.col("doc_id").alias("k_"), F.col(f"`{label}`").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("k_").isNotNull()).where(~held_out("k_", modulus, remainder))
        .groupBy("k_").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k_"), "k_").limit(max_rows)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("k_")).select("doc_id", "text", "y")
    # Many rows may share one id: the bounds hold for rows as well.
    order = [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")]
    sizes = rows.orderBy(*order).limit(max_rows).select(F.octet_length("text").alias("n")).toArrow().column(0).to_numpy()
    fit = int(np.searchsorted(np.cumsum(sizes.astype(np.int64)), max_bytes, side="right"))
    return rows.orderBy(*order).limit(max(fit, 1)).toArrow()


def judged(out: DataFrame, id_col: str, held: Column) -> DataFrame:
    """id, held_out, score, predicted from columns id and score."""
    names: list[str] = []
    for c in ("held_out", "score", "predicted"):
        names.append(free_name([id_col, *names], c))
    return out.select(F.col("id").alias(id_col), held.alias(names[0]), F.col("score").alias(names[1]), (F.col("score") >= 0.5).cast("int").alias(names[2]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 60, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression (last entry: intercept, not shrunk) by
    Newton steps; y may be soft. Few columns only."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6
    sample = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (sample * (p - y)) + reg * w
        h = (x * (sample * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w
