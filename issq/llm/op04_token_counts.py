"""Token counts by prefix dynamic programming.

For every text the exact token count at each prefix that ends with a word is
stored: counts[j] = counts[j-1] + tokens of word j, where the tokens of a
distinct word are found once. The stored table answers how many tokens a
prefix has (``tokens_at``) and where to cut for a budget (``cut_at``) without
encoding anything again. Prefixes that end inside a word count up to the last
whole word there.

With ``every_byte`` a second table has the exact count at every byte: tokens of
the whole words before it plus those of the broken word's own prefix, found once
for each distinct word (``tokens_upto``, ``longest_within``). It takes four
bytes a byte of text, and the work on one word grows with the square of its
length. It needs a tokenizer that works word by word (others raise an error).

Defined results: null counts as empty, and an empty text has 0 bytes, 0 tokens
and empty tables; ids may be null or repeat (one row out per row in); an empty
table gives no rows. Texts are encoded whole, a very long one as a piece of its
own. Other columns are not read, so their names may clash with the result's; a
result column gets a trailing underscore where the id column has its name.
Tokenizers that do not work word by word get one entry a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issq.llm import textkernel as tk
from issq.llm.bpe import coder
from issq.llm.common import free_name, session_limits

TABLE = "n_bytes long, n_tokens long, prefix_bytes array<int>, prefix_tokens array<int>"
EVERY = "tokens_upto array<int>"


def _count(batches: Iterator[pa.RecordBatch], path: str, tables: bool, every_byte: bool) -> Iterator[pa.RecordBatch]:
    model = coder(path)
    for batch in batches:
        texts = tk.no_nulls(batch.column(1))
        for a, b in tk.pieces(texts):
            part = texts.slice(a, b - a)
            _, offsets = tk.buffers(part)
            _, id_off, ends, upto, at = model.encode(part)
            # n_tokens is the table's last entry
            last = np.zeros(b - a, dtype=np.int64)
            full = at[1:] > at[:-1]
            last[full] = upto[at[1:][full] - 1]
            columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(last)]
            names = ["id", "n_bytes", "n_tokens"]
            if tables:
                bounds = pa.array(at.astype(np.int32))
                columns += [pa.ListArray.from_arrays(bounds, pa.array(ends.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(upto.astype(np.int32)))]
                names += ["prefix_bytes", "prefix_tokens"]
            if every_byte:
                counts, bounds, broken = model.every_prefix(part)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(counts.astype(np.int32), mask=broken)))
                names.append("tokens_upto")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tables: bool = True, every_byte: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, with ``tables`` the prefix tables, and with
    ``every_byte`` tokens_upto: entry p is the count of the first p bytes, null
    where they end inside a character."""
    session_limits(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", TABLE if tables else "n_bytes long, n_tokens long", *[EVERY] * every_byte])
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(lambda it: _count(it, tokenizer_path, tables, every_byte), schema)
    names = [id_col]
    for c in out.columns[1:]:
        names.append(free_name(names, c))
    return out.toDF(*names)


def tokens_upto(n_bytes: Column, table: Column) -> Column:
    """Tokens of the first ``n_bytes`` bytes by the table of every byte, up to
    the last whole character; beyond the text's end, of all of it."""
    p = F.least(n_bytes, F.size(table))
    entries = [F.when(p > k, F.get(table, (p - 1 - k).cast("int"))) for k in range(4)]
    return F.coalesce(*entries, F.lit(0))


def longest_within(budget: Column, table: Column) -> Column:
    """Bytes of the longest prefix, whole characters, of at most ``budget``
    tokens. A longer prefix can have fewer tokens, so it is the last entry."""
    fits = F.transform(table, lambda v, i: F.when(v <= budget, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0))


def _entries_upto(values: Column, bound: Column) -> Column:
    """How many entries of an ascending array are at most ``bound``."""
    return F.size(F.filter(values, lambda v: v <= bound))


def tokens_at(n_bytes: Column, prefix_bytes: Column, prefix_tokens: Column) -> Column:
    """Tokens of the whole words within the first ``n_bytes`` bytes."""
    j = _entries_upto(prefix_bytes, n_bytes)
    return F.when(j > 0, F.element_at(prefix_tokens, j)).otherwise(F.lit(0))


def cut_at(budget: Column, prefix_bytes: Column, prefix_tokens: Column) -> Column:
    """Bytes of the longest run of whole words with at most ``budget`` tokens."""
    j = _entries_upto(prefix_tokens, budget)
    return F.when(j > 0, F.element_at(prefix_bytes, j)).otherwise(F.lit(0))
