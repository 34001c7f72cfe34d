"""Base calling and per-read value arithmetic on ``values[cycle][channel]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from issq.schema import CHANNELS


def letters(values: Column, channels: list[str] = CHANNELS) -> Column:
    """The called letter of each cycle: the channel of the largest value, the
    first one of ties (and the first NaN, as NaN counts as largest)."""
    names = F.array(*[F.lit(c) for c in channels])
    return F.transform(values, lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int")))


def sequence(values: Column, explicit: Column | None = None, channels: list[str] = CHANNELS) -> Column:
    """The called read; an explicit sequence takes precedence."""
    called = F.array_join(letters(values, channels), "")
    return called if explicit is None else F.coalesce(explicit, called)


def letter_array(text: Column) -> Column:
    return F.split(text, "")


def overwrite(text: Column, every: int, letter: str) -> Column:
    """Set each ``every``-th letter (from the first) to ``letter``."""
    return F.array_join(F.transform(F.split(text, ""), lambda b, i: F.when(i % every == 0, F.lit(letter)).otherwise(b)), "")


def qualities(values: Column) -> Column:
    return F.transform(values, lambda v: F.array_max(v))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def second_largest(v: Column) -> Column:
    return F.element_at(F.array_sort(v), -2)


def normalize(values: Column, method: str = "full") -> Column:
    """full: each cycle over max(1e-10, its L2 norm); large: over max(1, norm);
    sub: less the second largest channel; anything else: unchanged."""
    if method in ("full", "large"):
        floor = 1e-10 if method == "full" else 1.0
        return F.transform(values, lambda v: _over(v, F.greatest(norm(v), F.lit(floor))))
    if method == "sub":
        return F.transform(values, lambda v: _less(v, second_largest(v)))
    return values


def _over(v: Column, by: Column) -> Column:
    return F.transform(F.array(by), lambda d: F.transform(v, lambda x: x / d))[0]


def _less(v: Column, by: Column) -> Column:
    return F.transform(F.array(by), lambda d: F.transform(v, lambda x: x - d))[0]


def ratios(values: Column) -> Column:
    """Largest over second largest (at least 1e-6) channel, by cycle."""
    return F.transform(values, lambda v: F.array_max(v) / F.greatest(second_largest(v), F.lit(1e-6)))


def passes_filter(values: Column, threshold: float = 1.25, channels: list[str] = CHANNELS) -> Column:
    """Called letters are not all the same and the largest ratio stays below
    the threshold."""
    return (F.size(F.array_distinct(letters(values, channels))) > 1) & (F.array_max(ratios(values)) < threshold)
