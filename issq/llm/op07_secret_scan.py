"""Secret scanning with multipart credential linking.

Native: DataFrame functions only. Strong patterns (assignments, access
identifiers, long hexadecimal runs) are always reported. Weak candidates, i.e.
unlabelled random-looking tokens and short password assignments, are reported
only when a complementary part stands near: an identifier (access id, user or
client name) or an endpoint (url, host with port) whose span begins or ends
within ``SCOPE`` code points. The interval join sorts a document's parts by
position and takes the nearest identifier and endpoint on either side with
window functions, linear in the number of parts.

Positions come from splitting the text at the matches: a match starts after
all pieces and matches before it (two-level prefix sums, so a text with very
many matches stays cheap). Patterns run in Java, leftmost and non-overlapping;
positions are code points, end exclusive.

Defined results: null and empty texts have no spans; ids may be null or repeat
(a row is scanned by itself); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issq.llm.common import Scratch, session_limits

#: Base patterns (fixed by the contract): kind, pattern, group, least length
#: of the group, and a cheap test that every kept match passes.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
     r"""(?i)(?:passw|secret|token|api_?key)[^\n]*?[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
]
#: Weak candidates and the parts that complete them.
WEAK = [
    ("weak", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}", 0, 20, r"[A-Za-z0-9+/_=-]{20}"),
    ("weak", r"""(?i)\b(?:pwd|pass|passphrase|auth)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{4,})""", 1, 4, r"(?i)(?:pwd|pass|passphrase|auth)[\"']?\x20*[:=]"),
]
PARTS = [
    ("id", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("id", r"""(?i)\b(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]+)""", 0, 1, r"(?i)(?:user|username|login|client_?id|account)[\"']?\x20*[:=]"),
    ("end", r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+""", 0, 1, "://"),
]
SCOPE = 200
KINDS = ["assign", "access", "hex", "linked"]
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once (a lambda would otherwise repeat
    the expression for every element)."""
    return F.transform(F.array(value), body)[0]


def before(lengths: Column, block: int = 64) -> Column:
    """Exclusive prefix sums of an int array, in blocks."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.greatest(F.size(xs), F.lit(1)) - 1) / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, F.lit(block))))
        bases = let(blocks, lambda bs: F.transform(bs, lambda _, i: total(F.slice(bs, F.lit(1), i))))
        return let(bases, lambda base: F.transform(xs, lambda _, i: base[(i / block).cast("int")] + total(F.slice(xs, ((i / block).cast("int")) * block + 1, i % block))))

    return let(lengths, of)


def spans(text: Column, kind: int, pattern: str, group: int, least: int, quick: str) -> Column:
    """Kept matches as structs (start, kind, stop), in order."""
    p = F.lit(pattern)

    def placed(both: Column) -> Column:
        whole, part, gaps = both["whole"], both["part"], both["gaps"]
        steps = F.transform(whole, lambda m, i: F.length(gaps[i]) + F.length(m))

        def rows(at: Column) -> Column:
            return F.transform(
                whole,
                lambda m, i: F.struct(
                    (at[i] + F.length(gaps[i])).alias("start"), F.lit(kind).alias("kind"),
                    (at[i] + F.length(gaps[i]) + F.length(m)).alias("stop"), F.length(part[i]).alias("size"),
                ),
            )

        kept = F.filter(let(before(steps), rows), lambda r: r["size"] >= least)
        return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["stop"].alias("stop")))

    found = F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"), F.split(text, pattern, -1).alias("gaps")
    )
    return F.when(text.rlike(quick), let(found, placed)).otherwise(F.array().cast(SPAN))


def written(spans_: Column) -> Column:
    """kind:start:stop, by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans_), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (strong spans) and linked (weak spans with a complement near),
    each an array of (start, kind number in ``KINDS``, stop)."""
    spark = df.sparkSession
    session_limits(spark)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    text = F.col("t")
    base = F.concat(*[spans(text, k, *spec[1:]) for k, spec in enumerate(BASE)])
    part_of = {"weak": 3, "id": 4, "end": 5}
    weak = F.concat(*[spans(text, part_of[s[0]], *s[1:]) for s in WEAK])
    near = F.concat(*[spans(text, part_of[s[0]], *s[1:]) for s in PARTS])
    found = rows.select("id", base.alias("base"), weak.alias("weak"), near.alias("near"), F.monotonically_increasing_id().alias("row"))
    scanned = Scratch(spark, "secrets").table(found, "spans")
    both = (F.size("weak") > 0) & (F.size("near") > 0)
    parts = scanned.where(both).select("row", F.explode(F.concat("weak", "near")).alias("p")).select("row", "p.*")
    w = Window.partitionBy("row").orderBy("start", "kind", "stop")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    other = F.col("kind") > 3
    # The end that reaches furthest before, and the start that comes first after.
    gap = F.least(
        F.col("start") - F.max(F.when(other, F.col("stop"))).over(back),
        F.first(F.when(other, F.col("start")), ignorenulls=True).over(ahead) - F.col("stop"),
    )
    linked = (
        parts.withColumn("gap", gap).where((F.col("kind") == 3) & (F.col("gap") <= SCOPE))
        .groupBy("row").agg(F.array_distinct(F.collect_list(F.struct("start", "kind", "stop"))).cast(SPAN).alias("linked"))
    )
    out = scanned.join(linked, "row", "left")
    # A weak span within a strong one says nothing new.
    fresh = F.filter("linked", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])))
    return out.select(F.col("id").alias(id_col), "base", F.coalesce(fresh, F.array().cast(SPAN)).alias("linked"))
