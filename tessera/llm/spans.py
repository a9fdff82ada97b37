"""Positions of regular-expression matches, in DataFrame functions alone.

Spark gives matches (regexp_extract_all) and what lies between them (split); their lengths give the positions, in
code points. Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 512
SPAN = "array<struct<start: bigint, stop: bigint, kind: int, hit: string, extra: string>>"


def none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _cut(xs: Column) -> Column:
    """xs in blocks of _BLOCK (for an array that is not empty)."""
    last = F.floor((F.size(xs) - 1) / _BLOCK)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda b: F.slice(xs, (b * _BLOCK + 1).cast("int"), F.lit(_BLOCK)))


def matches(text: Column, pattern: str, kind: int, group: int = 0, before: int = 0) -> Column:
    """Leftmost non-overlapping matches: array<struct<start, stop, kind, hit, extra>>, stop exclusive.

    hit is the match; extra is its group, or, with before, up to so many characters between the last match and this
    one, those next to it. A running position is folded over blocks of matches, so that a text with
    very many of them costs little more than in proportion.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    extra = F.transform(F.slice(between, F.lit(1), F.size(hits)), lambda b: F.right(b, F.lit(before))) if before else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda b, h: F.struct(F.char_length(b).cast("bigint").alias("gap"), h.alias("hit"))), extra, lambda s, x: F.struct(s["gap"].alias("gap"), s["hit"].alias("hit"), x.alias("extra")))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        stop = start + F.char_length(s["hit"])
        made = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), s["hit"].alias("hit"), s["extra"].alias("extra"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), none().alias("out")), step)
        # the fold runs once: its result is an element of a one-element array
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), 1)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
    found = F.aggregate(_cut(steps), start, block, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), found).otherwise(none())


def listed(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:stop of the spans by start, then kind as listed, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def blank_out(text: Column, spans: Column, mark: str) -> Column:
    """The text with each maximal run of overlapping spans replaced by mark."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame, scan: Callable[[DataFrame], DataFrame], mark: str) -> DataFrame:
    """docs with the spans that scan finds in text (base and added) replaced by mark, and n_chars (if there) counted anew."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("__")).alias("row"), "text")
    found = scan(rows).select("row", "text", F.concat("base", "added").alias("spans"))
    made = found.withColumn("done", F.when(F.size("spans") > 0, blank_out(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text")))
    new = {"text": F.col("done").alias("text")}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.size("spans") > 0, F.char_length("done")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return made.select(*(new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))


def best(scored: Column) -> Column:
    """Scored spans (start, stop, over, span) without overlaps, taken from the left.

    A fold in order of start keeps one open span. Where the next overlaps it, one that holds the other stays (so that a
    mark covers both), else the one with the greater `over`, ties to the first.
    """
    order = F.array_sort(scored)
    kind = "struct<start: bigint, stop: bigint, over: double, span: " + SPAN[len("array<") : -1] + ">"
    begin = F.expr(f"named_struct('open', cast(null as {kind}), 'out', cast(array() as {SPAN}))")

    def step(acc: Column, c: Column) -> Column:
        apart = F.coalesce(c["start"] >= acc["open"]["stop"], F.lit(True))
        closed = F.when(apart & acc["open"].isNotNull(), F.concat(acc["out"], F.array(acc["open"]["span"]))).otherwise(acc["out"])
        wider = (c["stop"] > acc["open"]["stop"]) & ((c["start"] == acc["open"]["start"]) | (c["over"] > acc["open"]["over"]))
        return F.struct(F.when(apart | wider, c).otherwise(acc["open"]).alias("open"), closed.alias("out"))

    return F.aggregate(order, begin, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]["span"]))))
