"""Spans of regular expressions as DataFrame expressions: places, not just values.

An expression inside a lambda is worked out for each element, so whatever a lambda reads is bound once by once(). Folds
that gather states go in pieces of about sqrt(n) items, and texts are cut at places through pieces of PIECE characters:
the time for a text grows with its length and with n sqrt(n) of its n matches, with a small factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1024
SPAN = "array<struct<s:int,e:int,v:string>>"


def once(value: Column, f) -> Column:
    """f(value), where value is worked out once however often f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(items: Column, first: Column, step) -> Column:
    """The states after each item: step(state, item) from first on. A fold copies what it has gathered at every step,
    so it gathers at most about sqrt(n) states at a time."""
    last = lambda a: F.element_at(a, -1)

    def walk(x: Column) -> Column:
        n = F.size(x)
        length = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / length).cast("int")), lambda i: F.slice(x, i * length + 1, length))
        one = lambda piece, state: F.aggregate(piece, F.array(state), lambda acc, y: F.array_append(acc, step(last(acc), y)))
        walked = F.aggregate(pieces, F.array(F.array(first)), lambda acc, piece: F.array_append(acc, one(piece, last(last(acc)))))
        return F.flatten(F.transform(walked, lambda states: F.slice(states, 2, F.size(states) - 1)))

    return once(items, walk)


def with_matches(df: DataFrame, name: str, text: Column, regex: str, guard: Column | None = None) -> DataFrame:
    """Adds name: leftmost non-overlapping matches as (s, e, v), in code points, end exclusive.

    The pieces between matches give the places: a match starts after all pieces and matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    df = df.withColumn("_found", found if guard is None else F.when(guard, found).otherwise(F.array().cast("array<string>")))

    def step(span: Column, x: Column) -> Column:
        return once((span["e"] + x["p"]).cast("int"), lambda start: F.struct(start.alias("s"), (start + F.length(x["m"])).cast("int").alias("e"), x["m"].alias("v")))

    gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size("_found"))
    pairs = F.zip_with(gaps, F.col("_found"), lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m")))
    walked = running(pairs, F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("v")), step)
    return df.withColumn(name, F.when(F.size("_found") > 0, walked).otherwise(F.array().cast(SPAN))).drop("_found")


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined, of structs with kind, s and e."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def named(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")))


def clear_of(spans: Column, taken: Column) -> Column:
    """Spans that overlap none of the taken ones: one merge by start. Before a span the farthest end of those taken so far
    counts, after it the nearest start."""
    far = 2**31 - 1

    def merged(b: Column) -> Column:
        own = F.transform(b["spans"], lambda x, i: F.struct(x["s"].alias("s"), (i + 1).alias("i"), x["e"].alias("e")))
        other = F.transform(b["taken"], lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("i"), x["e"].alias("e")))
        return once(F.array_sort(F.concat(other, own)), lambda marks: F.transform(F.filter(around(marks), lambda m: (m["i"] > 0) & (m["upto"] <= m["s"]) & (m["next"] >= m["e"])), lambda m: F.element_at(b["spans"], m["i"])))

    def around(marks: Column) -> Column:
        upto = running(marks, F.lit(0), lambda state, x: F.when(x["i"] == 0, F.greatest(state, x["e"])).otherwise(state))
        following = F.reverse(running(F.reverse(marks), F.lit(far), lambda state, x: F.when(x["i"] == 0, x["s"]).otherwise(state)))
        both = F.zip_with(upto, following, lambda u, n: F.struct(u.alias("upto"), n.alias("next")))
        return F.zip_with(marks, both, lambda m, x: F.struct(m["s"].alias("s"), m["i"].alias("i"), m["e"].alias("e"), x["upto"].alias("upto"), x["next"].alias("next")))

    free = lambda b: F.when((F.size(b["spans"]) == 0) | (F.size(b["taken"]) == 0), b["spans"]).otherwise(merged(b))
    return once(F.struct(spans.alias("spans"), taken.alias("taken")), free)


def in_pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in pieces; only the pieces that hold them are read."""
    lead = F.floor(start / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, lead + 1, F.floor(end / PIECE).cast("int") - lead + 1), "")
    return F.substr(near, start - lead * PIECE + 1, end - start)
