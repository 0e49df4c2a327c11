"""Secret scans; DataFrame functions only.

Fixed patterns find assignments to secret names, access keys and long hexadecimal strings; they always stay.
Further tokens are scored by two character Markov models, one of random strings and one of ordinary identifiers:
a token whose log-likelihood ratio per character exceeds `margin` is reported as kind markov.

The labelled samples: random = values the fixed patterns found plus Base64 of hashes; ordinary = words of letters
with single joins (snake, kebab or camel case) that no pattern touched. At most `samples` distinct tokens a class
are used, those with the smallest hashes; the transition counts, at most 2 * 96 * 96 rows, go to the driver and
return as an array constant. The corpus is read once: spans and tokens are written, without texts, and read again to
fit and to score (redact() reads the texts a second time instead). Null texts are empty; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .spans import between, clear_of, in_pieces, named, once, rendered, running, with_matches

KINDS = ("assign", "access", "hex")
ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = r"(?is)\A(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)\z"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{32,}+"
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}+"
SIDE = 96  # printable ASCII


def with_base(df: DataFrame, text: Column) -> DataFrame:
    df = with_matches(df, "assign", text, ASSIGN, text.rlike("[:=]"))
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["v"], ASSIGN_VALUE, 1)) >= 8))
    df = with_matches(df, "access", text, ACCESS, text.contains("AKIA"))
    df = df.withColumn("access", F.filter("access", lambda x: F.length(x["v"]) >= 16))
    return with_matches(df, "hex", text, HEX, text.rlike("[0-9a-f]{32}"))


def steps(token: Column) -> Column:
    """Cells prev * SIDE + next of a token's transitions."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - 32)
    return once(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * SIDE + b))


def smallest(tokens: DataFrame, samples: int) -> DataFrame:
    return tokens.orderBy(F.xxhash64("token"), "token").limit(samples).select("token")


def fit(found: DataFrame, samples: int) -> list[float]:
    """Log-likelihood ratio of each transition, random against ordinary, transitions smoothed by the next character's own rate."""
    spark = found.sparkSession
    values = F.concat(F.transform("assign", lambda x: F.regexp_extract(x["v"], ASSIGN_VALUE, 1)), F.transform("access", lambda x: x["v"]), F.transform("hex", lambda x: x["v"]))
    made = spark.range(samples // 4).select(F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "=", "").alias("token"))
    words = F.filter(F.transform("_tokens", lambda x: x["v"]), lambda v: v.rlike(r"\A[A-Za-z][a-z]*(?:[_-]?[A-Z]?[a-z]+)*+\z|\A[A-Z]+\z"))
    both = F.concat(F.transform(values, lambda v: F.struct(F.lit(1).alias("y"), v.alias("token"))), F.transform(words, lambda v: F.struct(F.lit(0).alias("y"), v.alias("token"))))
    known = staged(found.select(F.explode(both).alias("x")).select("x.*").where(F.col("token").rlike(r"\A[\x20-\x7e]{2,}\z")).distinct())
    random, ordinary = (smallest(known.where(F.col("y") == y), samples) for y in (1, 0))
    random = random.unionAll(made)
    rows = (
        random.select(F.lit(1).alias("y"), "token")
        .unionAll(ordinary.select(F.lit(0).alias("y"), "token"))
        .select("y", F.explode(steps(F.col("token"))).alias("cell"))
        .groupBy("y", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    n = {(r["y"], r["cell"]): r["n"] for r in rows}
    total: dict = {}
    single: dict = {}
    for (y, cell), k in n.items():
        total[y, cell // SIDE] = total.get((y, cell // SIDE), 0) + k
        single[y, cell % SIDE] = single.get((y, cell % SIDE), 0) + k
    every = [sum(k for (y, _), k in n.items() if y == c) for c in (0, 1)]
    alone = lambda y, c: (single.get((y, c), 0) + 0.05) / (every[y] + 0.05 * SIDE)
    rate = lambda y, c: (n.get((y, c), 0) + 5 * alone(y, c % SIDE)) / (total.get((y, c // SIDE), 0) + 5)
    return [math.log(rate(1, c) / rate(0, c)) for c in range(SIDE * SIDE)]


def score(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per transition."""
    return F.aggregate(steps(token), F.lit(0.0), lambda acc, c: acc + F.get(table, c)) / (F.length(token) - 1)


def with_spans(read: DataFrame, text: Column) -> DataFrame:
    """Rows with their matches by kind, all of them in _base, and in _tokens what the Markov models are asked about."""
    found = with_matches(with_base(read, text), "_tokens", text, TOKEN)
    found = found.withColumn("_base", F.array_sort(F.concat(*[named(F.col(k), k, i) for i, k in enumerate(KINDS)])))
    return found.withColumn("_tokens", clear_of(F.col("_tokens"), F.col("_base")))


def all_spans(table: Column, margin: float) -> Column:
    """Base spans and those that the Markov models add, in order."""
    hits = F.filter("_tokens", lambda x: x["v"].rlike("[A-Za-z]") & (score(x["v"], table) > margin))
    return F.array_sort(F.concat("_base", named(hits, "markov", len(KINDS))))


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 4000, margin: float = 0.5, output: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; with output also findings (structs with values)."""
    read = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = staged(with_spans(read, F.col("_text")).drop("_text"))
    every = all_spans(F.lit(fit(found, samples)), margin)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("_id").alias(id_col), *counts, F.sha2(rendered(F.col("_base")), 256).alias("base_sha256"), every.alias("_all")).select(
        id_col, *[f"n_{k}" for k in KINDS], "base_sha256", rendered(F.col("_all")).alias("spans"), *([F.col("_all").alias("findings")] if output else [])
    )


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", marker: str = "[SECRET]", samples: int = 4000, margin: float = 0.5) -> DataFrame:
    """Documents with every secret replaced by the marker, one for each run of overlapping spans.

    All columns stay; n_chars, where it exists, follows the text. Null texts stay null.
    """
    read = documents.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = with_spans(read, F.col("_text"))
    every = all_spans(F.lit(fit(found, samples)), margin)

    def step(state: Column, x: Column) -> Column:
        return F.struct(state["upto"].alias("before"), x["s"].alias("s"), F.greatest(state["upto"], x["e"]).alias("upto"))

    def cleaned(x: Column) -> Column:
        piece = lambda t: F.when(t["s"] >= t["before"], F.concat(between(x["pieces"], t["before"], t["s"]), F.lit(marker))).otherwise("")
        return F.concat(F.array_join(F.transform(x["states"], piece), ""), between(x["pieces"], F.element_at(x["states"], -1)["upto"], F.lit(2**31 - 1)))

    states = running(F.col("_every"), F.struct(F.lit(0).alias("before"), F.lit(0).alias("s"), F.lit(0).alias("upto")), step)
    walked = once(F.struct(in_pieces(F.col("_text")).alias("pieces"), states.alias("states")), cleaned)
    done = found.select("_row", "_text", every.alias("_every")).select("_row", F.when(F.size("_every") > 0, walked).otherwise(F.col("_row")[text_col]).alias("_clean"))
    columns = []
    for field in documents.schema.fields:
        own = F.col("_row")[field.name]
        if field.name == text_col:
            own = F.col("_clean")
        elif field.name == "n_chars":
            own = F.when(F.col("_row")[text_col] == F.col("_clean"), own).otherwise(F.length("_clean").cast(field.dataType))
            own = F.when(F.col("_clean").isNull(), F.col("_row")[field.name]).otherwise(own)
        columns.append(own.alias(field.name))
    return done.select(*columns)
