"""Personal data by weak supervision; DataFrame functions only.

Fixed patterns find e-mail addresses, IPv4 addresses, card and phone numbers; they always stay. Wider candidate
patterns propose more spans (at-sign words, spelled-out addresses, digit groups, titled names). Labelers of three
sorts vote on each candidate: patterns (is the strict form met, is the shape wrong), gazetteers (top-level domains,
card prefixes, dialling codes, titles) and context (trigger words just before). A labeler votes 1, 0 or abstains
(2). Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability; the soft
labels train a logistic span classifier over votes and shape, which decides on the candidates.

Only pattern counts reach the driver: at most 3^len(LABELERS) * shapes rows, whatever the corpus. Counting covers
all documents. Null texts are empty; an empty table gives no rows; repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .spans import between, clear_of, in_pieces, named, once, rendered, with_matches

KINDS = ("email", "ip", "card", "phone")
# Equal to the stated patterns; possessive quantifiers and the left edges only spare useless attempts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATES = {
    "address": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+)*+",
    "number": r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+(?![A-Za-z0-9])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\b\.?\x20[A-Z][a-z]{2,20}+(?:\x20[A-Z][a-z]{2,20}+)?",
}
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz"]
TRIGGERS = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|ssn|social security|passport|id number|address|name is)\b[^A-Za-z0-9]*\z"
CANDIDATE = "array<struct<s:int,e:int,v:string,kind:string,cell:string>>"
LABELERS = ("strict", "shape", "list", "context", "repeat", "embedded")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 0, F.substring(number, n - i, 1).cast("int")).otherwise((F.substring(number, n - i, 1).cast("int") * 2) % 10 + F.floor(F.substring(number, n - i, 1).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


def good_card(v: Column) -> Column:
    d = digits(v)
    return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)


def good_ip(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def good_phone(v: Column) -> Column:
    return F.length(digits(v)).between(9, 15)


def with_base(df: DataFrame, text: Column) -> DataFrame:
    """Adds email, ip, card, phone: the stated patterns' spans."""
    df = with_matches(df, "email", text, EMAIL, text.contains("@"))
    df = with_matches(df, "ip", text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
    df = df.withColumn("ip", F.filter("ip", lambda x: good_ip(x["v"])))
    df = with_matches(df, "card", text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"))
    df = df.withColumn("card", F.filter("card", lambda x: good_card(x["v"])))
    df = with_matches(df, "phone", text, PHONE, text.contains("+"))
    return df.withColumn("phone", F.filter("phone", lambda x: good_phone(x["v"])))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def votes(kind: str, v: Column, before: Column) -> list[Column]:
    """One vote per labeler, in the order of LABELERS."""
    d, compact = digits(v), F.regexp_replace(v, r"[\x20()\[\]]", "")
    never = F.lit(False)
    if kind == "address":
        plain = F.regexp_replace(F.regexp_replace(F.lower(compact), r"^(.*?)(?:@|at)", "$1@"), r"dot", ".")
        strict = vote(plain.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$"), ~plain.contains("."))
        shape = vote(plain.rlike(r"@[a-z0-9-]{2,}\."), F.length(plain) < 6)
        known = vote(F.substring_index(plain, ".", -1).isin(DOMAINS), ~plain.rlike(r"\.[a-z]{2,}$"))
        embedded = vote(never, ~plain.rlike("[a-z]"))
    elif kind == "number":
        n = F.length(d)
        strict = vote(F.when(n.between(13, 19), luhn(d)).otherwise(False), n.between(13, 19) | (n > 19))
        shape = vote(v.rlike(r"[0-9][\x20.-][0-9]|\)"), v.rlike(r"^[0-9]+$"))
        known = vote(d.rlike(r"^(?:4|5[1-5]|3[47]|6(?:011|5))") & n.between(15, 16), n.isin(7, 8, 20, 21, 22, 23, 24))
        embedded = vote(never, v.rlike(r"[0-9]\.[0-9]+\.[0-9]|^[0-9]{4}-[0-9]{2}-[0-9]{2}"))
    else:
        strict = vote(v.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]+\x20[A-Z][a-z]+$"), never)
        shape = vote(v.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"), never)
        known = vote(v.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b"), never)
        embedded = vote(never, before.rlike(r"[A-Za-z0-9]\z"))
    context = vote(before.rlike(TRIGGERS), never)
    repeat = vote(never, compact.rlike(r"(.)\1{5}"))
    return [strict, shape, known, context, repeat, embedded]


def proposed(kind: str, spans: Column, text: Column) -> Column:
    """The spans as candidates, each with its vote pattern."""

    def one(pieces: Column, x: Column) -> Column:
        return once(between(pieces, F.greatest(x["s"] - 24, F.lit(0)), x["s"]), lambda before: F.struct(x["s"], x["e"], x["v"], F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), *[c.cast("string") for c in votes(kind, x["v"], before)]).alias("cell")))

    return once(F.struct(in_pieces(text).alias("pieces"), spans.alias("spans")), lambda b: F.transform(b["spans"], lambda x: one(b["pieces"], x)))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def candidates(df: DataFrame, text: Column) -> DataFrame:
    """Adds cand: candidate spans with their kind and vote pattern, clear of base spans."""
    df = df.withColumn("_taken", F.concat(*[F.col(k) for k in KINDS]))
    out = []
    for kind, regex in CANDIDATES.items():
        guard = text.contains("@") | text.contains("at)") | text.contains("at]") if kind == "address" else None
        df = with_matches(df, f"_{kind}", text, regex, guard)
        df = df.withColumn(f"_{kind}", clear_of(F.col(f"_{kind}"), F.col("_taken")))
        out.append(F.when(F.size(f"_{kind}") > 0, proposed(kind, F.col(f"_{kind}"), text)).otherwise(F.array().cast(CANDIDATE)))
    return df.withColumn("cand", F.concat(*out)).drop("_taken", *(f"_{k}" for k in CANDIDATES))


def fit(cells: dict[str, int], rounds: int = 40) -> tuple[dict[str, float], dict]:
    """EM for two classes over vote-pattern counts, then a logistic classifier on the soft labels.

    Returns the classifier's probability for each cell, and the labelers' estimated reliabilities.
    """
    names = list(cells)
    start = lambda c: (c.count("1") + 0.5) / (c.count("1") + c.count("0") + 1.0)
    q = {c: start(c[1:]) for c in names}
    rates: dict = {}
    for _ in range(rounds):
        prior = {k: (1 + sum(cells[c] * q[c] for c in names if c[0] == k), 1 + sum(cells[c] * (1 - q[c]) for c in names if c[0] == k)) for k in {c[0] for c in names}}
        for j in range(len(LABELERS)):
            for y in (0, 1):
                w = {v: 2.0 if int(v) == y else 0.5 for v in "01"}  # labelers are taken to beat chance
                for c in names:
                    if c[1 + j] != "2":
                        w[c[1 + j]] += cells[c] * (q[c] if y else 1 - q[c])
                rates[j, y] = {v: w[v] / sum(w.values()) for v in "01"}
        for c in names:
            a, b = prior[c[0]]
            odds = math.log(a / b) + sum(math.log(rates[j, 1][v] / rates[j, 0][v]) for j, v in enumerate(c[1:]) if v != "2")
            q[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    features = {c: [f"kind={c[0]}", *(f"{j}={v}" for j, v in enumerate(c[1:]) if v != "2")] for c in names}
    weights: dict[str, float] = dict.fromkeys({f for fs in features.values() for f in fs}, 0.0)
    bias, total = 0.0, max(1, sum(cells.values()))
    prob = lambda c: 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[f] for f in features[c])))))
    for _ in range(300):
        gap = {c: cells[c] / total * (q[c] - prob(c)) for c in names}
        bias += 4.0 * sum(gap.values())
        for f in weights:
            weights[f] += 4.0 * (sum(g for c, g in gap.items() if f in features[c]) - 1e-4 * weights[f])
    return {c: prob(c) for c in names}, {LABELERS[j]: (rates[j, 1]["1"], rates[j, 0]["0"]) for j in range(len(LABELERS))} if names else {}


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, output: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with output also entities (structs with values)."""
    text = F.col("_text")
    read = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = staged(candidates(with_base(read, text), text).drop("_text"))  # spans only; the texts are read once
    cells = {r["cell"]: r["n"] for r in found.select(F.explode("cand.cell").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    probability, _ = fit(cells)
    chosen = sorted(c for c, p in probability.items() if p >= threshold)
    extra = F.filter("cand", lambda x: x["cell"].isin(chosen)) if chosen else F.slice("cand", 1, 0)
    base = F.concat(*[named(F.col(k), k, i) for i, k in enumerate(KINDS)])
    more = F.concat(*[named(of_kind(extra, k), k, len(KINDS) + i) for i, k in enumerate(CANDIDATES)])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return (
        found.select(F.col("_id").alias(id_col), *counts, base.alias("_base"), more.alias("_more"))
        .select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(rendered(F.col("_base")), 256).alias("base_sha256"), rendered(F.concat("_base", "_more")).alias("spans"), *([F.concat("_base", "_more").alias("entities")] if output else []))
    )
