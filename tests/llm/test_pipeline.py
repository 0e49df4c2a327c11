"""The corpus pipeline, stage by stage, against plain Python over the same rows."""

import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazeframe.llm import secrets, toxicity
from test_dedup import plain_groups, plain_leaks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with odd rows, near copies, leaks and secrets added to documents."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(9)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(5000, None, "en", "x", None), (5001, "", None, "x", 0), (5002, "  \n", "en", None, 3), (None, "a row without id", "en", "x", 16), (5003, "same row", "en", "x", 8), (5003, "same row", "en", "x", 8)]
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    for i in range(12):
        w = list(base)
        for _ in range(i):
            w[rng.randrange(len(w))] = f"v{i}x{rng.randint(0, 99)}"
        rows.append((6000 + i, " ".join(w), "en", "x", None))
    rows += [(7000 + i, f"intro {i} {t} end {i}", "en", "x", None) for i, (_, t) in enumerate(bench[:10])]
    rows += [(8000 + i, f"note {i} password = hunter{i}hunter2 and AKIA{'ABCDEFGH' * 2}{i:02d} tail {rng.random()}", "en", "x", 50) for i in range(10)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionAll(spark.createDataFrame(rows, SCHEMA))
    docs.write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return path


def key(row):
    return str(tuple(row))


def test_stages_match_plain_python(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "decontamination", "secrets", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    if model.trained:
        model.prepare()
    rows = [r for r in docs.collect() if model.score(r["text"])[0] < 0.5]
    assert sorted(map(key, kept.collect())) == sorted(map(key, rows))

    once = stages["ngram_jaccard"](spark, kept, folder)
    groups = plain_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    first, want = set(), []
    for r, (own, _, low) in zip(rows, groups, strict=True):
        if own is None or own == low and (own, r["text"]) not in first:
            first.add((own, r["text"]))
            want.append(r)
    assert len(want) < len(rows) - 5
    assert sorted(map(key, once.collect())) == sorted(map(key, want))

    clean = stages["decontamination"](spark, once, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = plain_leaks([(n, r["text"]) for n, r in enumerate(want)], items)
    found = {n for n, _ in leaks}
    rest = [r for n, r in enumerate(want) if n not in found]
    assert len(rest) <= len(want) - 10
    assert sorted(map(key, clean.collect())) == sorted(map(key, rest))

    redacted = stages["secrets"](spark, clean, folder)
    spans = {(r["doc_id"], r["n"]): r["spans"] for r in secrets.find_secrets(clean.withColumn("n", F.xxhash64("text"))).join(clean.select("doc_id", F.xxhash64("text").alias("n")), "doc_id").collect()}
    by_id = {}
    for (doc, _), text in spans.items():
        by_id.setdefault(doc, set()).add(text)
    texts = {r["doc_id"]: r["text"] for r in redacted.collect()}
    assert len(texts) == len({r["doc_id"] for r in rest})
    for r in rest:
        if r["doc_id"] is None or r["text"] is None or len(by_id.get(r["doc_id"], ())) != 1:
            continue
        out, at = [], 0
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in next(iter(by_id[r["doc_id"]])).split(",") if x):
            if s >= at:
                out += [r["text"][at:s], "[SECRET]"]
            at = max(at, e)
        assert texts[r["doc_id"]] == "".join(out) + r["text"][at:]
    assert "[SECRET]" in texts[8000] and not re.search("AKIA[A-Z]{16}", texts[8000])

    done = stages["bpe"](spark, redacted, folder)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want_ids = sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in redacted.collect())
    got = done.collect()
    assert sorted((str(r["doc_id"]), list(r["token_ids"])) for r in got) == want_ids
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, got))


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
