"""Substring dedup, Jaccard join, decontamination, sharding and embeddings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeframe.llm import common, decontaminate, embedding_dedup, jaccard_join, sharding, substring_dedup


def sha(words):
    return hashlib.sha256(b" ".join(words)).hexdigest()


def plain_removal(rows, width):
    """rows: (doc_id, text). Windows whose words start earlier, by (doc_id, start)."""
    first, out = {}, []
    words = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for (key, _), (i, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone[s : s + width] = [True] * width
        out.append((key, len(w), sum(gone), sha([x for x, g in zip(w, gone, strict=True) if not g])))
    return out


def check_removal(df, width=20):
    got = sorted(map(tuple, substring_dedup.remove_repeats(df, width).collect()), key=str)
    assert got == sorted(plain_removal([tuple(r) for r in df.select("doc_id", "text").collect()], width), key=str)


def test_cover_meets_at_every_shift():
    for d in range(substring_dedup.PERIOD):
        assert any((a - b) % substring_dedup.PERIOD == d for a in substring_dedup.COVER for b in substring_dedup.COVER)


def test_removal_matches_brute_force(spark, documents, odd):
    check_removal(documents)
    check_removal(odd)


def test_removal_of_shared_passages(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (19, 20, 21, 35, 80)]
    rows = []
    for i in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            t += p + [rng.choice(words) for _ in range(rng.randint(0, 9))]
        rows.append((i * 7, " ".join(t)))
    rows += [(rows[5][0], rows[5][1]), (14, "a " * 100), (None, rows[9][1])]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string"))


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a b " * 20), (2, "x " + "a b " * 12 + " y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, output=True).collect()}
    assert got[2]["kept_text"] == "x y" and got[1]["n_removed"] == 38


def plain_groups(rows, width, percent):
    sets = []
    for _, t in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [(key, len(sets[i]), low.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def near_copies(rng, n_groups, lone):
    rows, key = [], 0
    for g in range(n_groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 8, 30, 120]))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 10**6)}"
            rows.append((key, " ".join(t)))
            key += 1
    common = " ".join(f"c{i}" for i in range(25))
    rows += [(key + i, common + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 9)))) for i in range(lone)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_groups_match_brute_force(spark, documents, odd, width, percent):
    made = spark.createDataFrame(near_copies(random.Random(width), 40, 60) + [(99999, "A b C d"), (99998, "a B c D"), (99997, "a b c"), (99996, "a b c")], "doc_id long, text string")
    for df in (made, odd) + ((documents,) if width == 4 else ()):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = sorted(map(tuple, jaccard_join.group_documents(df, width, percent).collect()), key=str)
        assert got == sorted(plain_groups(rows, width, percent), key=str)


def test_hot_buckets_meet_their_pivot_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    rows = near_copies(random.Random(11), 12, 20) + [(90_000 + i, " ".join(f"h{j}" for j in range(60)) + f" end{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.group_documents(df, 4, 85).collect()), key=str)
    assert got == sorted(plain_groups(rows, 4, 85), key=str)


def test_components_of_long_paths(spark):
    n = 1000
    bad = [0, *range(n - 1, 0, -1)]
    mixed = list(range(n, 2 * n))
    random.Random(8).shuffle(mixed)
    edges = [*zip(bad, bad[1:]), *zip(mixed, mixed[1:]), *((2 * n, 2 * n + i) for i in range(2, 40)), *((3 * n, 2 * n + 50 + i) for i in range(40)), (5000, 5000), (6001, 6000), (6000, 6001)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {x: 0 for x in bad} | {x: n for x in mixed} | {x: 2 * n for x in (2 * n, *range(2 * n + 2, 2 * n + 40))}
    assert got == want | {x: 2 * n + 50 for x in (3 * n, *range(2 * n + 50, 2 * n + 90))} | {6000: 6000, 6001: 6000}


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words stand here now"), (2, "other words stand here now"), (4, None), (None, "a b c d e f g")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(got.collect(), key=str) == sorted([(1, "a b c d e f g"), (2, "other words stand here now"), (4, None), (None, "a b c d e f g")], key=str)


def test_repeated_ids_with_other_texts(spark):
    rows = [(3, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words here now ok fine then"), (6, "Other words here now ok fine then"), (None, "only the null id has these words"), (None, "a b c d e f g"), (7, None), (7, "seven words stand in this one row"), (7, "seven words stand in this one row"), (5, "")]
    rng = random.Random(21)
    made = [(i // 3, t) for i, (_, t) in enumerate(near_copies(rng, 25, 30))]
    own = rows + made
    got = sorted(map(tuple, jaccard_join.group_documents(spark.createDataFrame(own, "doc_id long, text string"), 4, 85).collect()), key=str)
    assert got == sorted(plain_groups(own, 4, 85), key=str)
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(got.collect(), key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6], rows[7], rows[9]], key=str)


def plain_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)


def plain_leaks(docs, items, threshold=0.8, width=5):
    out = {}
    for key, text in docs:
        w = plain_words(text)
        for item, t in items:
            own = plain_words(t)
            k = min(width, len(own))
            if not own or not w:
                continue
            grams = lambda x, k=k: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
            want, best = grams(own), 0.0
            for s in range(max(1, len(w) - len(own) + 1)):
                g = grams(w[s : s + len(own)])
                best = max(best, sum((g & want).values()) / max(1, sum((g | want).values())))
            if best >= threshold:
                out[key, item] = best
    return out


def test_leaks_match_brute_force(spark, documents, odd):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(4)
    made = []
    for i in range(80):
        w = plain_words(items[i % 40][1])
        if i % 3 == 0:
            w = w[: max(1, len(w) * 9 // 10)]
        if i % 3 == 1:
            w[rng.randrange(len(w))] = "changed"
        made.append((10_000 + i, "before this " + " ".join(w).upper() + " and after"))
    items += [(1000, "two words"), (1001, None), (1002, "!!!"), (1003, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents.select("doc_id", "text").union(odd.where("doc_id is not null").selectExpr("doc_id + 5000", "text")).union(spark.createDataFrame(made, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_contamination(docs, bench).collect()}
    want = plain_leaks([tuple(r) for r in docs.collect()], items)
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want)  # the radius is wide, not infinite
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert {k for k, v in want.items() if v == 1.0} <= got.keys()
    kept = {r[0] for r in decontaminate.drop_contaminated(docs, bench, block_items=20).select("doc_id").collect()}
    assert kept == {r[0] for r in docs.collect()} - {d for d, _ in got}


def test_hamming_blocks_find_all_in_radius():
    rng = np.random.default_rng(5)
    items = decontaminate.Items([1], ["a b c d e f g"], 5)
    base = items.by_length[7]["prints"][0]
    flips = [sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in range(0, 30) for _ in range(20)]
    prints = np.array([int(base) ^ f for f in flips], np.uint64)
    got = set(items.candidates(7, prints)[0].tolist())
    assert got == {i for i, f in enumerate(flips) if bin(f).count("1") <= decontaminate.RADIUS}


def test_shards(spark, documents, odd):
    import zlib

    for df in (documents, odd):
        texts = {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}
        got = sharding.shard_documents(df, [1.0] * 16, [1.0] * 17).collect()
        assert len(got) == df.count()
        for r in got:
            data = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
            key = "null" if r["doc_id"] is None else str(r["doc_id"])
            score = [int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) for s in range(17)]
            assert r["shard"] == max(range(16), key=score.__getitem__)
            assert r["grown_shard"] in (r["shard"], 16) and r["grown_shard"] == max(range(17), key=score.__getitem__)
        for s in range(16):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))


def test_shard_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = dict(sharding.shard_documents(df, [1.0, 2.0, 0.0, 1.0], [1.0, 2.0, 0.0, 1.0, 1.0]).groupBy("shard").count().collect())
    assert set(got) == {0, 1, 3} and abs(got[1] / 20000 - 0.5) < 0.02


def plain_links(rows, threshold=0.93):
    out = {}
    good = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = {i: i for i, *_ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = Counter()
    for a, (i, v, g) in enumerate(good):
        for j, w, h in good[:a]:
            if g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    for i, *_ in rows:
        out[i] = (n[i], find(i), i == find(i))
    return out


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(12):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.12).tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + i, rng.standard_normal(16).tolist(), 1) for i in range(200)]
    same = rows[0][1]
    rows += [(len(rows) + i, same, 0) for i in range(30)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0], [float("inf")] * 16]
    rows += [(len(rows) + i, v, 0) for i, v in enumerate(odd)] + [(100_000, same, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r[0]: tuple(r[1:]) for r in embedding_dedup.near_duplicates(df).collect()}
    want = plain_links(rows)
    assert got.keys() == want.keys()
    links, found = sum(v[0] for v in want.values()), sum(min(got[k][0], v[0]) for k, v in want.items())
    assert all(got[k][0] <= v[0] for k, v in want.items()) and found >= 0.9 * links
    assert sum(got[k][1] == v[1] for k, v in want.items()) >= 0.95 * len(want)


def test_vectors_without_an_id_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0, 7), (None, [1.0, 0.01], 0, 7), (3, [1.0, 0.02], 0, 7), (None, [0.0, 1.0], 0, 7), (None, [0.01, 1.0], 0, 7), (3, [1.0, 0.02], 0, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id long").withColumn("id", F.lit("x")).withColumn("k", F.lit(1)).withColumn("grp", F.lit(None).cast("string"))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (None, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_vector_ids_that_would_pass_for_none_are_an_error(spark):
    for high in (1 << 62, (1 << 63) - 1):
        df = spark.createDataFrame([(1, [1.0, 0.0], 0), (high, [1.0, 0.1], 0)], "vec_id long, embedding array<double>, label int")
        with pytest.raises(Exception, match=f"below 2\\^62: {high}"):
            embedding_dedup.near_duplicates(df).collect()


def test_leaks_with_repeated_items_and_clashing_columns(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = spark.createDataFrame([(1, "so " + text + " today", 9), (1, "so " + text + " today", 9), (None, text, 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, text, 1), (7, text, 2), (None, text, 3), (8, None, 4)], "item_id long, text string, doc_id long")
    got = sorted(decontaminate.find_contamination(docs, items).select("doc_id", "item_id", "similarity", "start_word").collect(), key=str)
    want = [(d, i, 1.0, s) for d, s in ((1, 1), (1, 1), (None, 0)) for i in (7, 7, None)]
    assert [tuple(r) for r in got] == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_shards_of_repeated_and_missing_ids(spark):
    rows = [(5, "a", 1)] * 40 + [(None, None, 1)] * 30 + [(i, "é" * i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = sharding.shard_documents(df, [1.0] * 4, [1.0] * 5).collect()
    assert len(got) == len(rows)
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    for key in (5, None):
        assert len({(r["shard"], r["grown_shard"]) for r in got if r["doc_id"] == key}) == 1
    assert {r["size"] for r in got if r["doc_id"] is None} == {1}


def test_vectors_that_the_graph_missed_are_found(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((350, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, x + rng.standard_normal(x.shape) * 0.25]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = common.staged(embedding_dedup.near_duplicates(df, k=128, tables=1, rounds=0, target=1.0))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == plain_links(rows)
    assert embedding_dedup.recall(df, found) == 1.0
    assert embedding_dedup.recall(df, found.withColumn("n_links", F.lit(0)), every=1) == 0.0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs).collect() == []
    assert jaccard_join.group_documents(docs).collect() == []
    assert decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert sharding.shard_documents(docs, [1.0] * 3).collect() == []
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_removal_without_repeats_and_with_outlier_ids(spark):
    rows = [(i if i else 1 << 60, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_removal(df)
    check_removal(df.unionAll(df.where("doc_id < 5").selectExpr("doc_id + 1000", "text")))
    sizes = [r["count"] for r in substring_dedup.with_part(df, "doc_id", 4).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 15
