"""Line dedup, periodic runs and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeframe.llm import importance, line_dedup, periodic_runs

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# lines


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    held = {k: {i for i in v if i is not None} for k, v in held.items()}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_lines_match_plain_python(spark, documents, odd):
    for df in (documents, odd):
        same(line_dedup.drop_common_lines(df), plain_lines([tuple(r) for r in df.select("doc_id", "text").collect()]))


def test_lines_of_many_sorts(spark):
    rng = random.Random(5)
    long = [f"Das ist ein Satz Nummer {k} mit ÄÖÜ und einigen Wörtern mehr" for k in range(8)]
    rows = []
    for i in range(150):
        lines = [rng.choice(["", "  ", "short", f"only line of document {i} {'x' * 40}", "a" * 39, "A" * 40, *long]) for _ in range(rng.randint(0, 12))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", " \x0b", "\x0c"]) for x in lines]
        rows.append((rng.choice([i, i, i, 7, None]), "\n".join(lines)))
    rows += [(1000, long[0]), (1000, long[0]), (1001, "\n".join([long[0]] * 3)), (1002, "\n\n"), (1003, None), (1004, ""), (1004, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("x")).withColumn("place", F.lit(1))
    for chars, docs in ((40, 5), (1, 2), (40, 1), (0, 3)):
        same(line_dedup.drop_common_lines(df, chars, docs), plain_lines(rows, chars, docs))


def test_lines_case_and_edges_of_the_thresholds(spark):
    sharp, upper = "É" * 40, "é" * 40  # only A-Z are lowered
    rows = [(i, sharp if i % 2 else upper) for i in range(8)] + [(i, "b" * 39 + "\n" + "C" * 40) for i in range(10, 15)]
    same(line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")), plain_lines(rows))


def test_long_text_of_common_lines(spark):
    body = "\n".join(f"line number {k} of a text that others hold as well" for k in range(30000))
    rows = [(i, body) for i in range(5)]
    got = sorted(map(tuple, line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [r[2] for r in got] == [30000] * 4 + [0] and got[4][3] == sha(body) and got[0][3] == sha("")


def test_kept_text(spark):
    rows = [(i, f"own {i}\n{'shared ' * 8}\nend") for i in range(6)]
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), output=True).collect()}
    assert got[0] == "own 0\nend" and got[5] == rows[5][1]


# runs


def plain_runs(words, shortest=12):
    """All maximal stretches with their smallest period, by comparing every word with every later one."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in found.items())


def plain_row(key, text, plant, shortest=12):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if plant and key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words, shortest)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    best = (None,) * 4
    if found:
        s, e, p = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (s, e - s, p, 1000 * (e - s) // p)
    return (key, len(found), *best, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in sorted(found, key=lambda r: (r[0], r[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_small_alphabets():
    rng = random.Random(11)
    for shortest in (2, 4, 12):
        texts = [[rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(0, 60))] for _ in range(120)]
        texts += [["a"] * 50, list("abaab" * 8), list("ab" * 30 + "c" + "ab" * 30), [], ["x"], list("abcabcabcabc")]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        ids = np.array([ord(w) for t in texts for w in t])
        doc, s, e, p = periodic_runs.runs(ids, first, shortest)
        for d, t in enumerate(texts):
            at = doc == d
            assert list(zip(s[at].tolist(), e[at].tolist(), p[at].tolist(), strict=True)) == sorted(plain_runs(t, shortest), key=lambda r: (r[0], r[2])), t


def test_extensions_match_comparison():
    rng = np.random.default_rng(3)
    ids, doc = rng.integers(0, 3, 400), np.repeat([0, 1, 2, 3], 100)
    ids[120:180] = 1
    lce = periodic_runs.Extensions(ids, doc)
    i, j = rng.integers(0, 100, 500), rng.integers(0, 100, 500)
    base = 100 * rng.integers(0, 4, 500)
    i, j = (i + base)[i != j], (j + base)[i != j]
    for a, b, got in zip(i.tolist(), j.tolist(), lce.common(i, j).tolist(), strict=True):
        k = 0
        while max(a, b) + k < 100 * (a // 100 + 1) and ids[a + k] == ids[b + k]:
            k += 1
        assert got == k


@pytest.mark.parametrize("plant", [False, True])
def test_runs_match_plain_python(spark, documents, odd, plant):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect() if len((r[1] or "").split()) < 1500] + [tuple(r) for r in odd.select("doc_id", "text").collect()]
    rng = random.Random(2)
    for i in range(60):
        unit = [rng.choice(["red", "green", "blue", "Rot"]) for _ in range(rng.randint(1, 30))]
        rows.append((5000 + i, " \t".join(["start", *unit * rng.randint(1, 5), *unit[: rng.randint(0, len(unit))], "end"] * 2)))
    rows += [(5001, None), (5001, ""), (5002, "a " * 200), (5002, "a " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    same(periodic_runs.find_runs(df, plant=plant), [plain_row(k, t, plant) for k, t in rows])


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(40000)]
    text = " ".join(words + words + words[:500])
    got = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string"), output=True).collect()[0]
    assert [tuple(r) for r in got["runs"]] == [(0, 80500, 40000)] and got["collapsed"] == " ".join(words)


# importance


def plain_resample(docs, target, buckets=10000, seed=7, min_words=20, percent=25):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    def feats(w):
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = (Counter(f for _, text in rows for f in feats(words(text))) for rows in (docs, target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        w = words(text)
        f = feats(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resample_matches_plain_python(spark, documents, odd):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    target = [tuple(r) for r in bench.select("item_id", "text").collect()]
    extra = [(9000 + i // 2, "Some words here, 12 more ÄÖ words; they repeat_often " * 3) for i in range(12)]
    rows = [tuple(r) for df in (documents, odd) for r in df.select("doc_id", "text").collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    same(importance.resample(df, bench), plain_resample(rows, target))


def test_resample_prefers_the_target(spark):
    rows = [(i, "alpha beta gamma delta " * 8 if i % 2 else "one two three four " * 8) for i in range(400)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([("alpha beta gamma delta",)] * 50, "text string")).collect()
    drawn = [r["doc_id"] for r in got if r["rank"] is not None]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 90


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_trie_states_are_crcs(longest):
    import pyarrow as pa

    texts = ["a b a b", "A-b c", None, "", "née " * 3 + "x" * 3000, "b"]
    trie = importance.Trie(pa.array(texts), longest)
    want = Counter()
    for text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        want.update(zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    got = Counter()
    for state, count, _, _ in trie.levels:
        for c, n in zip(state.tolist(), count.tolist(), strict=True):
            got[c] += n
    assert got == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert line_dedup.drop_common_lines(empty).collect() == [] and periodic_runs.find_runs(empty).collect() == []
    assert importance.resample(empty, some).collect() == []
    same(importance.resample(some, empty), plain_resample([(1, "a b"), (2, None)], []))
