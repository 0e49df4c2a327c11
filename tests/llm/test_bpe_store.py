"""Tokens against the tokenizers library, the store by exact round trip."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazeframe.llm import bpe, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def test_forced_pairs(codec):
    assert codec.forced_pairs([b"ab", b"bc"]) == {(a, b) for a in range(256) for b in range(256)} - {(97, 98), (98, 99)}
    assert (ord("a"), ord(" ")) in codec.never


def test_fragments_encode_like_the_whole(codec):
    rng = random.Random(7)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "é", "à", "\xa0", ".", ",", "'s", "'", "re", "1", "²", "…", "ö", "×", "\t", "\r\n", "日", "<|endoftext|>", "—", "\x1c", "'ll", "😀"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = codec.library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert codec.decode(got) == codec.library.decode(want, skip_special_tokens=False)


def test_batches_encode_like_the_library(codec):
    rng = random.Random(8)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "é", "\xa0", ".", ",", "'s", "1", "²", "×", "\t", "\r\n", "日", "か", "한", "я", "<|endoftext|>", "😀", "\u2003", "\u3000", "\x85", "\x0b", "\u0301"]
    for _ in range(60):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(100)]
        want = [codec.library.encode(t or "", add_special_tokens=False).ids for t in texts]
        ids, ends = codec.encode_all(pa.array(texts, pa.string()))
        assert [ids[s:e].tolist() for s, e in zip([0, *ends[:-1]], ends, strict=True)] == want
        assert [b.decode() for b in codec.decode_all(ids, ends)] == [codec.library.decode(w, skip_special_tokens=False) for w in want]


def test_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 64)
    codec = bpe.Codec(PATH)
    for i in range(300):
        text = " ".join(f"w{i}x{j} {'long' * 20}{i}" for j in range(9))
        ids, ends = codec.encode_all(pa.array([text]))
        assert ids.tolist() == codec.library.encode(text, add_special_tokens=False).ids
    assert codec.strange < 8 * 64 + 20


def test_equal_hashes_change_no_result(monkeypatch):
    codec = bpe.Codec(PATH)
    texts = pa.array(["one two three", None, "", "drei vier fünf", "one", "\N{SNOWMAN} <s> x</s>"])
    want = [codec.library.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    monkeypatch.setattr(bpe, "mix", lambda x, *_: np.full(len(x), 77, np.uint64))
    assert codec.encode_all(texts)[0].tolist() != sum(want, [])  # all fragments have one hash
    ids, ends, backs = codec.round_trip(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert [b.decode() for b in backs] == [codec.library.decode(w, skip_special_tokens=False) for w in want]


def test_encode_decode_frame(spark, codec, documents, odd):
    for df in (documents, odd):
        texts = {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}
        rows = bpe.encode_decode(df, PATH).collect()
        assert len(rows) == df.count()
        for r in rows:
            ids = codec.library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_store_round_trip(spark, codec, documents, odd, tmp_path):
    for n, df in enumerate((documents, odd)):
        path = f"file://{tmp_path}/store{n}"
        token_store.write_store(df, path, PATH)
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        start, want = 0, []
        for key, text in rows:
            ids = codec.library.encode(text or "", add_special_tokens=False).ids + [2]
            want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = token_store.checked(spark, path).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
        whole = {r["start"]: r["token_ids"] for r in token_store.read_store(spark, path).collect()}
        assert all(zlib.crc32(np.array(whole[s], "<u4").tobytes()) == c for _, s, _, c in want)
        stored = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
        assert stored.count() == stored.select("digest").distinct().count()


def test_store_detects_damage(spark, documents, tmp_path):
    path = f"file://{tmp_path}/bad"
    token_store.write_store(documents.limit(20), path, PATH)
    broken = spark.read.parquet(f"{path}/objects").withColumn("ids", F.expr("case when kind = 'chunk' then concat(ids, X'0100') else ids end"))
    broken.write.partitionBy("kind").parquet(f"{path}/objects2")
    (tmp_path / "bad/objects").rename(tmp_path / "bad/old")
    (tmp_path / "bad/objects2").rename(tmp_path / "bad/objects")
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.checked(spark, path).collect()


def test_store_detects_a_lost_recipe_and_a_shifted_start(spark, documents, tmp_path):
    path = f"file://{tmp_path}/lost"
    token_store.write_store(documents.limit(50), path, PATH)
    whole = spark.read.parquet(f"{path}/recipes")
    others = (whole.where("start > 0"), whole.withColumn("start", F.col("start") + 1))
    for n, other in enumerate(others):
        other.write.parquet(f"{path}/recipes{n}")
    for n in range(len(others)):
        (tmp_path / "lost/recipes").rename(tmp_path / f"lost/old{n}")
        (tmp_path / f"lost/recipes{n}").rename(tmp_path / "lost/recipes")
        with pytest.raises(ValueError, match="do not match the manifest"):
            token_store.checked(spark, path)


def test_crc_of_joined_chunks():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50000, n).astype("<u4") for n in (1, 7, 1024, 3, 500)]
    joined = token_store.joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts], 1024)
    assert joined == zlib.crc32(np.concatenate(parts).tobytes())


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50000, 20000).astype("<u4")
    a = token_store.cuts(ids, np.array([20000]), 64, 1024)
    b = token_store.cuts(np.concatenate([ids[:5], ids]), np.array([20005]), 64, 1024)
    assert a[-1] == 20000 and len(a) > 150 and np.diff(a, prepend=0).max() <= 1024
    assert len(set((b - 5).tolist()) & set(a.tolist())) > 0.9 * len(a)


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(empty, PATH).collect() == []
    token_store.write_store(empty, f"file://{tmp_path}/e", PATH)
    assert token_store.checked(spark, f"file://{tmp_path}/e").collect() == []
