"""PII and secret patterns against a plain-Python reading of the contract."""

import hashlib
import re

from hazeframe.llm import pii, secrets


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_pii(text):
    text = text or ""
    only = lambda v: re.sub("[^0-9]", "", v)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p[-9:]) <= 255 and int(p) <= 255 if len(p) < 4000 else False for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(only(v)) <= 19 and luhn(only(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(only(v)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in tests.items()}


def plain_secrets(text):
    text = text or ""
    tests = [
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m)]
    return sorted(found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pii_base(spark, documents, odd):
    for df in (odd, documents):
        texts = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
        got = pii.find_pii(df).collect()
        assert len(got) == df.count()
        for r in got:
            want = plain_pii(texts[r["doc_id"]])
            assert [r[f"n_{k}"] for k in want] == [len(v) for v in want.values()], texts[r["doc_id"]]
            base = [f"{k}:{s}:{e}" for k, v in want.items() for s, e in v]
            assert r["base_sha256"] == sha(",".join(base))
            assert set(base) <= set(r["spans"].split(",")) | {""}


def test_pii_adds_spans(spark):
    rows = [(i, f"please mail jane{i} (at) corp{i} (dot) com today or phone 030 1234{i:03d}") for i in range(200)]
    rows += [(1000 + i, f"release 1.2.{i} has 1111111 rows") for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("address:" in got[i] for i in range(200)) > 190
    assert not any(got[1000 + i] for i in range(200))


def test_pii_em_finds_reliable_labelers():
    cells = {"n112222": 300, "n122222": 50, "n002222": 600, "n022222": 100, "n012222": 20, "n102222": 5}
    probability, rates = pii.fit(cells)
    assert probability["n112222"] > 0.9 > 0.1 > probability["n002222"]
    assert rates["strict"][0] > 0.8


def test_secrets_base(spark, documents, odd):
    for df in (odd, documents):
        texts = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
        got = secrets.find_secrets(df).collect()
        assert len(got) == df.count()
        for r in got:
            want = plain_secrets(texts[r["doc_id"]])
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w[3] == k for w in want) for k in ("assign", "access", "hex")], texts[r["doc_id"]]
            base = [f"{k}:{s}:{e}" for s, _, e, k in want]
            assert r["base_sha256"] == sha(",".join(base))
            assert set(base) <= set(r["spans"].split(",")) | {""}


def test_secrets_markov_separates(spark):
    import base64

    key = lambda i: base64.b64encode(hashlib.sha256(b"k%d" % i).digest())[:40].decode()
    words = ["some_ordinary_identifier", "anotherPlainIdentifier", "international-relationship", "incomprehensibilities", "characteristically"]
    rows = [(i, f"see {key(i)} here") for i in range(100)] + [(1000 + i, f"the {words[i % 5]} and {words[(i + 1) % 5]}") for i in range(100)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("markov:" in got[i] for i in range(100)) > 95
    assert not any(got[1000 + i] for i in range(100))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty).collect() == [] and secrets.find_secrets(empty).collect() == []


def test_texts_with_thousands_of_matches(spark):
    """Time must not grow with the square of the matches of one text; all places stay right."""
    import time

    rng = __import__("random").Random(4)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    dense = " é ".join(rng.choice([hexes(32), hexes(40), f"token={hexes(9)}", "AKIA" + "Z" * 14, "Zx9Qw3Rt7Yp1Lk5Mn8Bv2Cc4" + hexes(4).upper(), "plain words here 😀"]) for _ in range(5000))
    mails = " ü ".join(rng.choice([f"a{k}@b.co", f"10.0.{k % 300}.1", "+49 30 1234567", "4111 1111 1111 1111", f"jane{k} (at) corp (dot) com", "Dr. Jane Doe", "phone 030 123 4567 89"]) for k in range(5000))
    rows = [(1, dense), (2, mails), (3, "nothing"), (4, "1" * 30000 + " " + "ab" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.find_secrets(df).collect()}
    for i, text in rows:
        want = plain_secrets(text)
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in want))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df, margin=1e9).collect()}
    for i, text in rows:
        out, at = [], 0
        for s, _, e, _ in plain_secrets(text):
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        assert clean[i] == "".join([*out, text[at:]])
    found = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    for i, text in rows:
        assert found[i]["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, v in plain_pii(text).items() for s, e in v))
    assert time.time() - began < 120


def test_candidates_clear_of_base(spark):
    rng = __import__("random").Random(9)
    from hazeframe.llm import spans

    def some():
        at, out = 0, []
        for _ in range(rng.randint(0, 40)):
            at += rng.randint(0, 4)
            out.append((at, at + rng.randint(1, 5), "v"))
            at = out[-1][1]
        return out

    cases = [(i, some(), some() + some()) for i in range(150)]
    df = spark.createDataFrame(cases, f"i int, a {spans.SPAN}, b {spans.SPAN}")
    for i, got in df.select("i", spans.clear_of(df["a"], df["b"])).collect():
        _, a, b = cases[i]
        assert [tuple(x) for x in got] == [x for x in a if not any(t[0] < x[1] and x[0] < t[1] for t in b)]
