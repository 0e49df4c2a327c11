"""Toxicity by a linear-chain conditional random field.

Training reads a bounded sample of labelled rows: at most `train_rows` rows whose crc32(doc_id as text) mod 5 is not
0 and whose texts have at most `train_chars` characters, those with the smallest hashes. From it come
1. features: words and word beginnings (3 to 8 letters) whose document counts tell labels 0 and 1 apart,
2. token labels: tokens of label-1 rows that hold a telling feature are toxic, all other tokens are not,
3. a two-state CRF (state weights per feature, bias, transitions), fitted by gradient ascent on the likelihood of
   blocks of 64 tokens (at most 2 * most_blocks, evenly spaced; at most most_features features), and
4. a logistic layer from sums of forward-backward marginals to the row's label.

Scoring is one narrow pass over whole texts. Tokens without a known feature share one potential, so forward-backward
steps over a run of them by a precomputed matrix power; marginals at all other tokens are exact. Tokens are those of the
text as it stands, each lowered by itself, so a letter whose lower case is longer moves no offset. Offsets of tokens
with a marginal of 0.5 or more are returned as spans (code points, end exclusive).

Scores use the text only. Null and empty texts get the logistic layer's score of no evidence. With no labelled rows,
or with one label only, the score is the share of label 1 (0.0 if there are none). Repeated rows get equal scores;
a label row that repeats counts once if it agrees, and rows with two different labels are left out of training.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

TOKEN = re.compile(r"[^\W\d_]+")
SPAN, BLOCK, POWERS, PART = range(3, 9), 64, 256, 256


def features(token: str) -> list[str]:
    return [f"={token}", *(token[:k] for k in SPAN if len(token) > k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # of the toxic state
    bias: float = -4.0
    transitions: tuple = (0.0, 0.0, 0.0, 0.0)  # clean-clean, clean-toxic, toxic-clean, toxic-toxic
    layer: tuple = (0.0,) * 5
    prior: float = 0.0
    trained: bool = False

    def prepare(self) -> None:
        t = np.exp(np.array(self.transitions).reshape(2, 2))
        step = t * np.array([1.0, np.exp(self.bias)])[None, :]
        self.step, powers = step, [np.eye(2)]
        for _ in range(POWERS):
            p = powers[-1] @ step
            powers.append(p / p.max())
        self.powers = [tuple(map(float, p.ravel())) for p in powers]
        self.trans = tuple(map(float, t.ravel()))
        self.cache: dict[str, float] = {}

    def gap(self, n: int) -> tuple:
        """The steps over n tokens without a feature, as one matrix up to a factor."""
        if n <= POWERS:
            return self.powers[n]
        a, b = (np.array(self.gap(k)).reshape(2, 2) for k in (n // 2, n - n // 2))
        m = a @ b
        return tuple(map(float, (m / m.max()).ravel()))

    def weight(self, token: str) -> float:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            get = self.weights.get
            got = self.cache[token] = sum(get(f, 0.0) for f in features(token.lower()))
        return got

    def marginals(self, at: list[int], w: list[float], n: int) -> list[float]:
        """P(toxic) at the places `at` of n tokens, whose extra potentials are w."""
        e0 = np.exp(self.bias)
        out, forward = [], []
        a, b, last = 1.0, e0, 0  # state weights at token 0 before its own extra potential
        p = self.powers
        for place, extra in zip(at, w, strict=True):
            m = p[place - last] if place - last <= POWERS else self.gap(place - last)
            a, b = a * m[0] + b * m[2], a * m[1] + b * m[3]
            b *= np.exp(extra)
            s = a + b
            a, b = a / s, b / s
            forward.append((a, b))
            last = place
        c, d, last = 1.0, 1.0, n - 1
        for (a, b), place, extra in zip(reversed(forward), reversed(at), reversed(w), strict=True):
            m = p[last - place] if last - place <= POWERS else self.gap(last - place)
            c, d = m[0] * c + m[1] * d, m[2] * c + m[3] * d
            s = c + d
            c, d = c / s, d / s
            out.append(b * d / (a * c + b * d))
            d *= np.exp(extra)
            last = place
        return out[::-1]

    def evidence(self, text: str) -> tuple[np.ndarray, list[int], list[float]]:
        tokens = TOKEN.findall(text)
        get, slow = self.cache.get, self.weight
        w = [get(t) if t in self.cache else slow(t) for t in tokens]
        at = [i for i, x in enumerate(w) if x]
        p = self.marginals(at, [w[i] for i in at], len(tokens)) if at else []
        total, most = sum(p), max(p, default=0.0)
        strong = sum(x >= 0.5 for x in p)
        return np.array([1.0, np.log1p(total), most, np.log1p(strong), total / (5 + len(tokens)) * 20]), at, p

    def score(self, text: str | None) -> tuple[float, str]:
        if not self.trained:
            return self.prior, ""
        text = text or ""
        x, at, p = self.evidence(text)
        value = float(1 / (1 + np.exp(-np.clip(x @ np.array(self.layer), -30, 30))))
        spans = ""
        if any(v >= 0.5 for v in p):
            tagged = {i for i, v in zip(at, p, strict=True) if v >= 0.5}
            spans = ",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(TOKEN.finditer(text)) if i in tagged)
        return value, spans


def telling(texts: list[str], labels: np.ndarray, most: int = 3000) -> dict[str, float]:
    """At most `most` features, by share and count, and their share of label 1 among the rows that hold them: those far
    above the base rate."""
    ids: dict[str, int] = {}
    own = [np.unique([ids.setdefault(t.lower(), len(ids)) for t in TOKEN.findall(text)]).astype(np.int64) for text in texts]
    # a feature must occur in rows of label 1, so only their tokens name any; the others' are looked up
    marked = np.zeros(len(ids), bool)
    for x, y in zip(own, labels, strict=True):
        marked[x] |= bool(y)
    names: dict[str, int] = {}
    for t, m in zip(ids, marked.tolist(), strict=True):
        if m:
            for f in features(t):
                names.setdefault(f, len(names))
    lists = [[names[f] for f in features(t) if f in names] or () for t in ids]
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.array([f for x in lists for f in x], np.int64)
    first = np.cumsum(size) - size
    width = max(1, len(names))
    every, ones = np.zeros(len(names), np.int64), np.zeros(len(names))
    for lo in range(0, len(own), PART):  # a part of the rows at a time bounds the arrays
        some = own[lo : lo + PART]
        row, token = np.repeat(np.arange(lo, lo + len(some)), [len(x) for x in some]), np.concatenate([np.zeros(0, np.int64), *some])
        many = size[token]
        after = np.cumsum(many)
        held = flat[np.repeat(first[token] - (after - many), many) + np.arange(int(many.sum()))]
        both = np.unique(np.repeat(row, many) * width + held)
        row, held = both // width, both % width
        every += np.bincount(held, minlength=len(names))
        ones += np.bincount(held, weights=labels[row], minlength=len(names))
    base = labels.mean()
    share = (ones + base) / (every + 1)
    z = (ones - every * base) / np.sqrt(every * base * (1 - base) + 1e-9)
    good = (ones >= 4) & (share > 0.5) & (z > 5)
    found = [(-share[i] * min(every[i], 30), f, float(share[i])) for f, i in names.items() if good[i]]
    return {f: x for _, f, x in sorted(found)[:most]}


def fit_chain(blocks: list[list[list[int]]], tags: list[np.ndarray], n_features: int, times: list[int] | None = None, rounds: int = 150, rate: float = 0.5) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and transitions that maximise the conditional likelihood of the blocks, each counted
    `times` times (Adam, L2)."""
    size, n = max(map(len, blocks)), len(blocks)
    times = np.ones(n) if times is None else np.array(times, float)
    mask = np.arange(size)[:, None] < np.array([len(b) for b in blocks])[None, :]  # [place][block]
    gold = np.zeros((size, n), np.int64)
    cell, feats = [], []
    for i, (block, tag) in enumerate(zip(blocks, tags, strict=True)):
        gold[: len(block), i] = tag
        for j, own in enumerate(block):
            cell += [j * n + i] * len(own)
            feats += own
    cell, feats = np.array(cell, np.int64), np.array(feats, np.int64)
    theta = np.zeros(n_features + 5)
    theta[n_features] = -3.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    both = np.where(mask[1:], times, 0.0)  # weight of each pair of neighbours
    pair = np.bincount((gold[:-1] * 2 + gold[1:]).ravel(), both.ravel(), 4)
    a0, a1, b0, b1 = (np.ones((size, n)) for _ in range(4))
    for k in range(1, rounds + 1):
        unary = np.full((size, n), theta[n_features])
        if len(feats):
            unary += np.bincount(cell, theta[feats], size * n).reshape(unary.shape)
        e = np.exp(np.clip(unary, -30, 30))
        t00, t01, t10, t11 = np.exp(theta[n_features + 1 :])
        a0[0], a1[0] = 1 / (1 + e[0]), e[0] / (1 + e[0])
        for j in range(1, size):
            x0, x1 = a0[j - 1] * t00 + a1[j - 1] * t10, (a0[j - 1] * t01 + a1[j - 1] * t11) * e[j]
            total = x0 + x1
            a0[j], a1[j] = x0 / total, x1 / total
        b0[-1] = b1[-1] = 1.0
        for j in range(size - 2, -1, -1):
            y1 = e[j + 1] * b1[j + 1]
            x0, x1 = t00 * b0[j + 1] + t01 * y1, t10 * b0[j + 1] + t11 * y1
            total = x0 + x1
            b0[j], b1[j] = np.where(mask[j + 1], x0 / total, 1.0), np.where(mask[j + 1], x1 / total, 1.0)
        gap = np.where(mask, gold - a1 * b1 / (a0 * b0 + a1 * b1), 0.0) * times
        y1 = e[1:] * b1[1:]
        joint = np.stack([a0[:-1] * t00 * b0[1:], a0[:-1] * t01 * y1, a1[:-1] * t10 * b0[1:], a1[:-1] * t11 * y1])
        joint *= both / joint.sum(0)
        grad = np.zeros_like(theta)
        if len(feats):
            grad[:n_features] = np.bincount(feats, gap.ravel()[cell], n_features)
        grad[n_features] = gap.sum()
        grad[n_features + 1 :] = pair - joint.sum((1, 2))
        grad = grad / times.sum() - 1e-3 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :]


def spaced(blocks: list, most: int) -> list:
    """At most `most` of the blocks, evenly spaced over all."""
    return blocks if len(blocks) <= most else [blocks[i] for i in np.linspace(0, len(blocks) - 1, most).astype(int)]


def fit(rows: list[tuple[str, int]], most_features: int = 3000, most_blocks: int = 4000) -> Model:
    """The model of all rows. The chain is fitted on at most most_blocks blocks with a telling feature and as many
    without one, evenly spaced over the rows; features are at most most_features."""
    labels = np.array([y for _, y in rows])
    if not len(rows) or labels.min() == labels.max():
        return Model(prior=float(labels.mean()) if len(rows) else 0.0)
    texts = [t for t, _ in rows]
    share = telling(texts, labels, most_features)
    index = {f: i for i, f in enumerate(share)}
    blocks, plain = [], []
    held: dict[str, list[int]] = {}
    none: list[int] = []  # shared by the many tokens without a feature
    for text, y in zip(texts, labels, strict=True):
        known = []
        for t in TOKEN.findall(text):
            if (own := held.get(t)) is None:
                own = held[t] = [index[f] for f in features(t.lower()) if f in index] or none
            known.append(own)
        for lo in range(0, len(known), BLOCK):
            part = known[lo : lo + BLOCK]
            (blocks if any(part) else plain).append((part, y))
    held.clear()
    model = Model(trained=True, prior=float(labels.mean()))
    if blocks:
        blocks = spaced(blocks, most_blocks)
        used = blocks + spaced(plain, len(blocks))
        times = Counter((tuple(map(tuple, part)), bool(y)) for part, y in used)  # copies count as often as they occur
        tags = [np.array([int(bool(y and f)) for f in part]) for part, y in times]
        w, bias, transitions = fit_chain([part for part, _ in times], tags, len(index), list(times.values()))
        model.weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}
        model.bias, model.transitions = bias, tuple(map(float, transitions))
    model.prepare()
    x = np.array([model.evidence(t)[0] for t in texts])
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps, ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(hess, x.T @ (labels - p) - 0.1 * beta)
    model.layer = tuple(map(float, beta))
    model.cache = {}  # tasks fill their own
    return model


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, train_rows: int = 6000, train_chars: int = 20000, most_features: int = 3000, most_blocks: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample: train_rows rows of at most train_chars characters; see fit() for the other bounds."""
    agreed = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z")
    sample = agreed.orderBy(F.xxhash64(id_col), id_col).limit(train_rows).select(id_col, "_y")
    rows = documents.select(id_col, F.col(text_col).alias("_t")).where(F.length("_t") <= train_chars).join(F.broadcast(sample), id_col)  # at most train_rows rows
    got = rows.orderBy(F.xxhash64(id_col), id_col, "_t").limit(train_rows).collect()
    return fit([(r["_t"], int(r["_y"])) for r in got], most_features, most_blocks)


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    kind = dict(documents.dtypes)[id_col]

    def run(batches):
        if model.trained:
            model.prepare()
        for c in chunks(batches, 1):
            out = [model.score(t) for t in c.column(1).to_pylist()]
            held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in c.column(0).to_pylist()]
            score = [s for s, _ in out]
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(held), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([s for _, s in out])], names=[id_col, "held_out", "score", "predicted", "spans"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, spans string")


def drop_toxic(documents: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Documents whose score is below the threshold, all columns unchanged; one narrow pass. A model that saw one label
    only, or none, gives all documents the same score, so then all go or all stay."""
    at = documents.columns.index(text_col)

    def run(batches):
        if model.trained:
            model.prepare()
        for c in chunks(batches, at):
            keep = [model.score(t)[0] < threshold for t in c.column(at).to_pylist()]
            yield c.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
