"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. An item of L words is compared with
every window of L consecutive words of every document (a shorter document is one window). Windows that hold at least
one of the benchmark's word n-grams get a 64-bit SimHash; multi-index tables over eight 8-bit blocks return every
item of that length within the Hamming radius (radius 20 leaves a block with at most two differing bits); candidates
are verified by the exact similarity sum(min) / sum(max) of n-gram multiplicities. Windows without a shared n-gram
have similarity 0 and need no fingerprint.

Items shorter than `width` words count as one n-gram of their whole length and match only in full. The item table is
taken in blocks of at most `block_items` items and `block_bytes` bytes, each sent to the tasks as one bounded index;
documents are scanned once per block. Null or wordless texts and items match nothing; repeated documents and items
each give their own rows; an empty table on either side gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .words import LOWER, Words, mix, span_hash

BITS, BLOCKS, RADIUS = 64, 8, 20
SOLID = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
NEAR = np.array([[bin(a ^ b).count("1") <= RADIUS // BLOCKS for b in range(256)] for a in range(256)])


def simhash(counts: np.ndarray, total: int) -> np.ndarray:
    """Rows of per-bit counts to fingerprints: a bit is set where over half of the total have it."""
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view(np.uint64)[:, 0]


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Items:
    """Index of a bounded block of items, by word length."""

    def __init__(self, ids: list, texts: list[str | None], width: int):
        self.width = width
        w = Words(pa.array(texts, pa.string()), LOWER, ~SOLID)
        h = w.hashes()
        self.by_length: dict[int, dict] = {}
        for i, key in enumerate(ids):
            n = int(w.counts[i])
            if not n:
                continue
            own = h[w.first[i] : w.first[i + 1]]
            grams = self.grams(own, n)
            group = self.by_length.setdefault(n, {"ids": [], "grams": [], "counts": []})
            values, counts = np.unique(grams, return_counts=True)
            group["ids"].append(key)
            group["grams"].append(values)
            group["counts"].append(counts)
            group.setdefault("prints", []).append(simhash(bits_of(grams).sum(0, dtype=np.int64)[None], len(grams))[0])
        for group in self.by_length.values():
            prints = np.array(group["prints"], np.uint64)
            blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
            group["prints"] = prints
            group["near"] = [NEAR[:, blocks[:, b]] for b in range(BLOCKS)]  # [byte][item]
            group["all"] = np.unique(np.concatenate(group["grams"]))

    def gram_width(self, n: int) -> int:
        return min(self.width, n)

    def grams(self, h: np.ndarray, n: int) -> np.ndarray:
        k = self.gram_width(n)
        at = np.arange(len(h) - k + 1)
        return mix(span_hash(h, at, at + k, 0x8CB92BA72F3D8DD7), 20 + k)

    def candidates(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        group = self.by_length[n]
        out_w, out_i = [], []
        for lo in range(0, len(prints), 4096):
            part = prints[lo : lo + 4096]
            byte = part.view(np.uint8).reshape(-1, BLOCKS)
            near = group["near"][0][byte[:, 0]].copy()
            for b in range(1, BLOCKS):
                near |= group["near"][b][byte[:, b]]
            win, item = np.nonzero(near)
            good = np.bitwise_count(part[win] ^ group["prints"][item]) <= RADIUS
            out_w.append(win[good] + lo)
            out_i.append(item[good])
        return np.concatenate(out_w), np.concatenate(out_i)


def scan(part, items: Items, threshold: float):
    """Matches of a batch: (row, item id, similarity, start word), the best window of each row and item."""
    w = Words(part, LOWER, ~SOLID)
    h = w.hashes()
    best: dict[tuple, tuple] = {}
    if not len(h):
        return []
    all_grams: dict[int, tuple] = {}
    for n, group in items.by_length.items():
        k = items.gram_width(n)
        if len(h) < k:
            continue
        if k not in all_grams:
            at = w.windows(k)
            value = np.zeros(len(h), np.uint64)
            value[at] = mix(span_hash(h, at, at + k, 0x8CB92BA72F3D8DD7), 20 + k)
            valid = np.zeros(len(h), bool)
            valid[at] = True
            known = np.unique(np.concatenate([g["all"] for m, g in items.by_length.items() if items.gram_width(m) == k]))
            place = np.minimum(np.searchsorted(known, value), len(known) - 1)
            all_grams[k] = value, valid, np.flatnonzero(valid & (known[place] == value))
        value, valid, seen = all_grams[k]
        place = np.minimum(np.searchsorted(group["all"], value[seen]), len(group["all"]) - 1)
        hit = seen[group["all"][place] == value[seen]]
        if not len(hit):
            continue
        per = n - k + 1  # grams in a window
        doc = w.doc[hit]
        low, high = w.first[doc], w.first[doc + 1]
        short = w.counts[doc] < n
        cover = np.zeros(len(h) + 1, np.int32)
        s, e = np.maximum(hit - per + 1, low)[~short], np.minimum(hit, high - n)[~short] + 1
        good = e > s
        np.add.at(cover, s[good], 1)
        np.add.at(cover, e[good], -1)
        full = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        starts = np.concatenate([full, np.unique(low[short])])
        ends = np.concatenate([full + per, np.unique(high[short]) - k + 1])  # end of the window's gram starts
        shared = np.zeros(len(h) + 1, np.int64)
        shared[hit + 1] = 1
        np.cumsum(shared, out=shared)
        able = shared[ends] - shared[starts] >= threshold * per  # fewer shared grams can't reach the threshold
        starts, ends = starts[able], ends[able]
        for lo in range(0, len(starts), 20000):
            s, e = starts[lo : lo + 20000], ends[lo : lo + 20000]
            used = np.zeros(len(h) + 1, np.int32)
            np.add.at(used, s, 1)
            np.add.at(used, e, -1)
            region = np.flatnonzero(np.cumsum(used[:-1]) > 0)
            total = np.zeros((len(region) + 1, BITS), np.int32)
            np.cumsum(bits_of(value[region]), axis=0, out=total[1:], dtype=np.int32)
            a, b = np.searchsorted(region, s), np.searchsorted(region, e)
            prints = simhash(total[b] - total[a], (e - s)[:, None])
            for win, item in zip(*items.candidates(n, prints), strict=True):
                grams, counts = np.unique(value[s[win] : e[win]], return_counts=True)
                own, own_counts = group["grams"][item], group["counts"][item]
                at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
                common = int(np.minimum(counts, own_counts[at])[own[at] == grams].sum())
                sim = common / (counts.sum() + own_counts.sum() - common)
                if sim >= threshold:
                    row = int(w.doc[s[win]])
                    key = row, n, int(item)
                    found = (-sim, int(s[win] - w.first[row]))
                    if key not in best or found < best[key]:
                        best[key] = found
    return [(row, items.by_length[n]["ids"][item], -sim, start) for (row, n, item), (sim, start) in best.items()]


def item_blocks(benchmark: DataFrame, width: int, block_items: int, block_bytes: int, item_col: str, item_text: str):
    """Indexes over the item table, each of a bounded block."""
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(item_text)).alias("b")).first()
    blocks = max(1, -(-size["n"] // (block_items // 2)), -(-(size["b"] or 0) // (block_bytes // 2)))
    for k in range(blocks):
        own = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = own.collect()  # half of block_items and block_bytes on average
        yield Items([r["i"] for r in rows], [r["t"] for r in rows], width)


def find_contamination(documents: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_items: int = 4096, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word: the best window for each document and item at or above the threshold."""
    if threshold <= 0:
        raise ValueError("threshold must be over 0")
    kind, item_kind = dict(documents.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    out = None
    for index in item_blocks(benchmark, width, block_items, block_bytes, item_col, item_text):

        def run(batches, index=index):
            for c in chunks(batches, 1):
                found = scan(c.column(1), index, threshold)
                if found:
                    row, item, sim, start = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(row)), pa.array(item), pa.array(sim, pa.float64()), pa.array(start, pa.int64())], names=[id_col, item_col, "similarity", "start_word"])

        part = documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{item_col}` {item_kind}, similarity double, start_word long")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_items: int = 4096, block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents in which no item is found, all columns unchanged; one narrow pass per item block."""
    at, out = documents.columns.index(text_col), documents
    for index in item_blocks(benchmark, width, block_items, block_bytes, item_col, item_text):

        def run(batches, index=index):
            for c in chunks(batches, at):
                keep = np.ones(c.num_rows, bool)
                keep[[row for row, *_ in scan(c.column(at), index, threshold)]] = False
                yield c.filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out
