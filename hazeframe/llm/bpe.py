"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across, so a text may be cut between
its two bytes, the fragments encoded one by one and the ids concatenated. `Codec` reads the pairs from the
vocabulary and cuts where a solid byte meets a blank, a Latin letter an ASCII sign or a lone newline an ASCII sign, if
that pair is forced. Cuts of these kinds are also ends of the pre-tokenizer's pieces, so nothing depends on what stands
on the other side. Whole batches are cut and looked up at once with numpy; ids of fragments of at most SHORT bytes are
kept under their 64-bit hashes in a bounded table; `round_trip` compares what the ids spell with the text, so no result
rests on those hashes. Texts that hold a special token are cut one by one.

Null texts count as empty: no ids, empty decoded text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks
from .words import BLANKS, BYTE_VALUE, IS_BLANK, mix, span_hash

SHORT, SLOTS = 64, 1 << 20
BYTE = np.arange(256)
ASCII_LETTER = (BYTE >= 65) & (BYTE <= 90) | (BYTE >= 97) & (BYTE <= 122)
PRINTED = (BYTE >= 33) & (BYTE <= 126)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    def __init__(self, path: str, cache: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.tokens = {i: to_bytes(t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.tokens |= self.special
        self.never = self.forced_pairs(b for i, b in self.tokens.items() if i not in self.special)
        blanks = "".join(map(re.escape, BLANKS.decode())).encode()
        held = [re.escape(bytes([b])) for b in BLANKS]
        kept = [
            b"(?<=[" + b"".join(rb"\x%02x" % a for a in before) + b"])" + held[k]
            for k, b in enumerate(BLANKS)
            if (before := [a for a in range(256) if a not in BLANKS and (a, b) not in self.never])
        ]
        more = b"(?:(?:" + b"|".join(kept) + b")[%s]*[^%s]*)*" % (blanks, blanks) if kept else b""
        rest = b"[%s]*[^%s]+%s|[%s]+" % (blanks, blanks, more, blanks)
        # A word may also be cut from the ASCII signs around it if no token holds such a pair; a run of Latin letters
        # is a whole piece of the pre-tokenizer when no other non-ASCII character follows.
        ascii_letters = [*range(65, 91), *range(97, 123)]
        ends = [b for b in range(128) if b not in ascii_letters]
        if all((a, b) in self.never for a in ascii_letters for b in ends) and all((10, b) in self.never for b in range(33, 127)):
            loose = [a for a in range(128, 192) if any((a, b) not in self.never for b in ends)]
            guard = b"(?<![" + b"".join(rb"\x%02x" % a for a in loose) + b"])" if loose else b""
            word = rb" ?(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff])" + guard
            rest = word + rb"|\n(?=[!-\x7e])|[.,!?;:]++(?=[ \n]|\Z)|" + rest
        self.fragments = re.compile(rest).findall
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        ids = [vocab[a + b] for a, b in merges]
        self.piece = None
        if ids == sorted(set(ids)):  # ids rise with merge ranks, so ranks give the same merges
            ranks = {to_bytes(t): i for t, i in vocab.items()}
            self.piece = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.simple = re.compile(r" ?[^\W\d_]+\Z|[.,;!?]+\Z").match
        self.size, self.known, self.missed = cache, {}, 0
        forced = np.zeros((256, 256), bool)
        forced[tuple(np.array(list(self.never)).T)] = True
        self.forced = forced.ravel()
        left, right = BYTE[:, None], BYTE[None, :]
        blank, sign = IS_BLANK[right], (right < 128) & ~ASCII_LETTER[right]
        self.plain_cut = (forced & (PRINTED[left] & blank | ASCII_LETTER[left] & sign)).ravel()
        self.other_cut = (forced & ((left >= 128) & sign | (left == 10) & PRINTED[right])).ravel()
        self.keys, self.begins, self.counts = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used, self.filled, self.strange = np.zeros(1 << 16, np.uint32), 0, 0, 0
        wide = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.sizes = np.array([len(t) for t in wide])
        self.places, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(wide), np.uint8)

    @staticmethod
    def forced_pairs(tokens) -> set[tuple[int, int]]:
        inside = {pair for t in tokens for pair in zip(t, t[1:], strict=False)}
        return {(a, b) for a in range(256) for b in range(256)} - inside

    def ids_of(self, frag: bytes) -> list[int]:
        text = frag.decode()
        if self.piece and self.simple(text):  # one piece of the pre-tokenizer
            return self.piece(frag)
        return self.library.encode(text, add_special_tokens=False).ids

    def fragment(self, frag: bytes) -> bytes:
        got = np.array(self.ids_of(frag), "<u4").tobytes()
        self.missed += 1
        if self.missed > 8 * self.size:  # the corpus may have changed: collect anew
            self.known.clear()
            self.missed = 0
        if len(frag) <= 64 and len(self.known) < self.size:
            self.known[frag] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, slow = self.known.get, self.fragment
        return b"".join([get(f) or slow(f) for f in self.fragments((text or "").encode())]) if text else b""

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of the fragments of texts that begin at offsets."""
        cut = np.zeros(len(raw), bool)
        pair = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        cut[1:] = self.plain_cut[pair]
        at = np.flatnonzero(self.other_cut[pair]) + 1
        at = at[at >= 2]
        one, two, right = raw[at - 1], raw[at - 2], raw[at]
        three, four = raw[np.maximum(at - 3, 0)], raw[np.maximum(at - 4, 0)]
        latin = (two == 0xC3) & (one != 0x97) & (one != 0xB7)
        # The leads C2 and E1 to E3 are left out, for they begin the blanks beyond ASCII too.
        solid = (two >= 0xC3) & (two < 0xE0) | (two < 0xC0) & ((three == 0xE0) | (three >= 0xE4) & (three < 0xF0) | (three < 0xC0) & (four >= 0xF0))
        lone = (one == 10) & PRINTED[two]
        cut[at[np.where(one >= 128, latin | solid & IS_BLANK[right], lone)]] = True
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        return np.flatnonzero(cut)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end."""
        col = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
        odd = np.zeros(len(col), bool)
        for content in self.special.values():
            odd |= pc.match_substring(col, content.decode()).to_numpy(zero_copy_only=False)
        if odd.any():
            got = [np.frombuffer(self.encode(t.as_py()), "<u4") if o else self.encode_all(col.slice(i, 1))[0] for i, (t, o) in enumerate(zip(col, odd, strict=True))]
            return np.concatenate(got), np.cumsum([len(g) for g in got])
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(col), np.int64)
        start = self.cuts(raw, offsets)
        end = np.append(start[1:], len(raw))
        size = end - start
        key = mix(span_hash(BYTE_VALUE[raw], start, end) ^ size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), 21) | np.uint64(1)
        one, two = (key >> np.uint64(12)) & np.uint64(SLOTS - 1), (key >> np.uint64(40)) & np.uint64(SLOTS - 1)
        slot = np.where(self.keys[one] == key, one, two)
        begin, count = self.begins[slot], self.counts[slot]
        lost = np.flatnonzero((self.keys[slot] != key) | (size > SHORT))
        if len(lost):
            own = np.where(size[lost] > SHORT, lost.astype(np.uint64) << np.uint64(1), key[lost])  # even: kept for itself
            own, first, back = np.unique(own, return_index=True, return_inverse=True)
            ids = [self.ids_of(raw[start[i] : end[i]].tobytes()) for i in lost[first]]
            many = np.array([len(x) for x in ids])
            upto = self.used + int(many.sum())
            if upto > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(upto, np.uint32)])
            self.pool[self.used : upto] = [i for x in ids for i in x]
            place = self.used + np.cumsum(many) - many
            begin[lost], count[lost] = place[back], many[back]
            self.keep(own, place, many, upto)
        after = np.cumsum(count)
        flat = self.pool[np.repeat(begin - (after - count), count) + np.arange(after[-1])]
        return flat, np.concatenate([[0], after])[np.searchsorted(start, offsets[1:])]

    def keep(self, own: np.ndarray, place: np.ndarray, many: np.ndarray, upto: int) -> None:
        """Enter new fragments into free slots, until the table is full; then start anew once many were unknown."""
        self.strange += len(own)
        if self.filled > 0.6 * SLOTS:
            if self.strange > 8 * SLOTS:
                self.keys[:] = 0
                self.used = self.filled = self.strange = 0
            return
        left = (own & np.uint64(1)) == 1
        for shift in (12, 40):
            slot = (own >> np.uint64(shift)) & np.uint64(SLOTS - 1)
            free = left & (self.keys[slot] == 0)
            self.keys[slot[free]] = own[free]
            won = free & (self.keys[slot] == own)
            self.begins[slot[won]], self.counts[slot[won]] = place[won], many[won]
            self.filled += int(won.sum())
            left &= ~won
        self.used = upto

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 of each text's decoding."""
        size = self.sizes[ids]
        after = np.cumsum(size)
        flat = self.bytes[np.repeat(self.places[ids] - (after - size), size) + np.arange(after[-1] if len(after) else 0)].tobytes()
        edge = np.concatenate([[0], after])[np.concatenate([[0], ends])].tolist()
        out = [flat[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)]
        return [b if b.isascii() else b.decode("utf-8", "replace").encode() for b in out]

    def round_trip(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids, ends and decoded bytes of all texts. Ids of another fragment, which equal hashes could give, decode to
        other bytes; such texts, and those that decode otherwise for a special token, are encoded again without hashes."""
        ids, ends = self.encode_all(texts)
        backs = self.decode_all(ids, ends)
        wrong = {i for i, (text, back) in enumerate(zip(texts.cast(pa.large_binary()).to_pylist(), backs, strict=True)) if (text or b"") != back}
        if wrong:
            own = [np.frombuffer(self.encode(texts[i].as_py()), "<u4") if i in wrong else part for i, part in enumerate(np.split(ids, ends[:-1]))]
            ids, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
            backs = self.decode_all(ids, ends)
        return ids, ends, backs

    def decode(self, ids: bytes) -> str:
        table = self.tokens
        return b"".join([table[i] for i in memoryview(ids).cast("I").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", output: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with output also token_ids and decoded.

    A narrow map: no shuffle, memory bounded by one Arrow batch. Other columns of the input are ignored.
    """
    extra = ", token_ids array<int>, decoded string" if output else ""

    def run(batches):
        c = codec(tokenizer)
        for part in chunks(batches, 1):
            ids, ends, backs = c.round_trip(part.column(1))
            counts = np.diff(ends, prepend=0)
            edge = np.concatenate([[0], ends]).tolist()
            own = [ids[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)]
            hashes = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (own, backs)]
            out = [part.column(0), pa.array(counts, pa.int64()), *map(pa.array, hashes)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if output:
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32)))
                out += [lists, pa.array([b.decode() for b in backs], pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
