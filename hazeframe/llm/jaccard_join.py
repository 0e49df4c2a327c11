"""Exact n-gram Jaccard join with a token-group matrix.

Documents are sets of hashed word n-grams. Equal sets form a class, and classes are what is linked: a class has a key of
its own, not that of a document, so rows that share a doc_id but not the text stay apart.

1. Singles: all documents send the tokens of one fixed third of the hash space, packed, to hash buckets. A token
   that no other document has cannot be shared, and a document of n tokens that links with another misses at most
   n - ceil(t n) of its own tokens; with more unshared sampled tokens than that it links with nothing and is done.
2. Components so far: the remaining class representatives are verified against the representative of their min-hash
   bucket, in two rounds, and joined transitively.
3. Singles again, between components: only documents with enough tokens that also occur in another one go on.
4. Token-group matrix over these. Similar documents (one min-hash bucket, nearly one size and one share of tokens in
   common with other components, at most about GROUP of them) form a group. Tokens are ranked by the number of
   components that hold them, rarest first. A query's first n - ceil(t n) + SLACK tokens are looked up in the groups'
   unions of such tokens; matches there plus the tokens after them bound the query's overlap with any member, and so do
   the tokens that query and members share with any other component. Groups whose bound reaches ceil(t n), and that
   hold a smaller component than the query's, are opened whole, as one row, and their members verified exactly.

No cap or sample decides a link. Copies that link cost rows in proportion to their number; of documents that share
nearly all tokens and yet stay below the threshold, those that no bound tells apart are compared group by group. Empty texts and null texts have no tokens
and link with nothing. Rows that repeat a doc_id have one row each, with the component of their own text. A null doc_id joins the class of its text but
never names a component unless it is alone. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, components, partitions, release, remove, staged, written
from .packed import bucket_of, member
from .words import LOWER, Words, mix, span_hash

SHARE = 3  # of the hash space, one in SHARE is sampled for singles
GROUP, WEIGHT = 32, 100_000  # documents and tokens in a group, about
HOT = 100_000  # rows of a min-hash bucket above which it counts as hot
SLACK = 4  # matches that a link must have in two prefixes of n - needed + SLACK tokens


def shingles(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all texts and where each text's begin, in ascending order inside a text."""
    w = Words(texts, LOWER)
    h = w.hashes()
    at = w.windows(width)
    tokens, doc = mix(span_hash(h, at, at + width, 0xA24BAED4963EE407), width), w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        whole = span_hash(h, w.first[short], w.first[short + 1], 0xA24BAED4963EE407)
        tokens, doc = np.concatenate([tokens, mix(whole ^ mix(w.counts[short].astype(np.uint64), 3), 4)]), np.concatenate([doc, short])
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
    tokens, doc = tokens[new], doc[new]
    return tokens, np.searchsorted(doc, np.arange(len(w.counts) + 1))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a link needs to share, of n."""
    return -(-n * percent // 100)


def sampled(tokens: np.ndarray) -> np.ndarray:
    return tokens < np.uint64((1 << 64) // SHARE)


def spread(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens, 9)


class LabelSender:
    """Packed (key, part, label) rows by bucket; a key is sent once for each part and label in a batch."""

    def __init__(self, buckets: int, limit: int = 1_000_000):
        self.buckets, self.limit, self.held, self.n = buckets, limit, [], 0

    def add(self, h, part, label):
        self.held.append((h, part.astype("<u4"), label.astype("<i8")))
        self.n += len(h)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        h, part, label = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.argsort(h, kind="stable")
        h, part, label = h[order], part[order], label[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (label[1:] != label[:-1])
        h, part, label = h[keep], part[keep], label[keep]
        at = np.searchsorted(bucket_of(h, self.buckets), np.arange(self.buckets + 1))
        k4, p2 = h.astype("<u4"), part.astype("<u2" if self.buckets < 65536 else "<u4")
        l4 = mix(label.astype(np.uint64) ^ mix(h, 7), 8).astype("<u4")
        rows = [(b, k4[s:e].tobytes(), p2[s:e].tobytes(), l4[s:e].tobytes()) for b, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s]
        b, k, p, lab = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(p, pa.binary()), pa.array(lab, pa.binary())], names=["bucket", "keys", "parts", "labels"])


def shared(sent: DataFrame, buckets: int) -> DataFrame:
    """part, bucket, keys, counts: for each part its keys that bear two labels or more anywhere, and how many.

    Keys are 32 bits inside a bucket and labels 32-bit hashes drawn anew for each key; a chance collision
    of keys only keeps a document in for the exact steps, one of labels hides a single token, which the slack of one
    token in survives() makes up for.
    """
    wide = "<u2" if buckets < 65536 else "<u4"

    def run(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for b, k, p, lab in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(b, []).append((k, p, lab))
        for b in sorted(by):
            k, p, lab = zip(*by.pop(b), strict=True)
            keys, parts, labels = np.frombuffer(b"".join(k), "<u4"), np.frombuffer(b"".join(p), wide), np.frombuffer(b"".join(lab), "<u4")
            both = np.unique(keys.astype(np.uint64) << np.uint64(32) | labels)
            known, count = np.unique(both >> np.uint64(32), return_counts=True)
            known, count = known[count > 1], count[count > 1]
            pair = np.unique(parts.astype(np.uint64) << np.uint64(32) | keys)
            pair = pair[member(pair & np.uint64(0xFFFFFFFF), known)]
            body = pair & np.uint64(0xFFFFFFFF)
            many = np.minimum(count[np.searchsorted(known, body)], 65535).astype("<u2")
            body, to = body.astype("<u4"), (pair >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
            if len(cut):
                spans = list(zip(cut, [*cut[1:], len(body)], strict=True))
                columns = [pa.array(to[cut], pa.int32()), pa.array([b] * len(cut), pa.int32()), *(pa.array([x[s:e].tobytes() for s, e in spans], pa.binary()) for x in (body, many))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "bucket", "keys", "counts"])

    return sent.repartitionById(buckets, "bucket").mapInArrow(run, "part int, bucket int, keys binary, counts binary")


def after_answers(rows: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Each part's rows after the answers for it: kind 0, then kind 1."""
    both = found.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.select("part", "kind", "bucket", "keys", "counts", *[c for c in rows.columns if c != "part"])
    return both.repartitionById(parts, "part").sortWithinPartitions("part", "kind")


def with_tables(batches):
    """Pairs of a part's table, sorted keys and their counts, and batches of its rows."""
    got, part, table = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            b = batch.slice(s, e - s)
            if b.column(0)[0].as_py() != part:
                got, part, table = [], b.column(0)[0].as_py(), None
            if b.column(1)[0].as_py() == 0:
                for bucket, keys, counts in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    got.append((np.frombuffer(keys, "<u4").astype(np.uint64) | np.uint64(bucket << 32), np.frombuffer(counts, "<u2")))
            else:
                if table is None:
                    keys, counts = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, "<u2"))
                    order = np.argsort(keys)
                    table, got = (keys[order], counts[order]), []
                yield table, b


def holders(tokens: np.ndarray, table: tuple, buckets: int) -> np.ndarray:
    """How many labels hold each token, 0 for one that no other label holds."""
    keys, counts = table
    if not len(keys):
        return np.zeros(len(tokens), np.int64)
    h = spread(tokens)
    key = bucket_of(h, buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, counts[at].astype(np.int64), 0)


def survives(unshared: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Rows that may link: few enough of the tokens looked up are unshared."""
    count = np.concatenate([[0], np.cumsum(unshared)])
    n = np.diff(first)
    return (n > 0) & (count[first[1:]] - count[first[:-1]] <= n - needed(n, percent) + 1)


def rare_prefixes(tokens: np.ndarray, first: np.ndarray, held: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's tokens by (labels that hold it, token): mask of its first n - needed + SLACK ones, without those
    that no other label holds; row ends of the masked ones; the place of every token in that order."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    place = np.zeros(len(tokens), np.int64)
    place[np.lexsort((tokens, held, row))] = np.arange(len(tokens)) - first[:-1][row]
    mask = (place < (n - needed(n, percent) + SLACK)[row]) & (held > 0)
    return mask, np.concatenate([[0], np.cumsum(np.bincount(row[mask], minlength=len(n)))]), place


def with_pivot(rows: DataFrame, pivots: DataFrame, by: list[str]) -> DataFrame:
    """rows with the pivot of their bucket; k is a bucket's size. Buckets of more than HOT rows are joined by broadcast:
    there are at most one for HOT rows of the table, and none of their rows then meet in one task."""
    hot, cold = pivots.where(F.col("k") > HOT), pivots.where(F.col("k") <= HOT)
    rest = rows.join(F.broadcast(hot.select(*by)), by, "left_anti")
    return rows.join(F.broadcast(hot), by).unionByName(rest.join(cold, by))


def grouped(documents: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of the text), n, family, component_id for each row; family names the component by a key of its own."""
    parts = partitions(documents.sparkSession)
    docs = documents.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))

    def send(batches):
        out = LabelSender(parts)
        for c in chunks(batches, 1):
            tokens, first = shingles(c.column(1), width)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            sets = np.add.reduceat(np.append(mix(tokens, 11), np.uint64(0)), first[:-1]) if len(tokens) else np.zeros(len(first) - 1, np.uint64)
            pick = sampled(tokens)
            yield from out.add(spread(tokens[pick]), c.column(0).to_numpy()[doc[pick]], sets.astype(np.int64)[doc[pick]])
        yield from out.flush()

    found = shared(docs.select("part", "text").mapInArrow(send, "bucket int, keys binary, parts binary, labels binary"), parts)
    fields = [("id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("lost", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("m0", pa.int64()), ("m1", pa.int64()), ("tokens", pa.list_(pa.int64()))]

    def describe(batches):
        for table, rows in with_tables(batches):
            for c in chunks([rows], 6):
                tokens, first = shingles(c.column(6), width)
                n = np.diff(first)
                has = n > 0

                def per(f, values, n=n, has=has, first=first):
                    out = np.zeros(len(n), np.uint64)
                    if has.any():
                        out[has] = f.reduceat(values, first[:-1][has])
                    return pa.array(out.astype(np.int64))

                lost = sampled(tokens)
                lost[lost] = holders(tokens[lost], table, parts) == 0
                keep = survives(lost, first, percent)
                gone = np.concatenate([[0], np.cumsum(lost)])
                gone = gone[first[1:]] - gone[first[:-1]]
                kept = np.where(keep, n, 0)
                body = tokens[np.repeat(keep, n)].astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(body), mask=pa.array(~keep))
                yield pa.RecordBatch.from_arrays(
                    [c.column(5), c.column(7), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), per(np.add, mix(tokens, 11)), per(np.add, mix(tokens, 12)), per(np.minimum, mix(tokens, 13)), per(np.minimum, mix(tokens, 14)), lists], names=[f for f, _ in fields]
                )

    merged = after_answers(docs, found, parts).select("part", "kind", "bucket", "keys", "counts", "id", "text", "hash")
    # written numbers name a row for good
    known = staged(merged.mapInArrow(describe, "id long, hash long, n long, lost long, f1 long, f2 long, m0 long, m1 long, tokens array<long>").withColumn("row", F.monotonically_increasing_id()))
    del found, merged
    release(documents.sparkSession)
    meta = known.select("id", "hash", "n", "f1", "f2")
    classes = staged(known.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("low"), F.min("row").alias("row")).withColumn("class", F.xxhash64("n", "f1", "f2")))
    paths: list[str] = []

    def temporary(df: DataFrame) -> DataFrame:
        table, path = written(df)
        paths.append(path)
        return table

    alive = temporary(known.where("tokens is not null").join(classes.select("row", "class", F.coalesce("low", F.lit((1 << 63) - 1)).alias("age")), "row").select(F.col("class").alias("id"), "age", "n", (F.col("lost") / F.col("n")).alias("odd"), "m0", "m1", "tokens"))

    share = F.size(F.array_intersect("tokens", "other"))
    linked = share * 100 >= percent * (F.col("n") + F.col("n_other") - share)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (id, pivot) that link."""
        others = alive.select(F.col("id").alias("pivot"), F.col("n").alias("n_other"), F.col("tokens").alias("other"))
        return pairs.join(alive.select("id", "n", "tokens"), "id").join(others, "pivot").where(linked).select(F.col("id").alias("a"), F.col("pivot").alias("b"))

    def labelled(edges: DataFrame) -> DataFrame:
        comp = components(edges)
        ids = alive.select("id", "age", "n", "odd", "m0", "m1")
        return ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", "age", "n", "odd", "m0", "m1", F.coalesce("component", "id").alias("comp"))

    # a pivot has the fewest odd tokens of its bucket: of copies of one text it is the one most like all others; of several
    # the one with the smallest doc_id, the age of its class, since what was copied tends to come first
    size_fits = (F.col("n") * 100 >= F.col("n_p") * percent) & (F.col("n_p") * 100 >= F.col("n") * percent)
    classed = alive.select("id", "age", "n", "odd", "m0", F.floor(F.log2("n") * 4).alias("wide"))
    pivots = temporary(classed.groupBy("m0", "wide").agg(F.min(F.struct("odd", "age", "id", "n")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1").select("m0", "wide", "k", F.col("p.id").alias("pivot"), F.col("p.n").alias("n_p")))
    edges = temporary(verified(with_pivot(classed, pivots, ["m0", "wide"]).where(F.col("id") != F.col("pivot")).where(size_fits).select("id", "pivot")))
    comp = temporary(labelled(edges))
    release(documents.sparkSession)
    for by in ("m1", "m0"):
        pivots = comp.groupBy(by).agg(F.min(F.struct("odd", "age", "id", "n", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("top"), F.count(F.lit(1)).alias("k")).where("low <> top").select(by, "k", F.col("p.comp").alias("c_p"), F.col("p.id").alias("pivot"), F.col("p.n").alias("n_p"))
        second = with_pivot(comp, temporary(pivots), [by]).where("comp <> c_p").where(size_fits).groupBy("comp", "c_p").agg(F.min(F.struct("odd", "age", "id", "pivot")).alias("x")).select("x.id", "x.pivot")
        edges = edges.union(temporary(verified(second)))
        comp = temporary(labelled(edges))
        release(documents.sparkSession)

    placed = alive.select("id", "n", "m0", "tokens").join(comp.select("id", "comp"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def lists(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy().astype(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])

    def send_groups(batches):
        out = LabelSender(parts)
        for b in batches:
            if b.num_rows:
                tokens, first = lists(b.column(1))
                row = np.repeat(np.arange(b.num_rows), np.diff(first))
                yield from out.add(spread(tokens), b.column(0).to_numpy()[row], b.column(2).to_numpy()[row])
        yield from out.flush()

    def across(batches):
        for table, b in with_tables(batches):
            tokens, first = lists(b.column(9))
            held = holders(tokens, table, parts)
            keep = survives(held == 0, first, percent)
            mask, ends, place = rare_prefixes(tokens, first, held, percent)
            prefix = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[mask].astype(np.int64))) for x in (tokens, place)]
            seen = np.concatenate([[0], np.cumsum(held > 0)])
            common = pa.array(seen[first[1:]] - seen[first[:-1]] + 1, pa.int64())  # one may be hidden, see shared()
            columns = [b.column(5), b.column(6), b.column(7), b.column(8), common, *prefix, b.column(9)]
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in columns], names=["id", "n", "comp", "m0", "common", "prefix", "places", "tokens"])

    found = shared(placed.select("part", "tokens", "comp").mapInArrow(send_groups, "bucket int, keys binary, parts binary, labels binary"), parts)
    merged = after_answers(placed, found, parts).select("part", "kind", "bucket", "keys", "counts", "id", "n", "comp", "m0", "tokens")
    rest = temporary(merged.mapInArrow(across, "id long, n long, comp long, m0 long, common long, prefix array<long>, places array<long>, tokens array<long>"))
    del found, merged
    release(documents.sparkSession)

    # Groups of similar documents: one component or min-hash bucket, size class and share of tokens in common with others, so that
    # the bounds below hold for all members alike; large ones are dealt into parts of about GROUP documents or WEIGHT tokens.
    missing = F.floor((F.col("n") - F.col("common")) * 100 / F.col("n"))
    # staged, so that Spark can split the rows of a large component or class between tasks when it joins them
    alone = temporary(rest.groupBy("comp").agg(F.count(F.lit(1)).alias("held_by")).where("held_by = 1").select("comp", F.lit(True).alias("alone")))
    kin = rest.join(alone, "comp", "left").withColumn("kin", F.xxhash64(F.when(F.col("alone"), F.col("m0")).otherwise(F.col("comp")), missing, F.floor(F.log2("n") * 8)))
    buckets = temporary(kin.groupBy("kin").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / WEIGHT)).alias("k")))
    dealt = kin.join(buckets, "kin").withColumn("group", F.xxhash64("kin", F.pmod(F.xxhash64("id"), F.col("k"))))
    rest = temporary(dealt.select("id", "n", "comp", "group", "common", "prefix", "places", "tokens"))
    release(documents.sparkSession)
    cells = rest.select("id", "n", "comp", "group", "common", F.explode(F.arrays_zip("prefix", "places")).alias("x"))
    cells = temporary(cells.select("id", "n", "comp", "group", "common", F.col("x.prefix").alias("token"), F.col("x.places").alias("place")))
    matrix = cells.groupBy("token", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("common").alias("most"), F.min("comp").alias("c0"), F.min("place").alias("soonest"))
    queries = cells.select("token", "id", "n", "comp", "common", "place")
    fitting = (F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100)
    # an overlap holds only tokens that both sides have in common with other components
    able = F.least("common", "most") * (100 + percent) >= (F.col("n") + F.col("low")) * percent
    open_yet = F.col("c0") < F.col("comp")  # of two components the one with the larger id asks
    # A link shares `need` tokens at least, so SLACK of them stand before place n - need + SLACK on either side.
    need = F.ceil((F.col("n") + F.col("low")) * percent / (100 + percent) - 1e-6)
    early = (F.col("place") < F.col("n") - need + SLACK) & (F.col("soonest") < F.col("high") - need + SLACK)
    met = queries.join(matrix, "token").where(fitting & able & open_yet & early).groupBy("id", "n", "group").agg(F.count(F.lit(1)).alias("met"), F.min(need).alias("need"))
    bounded = met.where(F.col("met") >= F.least(F.lit(SLACK), F.col("need"))).select("id", "group")
    held = rest.groupBy("group").agg(F.collect_list(F.struct("id", "comp", "tokens")).alias("m"))  # about GROUP documents
    opened = bounded.join(rest.select("id", "comp", "tokens"), "id").join(held.select("group", F.col("m.id").alias("ids"), F.col("m.comp").alias("comps"), F.col("m.tokens").alias("sets")), "group")

    def verify(batches):
        for b in batches:
            out_a, out_b = [], []
            for i in range(b.num_rows):
                me, own = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                mine = np.sort(b.column(2)[i].values.to_numpy())
                sets = b.column(5)[i].values
                sizes = sets.value_lengths().to_numpy()
                flat = sets.flatten().to_numpy()
                common = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[member(flat, mine)], minlength=len(sizes))
                ok = common * 100 >= percent * (len(mine) + sizes - common)
                comps = b.column(4)[i].values.to_numpy()
                ok &= comps < own
                ids = b.column(3)[i].values.to_numpy()[ok]
                first = np.unique(comps[ok], return_index=True)[1]  # one link joins two components
                out_a += [me] * len(first)
                out_b += ids[first].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    last = temporary(opened.select("id", "comp", "tokens", "ids", "comps", "sets").mapInArrow(verify, "a long, b long"))
    comp = components(edges.union(last)).select(F.col("node").alias("class"), F.col("component").alias("family"))

    remove(documents.sparkSession, *paths)  # the result reads known, classes and comp only

    named = classes.join(comp, "class", "left").select("n", "f1", "f2", "low", F.coalesce("family", "class").alias("family"))
    lowest = named.groupBy("family").agg(F.min("low").alias("component_id"))
    return meta.join(named.drop("low").join(lowest, "family"), ["n", "f1", "f2"], "left").select("id", "hash", "n", "family", F.coalesce("component_id", "id").alias("component_id"))


def group_documents(documents: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: transitive closure of 100 |A n B| >= percent |A u B|."""
    return grouped(documents, width, percent, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest doc_id of each group (of several with that id, the smallest hash), all columns
    unchanged.

    Rows that repeat both doc_id and text keep one. Documents without words form no group and stay, as do rows
    with a null doc_id, which nothing can name.
    """
    rows = grouped(documents, width, percent, id_col, text_col).where("id is not null")
    first = rows.where("n > 0").groupBy("family").agg(F.min(F.struct("id", "hash")).alias("k")).select("k.id", "k.hash")
    kept = first.unionAll(rows.where("n = 0").select("id", "hash")).distinct()
    named = documents.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash")).join(kept, ["id", "hash"], "left_semi")
    first = Window.partitionBy("id", "hash").orderBy("hash")
    one = named.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select("_row.*").unionAll(documents.where(F.col(id_col).isNull()))
