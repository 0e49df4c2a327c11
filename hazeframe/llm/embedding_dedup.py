"""Embedding near-dedup by NN-descent.

Vectors are compared inside one label and one dimension by cosine in double precision. Equal vectors are one node.

1. Start: a few times, nodes are sorted by label, sign code and value of random projections and compared with the
   nodes beside them, in overlapping blocks; each node keeps its `k` best neighbours.
2. Descent: in each round a node's bag (its neighbours and those that list it) is compared within itself, which joins
   neighbours of neighbours; new best neighbours replace old ones. Rounds go on until few lists change.
3. Links at or above the threshold give groups. Lists that are full of links are saturated: such nodes may have more
   links than places, so their group is opened as the enlarged list. From the group's mean direction, angles a and b
   with a + b below the threshold's angle prove a link without comparing the pair; the pairs left over (outer nodes
   against the group, in blocks) are compared exactly. Links are counted, not listed, so a group of m near copies
   costs m rows and not m * m.
4. Audit: group means and the vectors without a link descend once more among themselves, from other projections, so
   those that the graph left apart are found, opened against each other and joined. Where a list is full and its last
   neighbour still lies inside the angle bound, the list is replaced by all others of the label in bound, in blocks.
5. Some PROBES vectors are compared with all rows. While the mean share of their links that was found is below the
   target, 1 to 4 run again with twice the places and projections; in the last run, past BLOCK places, every list is
   replaced as in 4, which is exact and grows with the square of a label.

recall() compares a stated query set with all rows by brute force.

Null labels, null vectors, zero vectors and vectors with null or non-finite components link with nothing and are
their own component. Rows that repeat a vec_id count as other rows with the same vector do. Vectors without a vec_id
link and count like others but name no component, unless all of it lack one: then component_id is null. An id of
2^62 or more is an error. kept is true where component_id is null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, partitions, staged

EDGE = "u long, v long, s double"
NODE = "id long, grp long, vec array<double>"
BLOCK, PROBES = 192, 1000
SURE = 1e-7  # angles of nearly equal vectors are known to about 2e-8
UNNAMED = 1 << 62  # ids from here on stand for vectors without one


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def edges_batch(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "s"])


def best_edges(ids: np.ndarray, grp: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each row's k best others of the same group."""
    sim = np.where(grp[:, None] == grp[None, :], x @ x.T, -2.0)
    sim[ids[:, None] == ids[None, :]] = -2.0
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sim, top, 1)
    good = s > -1.5
    return np.repeat(ids, k)[good.ravel()], ids[top].ravel()[good.ravel()], s[good]


def start(nodes: DataFrame, k: int, tables: int, seed: int = 0, bits: int = 6, block: int = BLOCK) -> DataFrame:
    """Edges between nodes that random projections sort side by side."""
    parts = partitions(nodes.sparkSession)

    def code_of(table: int):
        def code(batches):
            for b in batches:
                for part in by_width(b, 2):
                    x = matrix(part.column(2))
                    rng = np.random.default_rng([table, x.shape[1]])
                    p = x @ rng.standard_normal((x.shape[1], bits + 1))
                    c = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c, pa.int32()), pa.array(p[:, bits], pa.float64())], names=["id", "grp", "vec", "code", "place"])

        return code

    def compare(batches):
        ids, grp, x = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b in batches:
            for part in by_width(b, 2):
                i, g, y = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2))
                if x is None or x.shape[1] != y.shape[1]:
                    if x is not None and len(ids) > 1:
                        yield edges_batch(*best_edges(ids, grp, x, k))
                    ids, grp, x = i[:0], g[:0], y[:0]
                ids, grp, x = np.concatenate([ids, i]), np.concatenate([grp, g]), np.concatenate([x, y])
                while len(ids) > 2 * block:
                    yield edges_batch(*best_edges(ids[: 2 * block], grp[: 2 * block], x[: 2 * block], k))
                    ids, grp, x = ids[block:], grp[block:], x[block:]
        if len(ids) > 1:
            yield edges_batch(*best_edges(ids, grp, x, k))

    out = None
    for t in range(seed, seed + tables):
        coded = nodes.mapInArrow(code_of(t), NODE + ", code int, place double")
        order = ["grp", "code", "place", "id"]
        found = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "grp", "vec").mapInArrow(compare, EDGE)
        out = found if out is None else out.unionAll(found)
    return out


def by_width(batch, column: int):
    """Parts of a batch whose vectors have one length."""
    if not batch.num_rows:
        return
    n = np.asarray(pc.list_value_length(batch.column(column)))
    cut = [0, *(np.flatnonzero(n[1:] != n[:-1]) + 1).tolist(), len(n)]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(s, e - s)


def top(edges: DataFrame, key: str, other: str, k: int) -> DataFrame:
    """The k best distinct edges of each key. Tasks keep k edges of a key before they send any, so hubs stay small."""
    flat = edges.groupBy(key, other).agg(F.max("s").alias("s"), F.max("old").alias("old"))
    best = Window.partitionBy(key).orderBy(F.desc("s"), other)
    return flat.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select(key, other, "s", "old")


def descend(nodes: DataFrame, edges: DataFrame, k: int, rows: int) -> DataFrame:
    """One round: compare each node's bag within itself, return the improved lists; old marks edges known before."""
    parts = partitions(nodes.sparkSession)
    forward = edges.select(F.col("u").alias("m"), F.col("v").alias("id"))
    reverse = top(edges.select(F.col("v").alias("m"), F.col("u").alias("id"), "s", "old"), "m", "id", k)
    bags = forward.unionAll(reverse.select("m", "id"))
    found_in = bags.join(nodes, "id").select("m", "id", "grp", "vec").repartition(parts, "m").sortWithinPartitions("m", "id")

    def compare(batches):
        held = None
        for b in batches:
            for part in by_width(b, 3):
                m, i, g, x = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), matrix(part.column(3))
                if held is not None and held[0][-1] == m[0] and held[3].shape[1] == x.shape[1]:
                    m, i, g, x = (np.concatenate([a, c]) for a, c in zip(held, (m, i, g, x), strict=True))
                elif held is not None:
                    yield edges_batch(*best_edges(*held[1:], 3))
                once = np.ones(len(m), bool)  # a neighbour may stand in both lists
                once[1:] = (m[1:] != m[:-1]) | (i[1:] != i[:-1])
                m, i, g, x = m[once], i[once], g[once], x[once]
                cut = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist()]
                out = [best_edges(i[s:e], g[s:e], x[s:e], 3) for s, e in zip(cut[:-1], cut[1:], strict=True)]
                if out:
                    yield edges_batch(*(np.concatenate(c) for c in zip(*out, strict=True)))
                held = m[cut[-1] :], i[cut[-1] :], g[cut[-1] :], x[cut[-1] :]
        if held is not None:
            yield edges_batch(*best_edges(*held[1:], 3))

    found = found_in.mapInArrow(compare, EDGE).withColumn("old", F.lit(0))
    return staged(top(edges.withColumn("old", F.lit(1)).unionAll(found), "u", "v", k), rows=rows)


def graph(nodes: DataFrame, k: int, tables: int, rounds: int | None = None, seed: int = 0, known: DataFrame | None = None, settle: float = 0.01) -> DataFrame:
    """The k best edges found of each node, from the start and from known edges; rounds None: until settled."""
    rows = k * nodes.count()
    first = start(nodes, k, tables, seed)
    first = first if known is None else first.unionByName(known.select("u", "v", "s"))
    edges = staged(top(first.withColumn("old", F.lit(0)), "u", "v", k), rows=rows)
    n = edges.count()
    while rounds is None or rounds > 0:
        edges = descend(nodes, edges, k, rows)
        if edges.where("old = 0").count() <= settle * n:
            break
        rounds = None if rounds is None else rounds - 1
    return edges


def in_bound(full: DataFrame, centres: DataFrame, angle: float, block: int = 256) -> DataFrame:
    """(u, v) of each full(u) with all other centres(id, grp, vec, radius) of its grp in the angle bound, in blocks."""
    sizes = centres.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = centres.join(sizes, "grp").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = dealt.join(full.select(F.col("u").alias("id")), "id", "left_semi")
    asked = left.select("grp", F.col("blk").alias("a")).distinct()
    left = left.select("grp", F.col("blk").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(0).alias("side"), "id", "vec", "radius")
    right = dealt.join(asked, "grp").select("grp", "a", F.col("blk").alias("b"), F.lit(1).alias("side"), "id", "vec", "radius")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []})
        apart = np.arccos(np.clip(np.stack(a["vec"].to_numpy()) @ np.stack(b["vec"].to_numpy()).T, -1, 1))
        i, j = np.nonzero(apart <= angle + a["radius"].to_numpy()[:, None] + b["radius"].to_numpy()[None, :] + SURE)
        u, v = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    return left.unionByName(right).groupBy("grp", "a", "b").applyInPandas(compare, "u long, v long")


def brute(nodes: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """u, want: links of the queries(id, grp, vec), a bounded number, with all nodes(id, grp, vec, k)."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    rows = queries.select("id", "grp", "vec").collect()
    for key in {(r["grp"], len(r["vec"])) for r in rows}:
        own = [r for r in rows if (r["grp"], len(r["vec"])) == key]
        held[key] = np.array([r["id"] for r in own]), np.array([r["vec"] for r in own])

    def count(batches):
        n: dict[int, int] = {}
        for b in batches:
            for part in by_width(b, 2):
                i, g, x, k = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2)), part.column(3).to_numpy()
                for grp in np.unique(g).tolist():
                    if (grp, x.shape[1]) in held:
                        ids, q = held[grp, x.shape[1]]
                        of = g == grp
                        hit = (q @ x[of].T >= threshold) & (ids[:, None] != i[of][None, :])
                        for u, more in zip(ids.tolist(), (hit @ k[of]).tolist(), strict=True):
                            n[u] = n.get(u, 0) + more
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["u", "n"])

    return nodes.select("id", "grp", "vec", "k").mapInArrow(count, "u long, n long").groupBy("u").agg(F.sum("n").alias("want"))


def share_found(true: DataFrame, found: DataFrame) -> float:
    """Mean share of true(u, want) links in found(u, n), over the queries that have one; 1 without any."""
    both = true.where("want > 0").join(found, "u", "left")
    share = both.agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("want"))).first()[0]
    return 1.0 if share is None else share


def recall(embeddings: DataFrame, found: DataFrame, threshold: float = 0.93, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> float:
    """Mean share of links in found, the result of near_duplicates, for distinct vectors with vec_id % every = 0.

    Each is compared with all rows, PROBES at a time, so the work grows with the square of the table.
    """
    nodes = prepared(embeddings, id_col, vec_col, label_col)[-1]
    asked = nodes.where(F.pmod("id", F.lit(every)) == 0)
    passes = -(-asked.count() // PROBES)
    true = None
    for p in range(passes):
        some = brute(nodes, asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p), threshold)
        true = some if true is None else true.unionAll(some)
    if true is None:
        return 1.0
    n = found.groupBy(F.col(id_col).alias("u")).agg(F.first("n_links").alias("n")).join(nodes.select(F.col("id").alias("u"), "k"), "u")
    return share_found(true, n.select("u", (F.col("n") - F.col("k") + 1).alias("n")))


def means(members: DataFrame, key: str) -> DataFrame:
    """key, grp, vec: mean directions, summed first inside tasks."""

    def partial(batches):
        for b in batches:
            for part in by_width(b, 2):
                keys, x = part.column(0).to_numpy(), matrix(part.column(2))
                uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                total = np.zeros((len(uniq), x.shape[1]))
                np.add.at(total, inverse, x)
                yield pa.RecordBatch.from_arrays([pa.array(uniq, pa.int64()), part.column(1).take(pa.array(first)), pa.array(list(total), pa.list_(pa.float64()))], names=["id", "grp", "vec"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sum(np.stack(pdf["vec"].to_numpy()), axis=0)
        n = np.linalg.norm(v)
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "grp": pdf["grp"].iloc[:1], "vec": [v / n if n > 0 else v]})

    return members.select(F.col(key).alias("id"), "grp", "vec").mapInArrow(partial, NODE).groupBy("id").applyInPandas(whole, NODE)  # a row for each group and batch


def count_links(members: DataFrame, pairs: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """u, n: links of members(id, grp, vec, k, comp) with members of the comps that pairs(comp, other) name.

    Members of both comps are dealt to blocks by hash, and block pairs compared; only counts leave a task, and one
    linking pair for each two comps, as the edge that joins them.
    """
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    dealt = members.join(sizes, "comp").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    count = sizes.select("comp", F.ceil(F.col("size") / block).cast("int").alias("n_blk"))
    own = dealt.join(pairs, "comp").join(count.withColumnRenamed("comp", "other").withColumnRenamed("n_blk", "n_other"), "other")
    left = own.where("is_query").select("comp", "other", "blk", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias("blk2"), F.lit(0).alias("side"), "id", "vec", "k")
    right = dealt.select(F.col("comp").alias("other"), F.col("blk").alias("blk2"), "id", "vec", "k").join(pairs.join(count, "comp"), "other")
    right = right.select("comp", "other", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("blk"), "blk2", F.lit(1).alias("side"), "id", "vec", "k")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": [], "n": []})
        hit = np.stack(a["vec"].to_numpy()) @ np.stack(b["vec"].to_numpy()).T >= threshold
        hit &= a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
        n = hit @ b["k"].to_numpy()
        some = np.where(hit.any(1), b["id"].to_numpy()[hit.argmax(1)], -1)
        return pd.DataFrame({"u": a["id"].to_numpy(), "v": some, "n": n})

    return left.unionByName(right).groupBy("comp", "other", "blk", "blk2").applyInPandas(compare, "u long, v long, n long")


def prepared(embeddings: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, ...]:
    """Marked rows, the usable ones, their classes of equal vectors, and the classes as nodes(id, grp, vec, k)."""
    too_high = F.raise_error(F.concat(F.lit(f"{id_col} must lie below 2^62: "), F.col(id_col).cast("string"))).cast("long")
    vid = F.when(F.col(id_col) >= UNNAMED, too_high).otherwise(F.col(id_col).cast("long"))
    raw = embeddings.select(vid.alias("vid"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    top_abs = F.aggregate("x", F.lit(0.0), lambda acc, v: F.greatest(acc, F.abs(v)))
    usable = F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)) & (top_abs > 0)
    marked = staged(raw.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("x", F.when(F.col("ok"), F.col("x"))))
    good = marked.where("ok")
    unnamed = F.lit(UNNAMED) + F.xxhash64("label", "x").bitwiseAND(F.lit(UNNAMED - 1))
    same = good.groupBy("label", "x").agg(F.min("vid").alias("id"), F.count(F.lit(1)).alias("k")).withColumn("id", F.coalesce("id", unnamed))

    def unit(batches):
        for b in batches:
            for part in by_width(b, 2):
                x = matrix(part.column(2))
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64())), part.column(3)], names=["id", "grp", "vec", "k"])

    nodes = staged(same.select("id", F.xxhash64("label", F.size("x")).alias("grp"), "x", "k").mapInArrow(unit, NODE + ", k long"))
    return marked, good, same, nodes


def linked(nodes: DataFrame, known: DataFrame | None, threshold: float, k: int, tables: int, rounds: int | None, exact: bool) -> tuple[DataFrame, ...]:
    """Steps 1 to 4: n_links(u, n), comp(node, component) and the linking edges(a, b), known ones among them."""
    plain = nodes.select("id", "grp", "vec")
    near = graph(plain, k, tables, rounds)
    links = near.where(F.col("s") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    links = staged((links if known is None else links.unionByName(known)).distinct())
    comp = components(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    members = staged(nodes.join(comp, "id").select("id", "grp", "vec", "k", "comp"))  # nodes with a link
    alone = staged(nodes.join(comp, "id", "left_anti").select("id", "grp", "vec", "k", F.col("id").alias("comp")))

    # audit: groups and single vectors that the graph left apart, groups through their mean directions
    mid = staged(means(members, "comp"))
    centres = staged(mid.unionByName(alone.select("id", "grp", "vec")))
    inside = members.join(mid.select(F.col("id").alias("comp"), F.col("vec").alias("mid")), "comp").select("id", "grp", "vec", "k", "comp", F.least(F.lit(1.0), F.aggregate(F.zip_with("vec", "mid", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)).alias("cosine"))
    far = staged(inside.unionByName(alone.withColumn("cosine", F.lit(1.0))))
    reach = staged(far.groupBy("comp").agg(F.max(F.acos("cosine")).alias("radius")))
    angle = math.acos(threshold)
    single = [alone.select(F.col("id").alias(c)) for c in ("u", "v")]
    beside = near.join(single[0], "u", "left_semi").join(single[1], "v", "left_semi").select("u", "v", "s")
    beside = staged(graph(centres, k, tables, rounds, tables, beside))
    placed = staged(centres.join(reach.withColumnRenamed("comp", "id"), "id").select("id", "grp", "vec", "radius"))
    widest = placed.groupBy("grp").agg(F.max("radius").alias("most"))
    full = placed.join(widest, "grp").select(F.col("id").alias("u"), (angle + F.col("radius") + F.col("most") + SURE).alias("bound"))
    if not exact:
        last = beside.groupBy("u").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        full = last.join(full, "u").where(F.acos(F.greatest(F.lit(-1.0), F.least(F.col("s"), F.lit(1.0)))) <= F.col("bound"))
    full = staged(full.select("u"))
    met = (
        beside.join(reach.select(F.col("comp").alias("u"), F.col("radius").alias("ru")), "u")
        .join(reach.select(F.col("comp").alias("v"), F.col("radius").alias("rv")), "v")
        .where(F.acos(F.least(F.col("s"), F.lit(1.0))) <= angle + F.col("ru") + F.col("rv") + SURE)
        .select("u", "v")
    )
    if full.limit(1).count():
        met = met.unionByName(in_bound(full, placed, angle))
    pairs = (
        met.select(F.explode(F.array(F.struct(F.col("u").alias("comp"), F.col("v").alias("other")), F.struct(F.col("v").alias("comp"), F.col("u").alias("other")))).alias("p"))
        .select("p.comp", "p.other")
        .distinct()
    )
    between = staged(count_links(far.withColumn("is_query", F.lit(True)), staged(pairs), threshold))
    links = staged(links.unionAll(between.where("v >= 0").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct())
    comp = components(links)

    # links inside a group: proved by angles for inner nodes, compared for outer ones
    angles = far.join(reach, "comp").withColumn("theta", F.acos("cosine"))
    inner = F.col("theta") + F.col("radius") <= angle - SURE
    total = far.groupBy("comp").agg(F.sum("k").alias("all"))
    sure = angles.where(inner).join(total, "comp").select(F.col("id").alias("u"), (F.col("all") - F.col("k")).alias("n"))
    query = angles.select("id", "grp", "vec", "k", "comp", (~inner).alias("is_query"))
    open_comps = query.where("is_query").select("comp", F.col("comp").alias("other")).distinct()
    outer = count_links(query.join(open_comps.select("comp"), "comp", "left_semi"), staged(open_comps), threshold)
    n_links = staged(sure.unionAll(outer.select("u", "n")).unionAll(between.select("u", "n")).groupBy("u").agg(F.sum("n").alias("n")))
    return n_links, comp, links


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, k: int = 10, tables: int = 6, rounds: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", target: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept. k and tables are those of the first run; target is the probes' recall."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    marked, good, same, nodes = prepared(embeddings, id_col, vec_col, label_col)
    every = max(1, nodes.count() // PROBES)
    probes = staged(brute(nodes, nodes.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), threshold))
    links = None
    while True:
        n_links, comp, links = linked(nodes, links, threshold, k, tables, rounds, exact=k > BLOCK)
        if k > BLOCK or share_found(probes, n_links) >= target:
            break
        k, tables = 2 * k, 2 * tables

    classes = same.select(F.col("id"), "k", "label", "x").join(n_links.withColumnRenamed("u", "id"), "id", "left").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    named = classes.select("label", "x", (F.col("k") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("component_id", F.when(F.col("component_id") < UNNAMED, F.col("component_id")))
    joined = good.join(named, ["label", "x"]).select("vid", "n_links", "component_id")
    alone = marked.where("not ok").select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component_id"))
    return joined.unionAll(alone).select(F.col("vid").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vid") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
