"""Keyed streams, publication and reconciliation: replays, restarts and second writers."""

import random

import pytest
from pyspark.sql import functions as F

from hazeframe.operators import contract, reconcile, snapshot
from hazeframe.streaming import hourly, keyed

SCHEMA = "station string, hour int, amended boolean, ord int, value double"


def order():
    return F.col("hour"), F.col("amended"), -F.col("ord")


def batches(seed, n=6):
    rng = random.Random(seed)
    rows = [(f"s{rng.randint(0, 25)}", rng.randint(0, 4), rng.random() < 0.3, i, rng.random()) for i in range(240)]
    rng.shuffle(rows)
    return [rows[i::n] for i in range(n)], rows


def files(spark, path, parts, schema=SCHEMA):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")


def read_stream(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def plain_newest(rows):
    best = {}
    for r in rows:
        if r[0] not in best or (r[1], r[2], -r[3]) > (best[r[0]][1], best[r[0]][2], -best[r[0]][3]):
            best[r[0]] = r
    return sorted(best.values())


def test_amendments_in_any_batch_order(spark, tmp_path):
    parts, rows = batches(3)
    for turn, own in enumerate((parts, parts[::-1])):
        table = keyed.KeyedTable(spark, f"{tmp_path}/t{turn}", "station", SCHEMA, 4)
        files(spark, f"{tmp_path}/in{turn}", own)
        keyed.amended(read_stream(spark, f"{tmp_path}/in{turn}"), table, f"{tmp_path}/c{turn}", *order())
        assert sorted(map(tuple, table.read().collect())) == plain_newest(rows)
    late = [("s1", 99, False, 1, 1.0), ("s1", 99, True, 2, 2.0)]
    files(spark, f"{tmp_path}/in1/more", [late[1:], late[:1]])  # the amendment comes first, its original after it
    keyed.amended(read_stream(spark, f"{tmp_path}/in1"), table, f"{tmp_path}/c1", *order())
    assert sorted(map(tuple, table.read().collect())) == plain_newest(rows + late)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    parts, rows = batches(5, 3)
    table = keyed.KeyedTable(spark, f"{tmp_path}/t", "station", SCHEMA, 4)
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    for n, df in enumerate(frames):
        table.upsert(df, n, *order())
    for n in (2, 1):  # tried again, also from before the last one
        table.upsert(frames[n], n, *order())
    table.upsert(frames[2], 2, *order())
    assert sorted(map(tuple, table.read().collect())) == plain_newest(rows)
    assert sorted(map(tuple, table.read(2).collect())) == plain_newest(parts[0] + parts[1])
    written = table.written()
    table.upsert(spark.createDataFrame([("s1", 99, False, 1, 1.0)], SCHEMA), 3, *order())
    assert sum(n == 3 for n in table.written().values()) == 1 and len(table.written()) == len(written)  # one bucket
    table.upsert(frames[0].limit(0), 4, *order())
    assert table.written() == table.written(4) and table.read().count() == len(plain_newest(rows))


def test_changed_polls_equal_the_batch_query_after_restarts(spark, tmp_path):
    rng = random.Random(8)
    schema = "client string, at int, publication string"
    rows = [(f"c{rng.randint(0, 6)}", i, rng.choice(["a", "b", None])) for i in range(150)]
    table = keyed.KeyedTable(spark, f"{tmp_path}/state", "client", schema, 4)
    for n in range(3):  # three runs, two files each
        files(spark, f"{tmp_path}/in/run{n}", [rows[n * 50 : n * 50 + 20], rows[n * 50 + 20 : n * 50 + 50]], schema)
        keyed.changed(read_stream(spark, f"{tmp_path}/in", schema), table, f"{tmp_path}/sink", f"{tmp_path}/check", "at", "publication")
    got = sorted(map(tuple, spark.read.schema(schema).parquet(f"{tmp_path}/sink/*").collect()))
    last, want = {}, []
    for r in rows:
        if r[0] not in last or last[r[0]] != r[2]:
            want.append(r)
        last[r[0]] = r[2]
    assert got == sorted(want)
    named = spark.createDataFrame([r for r in rows if r[2]], schema)
    assert contract.changed(named, "client", "at", "publication").count() > 0


def test_a_replayed_batch_publishes_once_and_a_second_writer_fails(spark, tmp_path):
    schema = "id int"
    files(spark, f"{tmp_path}/in", [[(1,)], [(2,), (3,)]], schema)
    store = snapshot.SnapshotStore(spark, f"{tmp_path}/store")
    hourly.published(read_stream(spark, f"{tmp_path}/in", schema), store, "t", f"{tmp_path}/check", None).awaitTermination()
    assert store.latest() == 2
    kept = sorted(r[0] for r in store.current()["t"].collect())
    version = store.publish({"t": spark.range(9)}, 2, f"{tmp_path}/check:1")  # the last batch again
    assert store.latest() == 2 and sorted(r[0] for r in store.current()["t"].collect()) == kept and len(version) == 20
    with pytest.raises(snapshot.Conflict):
        store.publish({"t": spark.range(9)}, 2, "other")
    with pytest.raises(snapshot.Conflict):
        store.publish({"t": spark.range(9)}, 1, "other")
    other = hourly.published(read_stream(spark, f"{tmp_path}/in", schema), store, "t", f"{tmp_path}/check2", None)
    with pytest.raises(Exception, match="published by another writer"):
        other.awaitTermination()
    assert store.latest() == 2


def test_the_slower_of_two_writers_loses(spark, tmp_path, monkeypatch):
    store, rival = (snapshot.SnapshotStore(spark, f"{tmp_path}/store") for _ in range(2))
    store.publish({"t": spark.range(1)})
    whole = store.replace

    def late(name, text):
        whole(name, text)
        if name.startswith("manifest"):
            monkeypatch.setattr(store, "replace", whole)
            rival.publish({"t": spark.range(5)})

    monkeypatch.setattr(store, "replace", late)
    with pytest.raises(snapshot.Conflict):
        store.publish({"t": spark.range(3)})
    assert store.latest() == 2 and store.current()["t"].count() == 5
    assert store.publish({"t": spark.range(4)}) and store.current()["t"].count() == 4


class Plain:
    """Reconciliation with plain sets."""

    def __init__(self, prefixes, limits):
        self.prefixes, self.limits, self.pending, self.next, self.cursors, self.sweeps = prefixes, limits, {}, 0, [None, None], [None, None]

    def run(self, objects, protected, now):
        self.pending = {p: t for p, t in self.pending.items() if p not in protected}
        gone = sorted((t, p) for p, t in self.pending.items() if now - t >= self.limits.grace)[: self.limits.delete]
        for _, p in gone:
            del self.pending[p]
            objects.discard(p)
        for _ in range(2):
            room = self.limits.pending - len(self.pending)
            if room <= 0:
                break
            k = self.next
            rest = sorted(p for p in objects if p.startswith(self.prefixes[k] + "/") and (self.cursors[k] is None or p > self.cursors[k]))
            page = rest[: min(self.limits.page, room)]
            for p in page:
                if p not in protected:
                    self.pending.setdefault(p, now)
            self.cursors[k] = page[-1] if len(rest) > len(page) else None
            if self.cursors[k] is None:
                self.sweeps[k] = now
            self.next = 1 - k
        return {p for _, p in gone}


def test_reconciliation_replays_like_plain_python(spark, tmp_path):
    rng = random.Random(12)
    prefixes, limits = ("assets", "frames"), reconcile.Limits(grace=20.0, pending=18, page=7, delete=5)
    own = reconcile.Reconciler(spark, f"{tmp_path}/state", prefixes, limits)
    plain = Plain(prefixes, limits)
    objects = {f"{rng.choice(['assets', 'frames', 'else'])}/{i:03d}" for i in range(40)}
    mirror = set(objects)
    for run in range(7):
        now = 100.0 + 9 * run
        protected = {p for p in objects if rng.random() < 0.4}
        fresh = {f"frames/{200 + 5 * run + j}" for j in range(2)}
        objects |= fresh
        mirror |= fresh
        table = lambda x: spark.createDataFrame([(p,) for p in sorted(x)], "path string")
        out = own.run(table(mirror), table(protected), now)
        got = {r["path"] for r in out.deleted.collect()}
        mirror -= got
        assert got == plain.run(objects, protected, now)
        assert {(r["path"], r["seen"]) for r in own.state(now)[0].collect()} == set(plain.pending.items())
        assert (out.progress.next, out.progress.cursors, out.progress.sweeps) == (plain.next, plain.cursors, plain.sweeps)
    assert mirror == objects and any(p.startswith("else/") for p in objects)


def test_a_state_that_makes_no_sense_starts_anew(spark, tmp_path):
    own = reconcile.Reconciler(spark, f"{tmp_path}/state", ("a", "b"))
    own.store.publish({"pending": spark.createDataFrame([("a/1", 5.0)], reconcile.PENDING), "progress": spark.createDataFrame([('{"next": 7}',)], "body string")})
    pending, progress = own.state(10.0)
    assert pending.count() == 0 and progress == reconcile.Progress()


def test_last_good_over_batches_with_a_busy_source(spark, tmp_path):
    rng = random.Random(17)
    schema = "source string, run long, ok boolean, payload string"
    rows = [("busy" if rng.random() < 0.6 else f"s{rng.randint(0, 5)}", i, rng.random() < 0.4, rng.choice([f"p{i}", None])) for i in range(300)]
    table = keyed.KeyedTable(spark, f"{tmp_path}/state", "source", "source string, run long, payload string", 4)
    for n in range(2):
        files(spark, f"{tmp_path}/in/run{n}", [rows[n * 150 : n * 150 + 60], rows[n * 150 + 60 : n * 150 + 150]], schema)
        keyed.last_good(read_stream(spark, f"{tmp_path}/in", schema), table, f"{tmp_path}/sink", f"{tmp_path}/check")
    last, want = {}, []
    for source, run, ok, payload in rows:
        if ok:
            last[source] = payload
        want.append((source, run, "ok" if ok else "stale" if source in last else "unavailable", last.get(source)))
    got = spark.read.schema("source string, run long, status string, payload string").parquet(f"{tmp_path}/sink/*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_previous_snapshot_must_be_valid(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"{tmp_path}/store")
    assert store.previous(lambda tables: None) == (None, None)
    store.publish({"t": spark.range(3)})
    tables, n = store.previous(lambda tables: None)
    assert n == 1 and tables["t"].count() == 3

    def short(tables):
        if tables["t"].count() < 9:
            raise ValueError("collapsed")

    assert store.previous(short) == (None, 1)
    store.replace("commits/00000001.json", "{")
    assert store.previous(lambda tables: None) == (None, 1)
