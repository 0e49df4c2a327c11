"""Snapshot store: content-addressed payloads, manifests, numbered commits, incremental reuse and sweeping."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(*columns: str) -> Column:
    """JSON of the columns in sorted order, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def addressed(df: DataFrame, payload: Column) -> DataFrame:
    """path, bytes, payload, once per content."""
    rows = df.select(payload.alias("payload"))
    return rows.groupBy(F.sha2("payload", 256).alias("_h")).agg(F.first("payload").alias("payload")).select(F.concat(F.lit("assets/"), F.substring("_h", 1, 20), F.lit(".json")).alias("path"), F.octet_length("payload").alias("bytes"), "payload")


def envelopes(rows: DataFrame, group: str, item: str, order: str, items: str, budget: int) -> DataFrame:
    """group, path, bytes, payload: the JSON items of each group as one addressed document {count, <items>, sourceCount}.

    A document is one file, so groups must be small; one over the budget fails the write instead of being cut.
    """
    n = F.count(F.lit(1)).cast("string")
    listed = F.array_join(F.array_sort(F.collect_list(F.struct(order, item)))[item], ",")
    made = rows.groupBy(group).agg(F.concat(F.lit('{"count":'), n, F.lit(f',"{items}":['), listed, F.lit('],"sourceCount":'), n, F.lit("}")).alias("payload"))
    size = F.octet_length("payload")
    checked = F.when(size <= budget, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a document is over its budget: "), size)))
    named = made.select(group, checked.alias("payload")).withColumn("path", F.concat(F.lit("assets/"), F.substring(F.sha2("payload", 256), 1, 20), F.lit(f"/{items}.json")))
    return named.select(group, "path", F.octet_length("payload").alias("bytes"), "payload")


class Conflict(RuntimeError):
    """Another writer published the snapshot first."""


class Folder:
    """Small files below a root: replaced atomically, claimed by one writer only, listed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _move(self, name: str, text: str, *options) -> None:
        target, temp = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/.{name.replace('/', '-')}.{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(target.getParent())
        fs = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), len(options))
        for i, option in enumerate(options):
            how[i] = option
        try:
            fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, target, how)
        finally:
            self.fs.delete(temp, False)  # nothing is there after a rename

    def replace(self, name: str, text: str) -> None:
        """Readers see the old file or the new one."""
        self._move(name, text, getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE)

    def claim(self, name: str, text: str) -> bool:
        """Whether the file was made by this call. Atomic where the file system's rename is (HDFS), so of several
        writers one succeeds; the local file system checks first."""
        try:
            self._move(name, text)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False
        return True

    def text(self, name: str) -> str | None:
        target = self.path(f"{self.root}/{name}")
        if not self.fs.exists(target):
            return None
        rows = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return rows[0][0] if rows else None

    def names(self, folder: str) -> list[str]:
        """Names of the files of a folder, hidden ones left out, in order."""
        where = self.path(f"{self.root}/{folder}")
        found = [f.getPath().getName() for f in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(n for n in found if not n.startswith("."))


def write_status(folder: Folder, status: DataFrame, name: str = "status.json") -> bool:
    """Replace the status document by the one row of status; whether it could be written. A run's result stands without
    its status, so a failure of the store is told and not raised."""
    body = status.select(canonical(*status.columns).alias("body")).first()["body"]
    try:
        folder.replace(name, body)
    except Py4JJavaError:
        return False
    return True


class SnapshotStore(Folder):
    """Tables published under one root. A snapshot is there once its commit is: commits are numbered files that only one
    writer can make, so two writers that saw the same snapshot cannot both follow it. The pointer is a copy for readers
    outside."""

    def latest(self) -> int:
        """Number of the newest snapshot, 0 before the first."""
        names = self.names("commits")
        return int(names[-1].split(".")[0]) if names else 0

    def publish(self, tables: dict[str, DataFrame], number: int | None = None, token: str | None = None) -> str:
        """Write all tables, then the manifest, then the commit, then the pointer; returns the version.

        number, as from a batch id, is the snapshot to make, else the next one. token names the attempt: a repeated
        attempt that was published already returns its version and writes nothing; one that is beaten to its number, or
        comes for a number already passed, raises Conflict. Tables lie in a folder of the token, so writers never mix.
        """
        token = token or uuid.uuid4().hex
        newest = self.latest()
        n = newest + 1 if number is None else number
        if (done := self.text(f"commits/{n:08d}.json")) is not None:
            if json.loads(done)["token"] != token:
                raise Conflict(f"snapshot {n} was published by another writer")
            return json.loads(done)["version"]
        if n <= newest:
            raise Conflict(f"snapshot {n} is older than snapshot {newest}")
        own = hashlib.sha256(token.encode()).hexdigest()[:12]
        parts = {name: f"data/{n:08d}-{own}/{name}" for name in tables}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{parts[name]}")
        body = json.dumps({"n": n, "tables": parts}, sort_keys=True)
        version = hashlib.sha256(body.encode()).hexdigest()[:20]
        self.replace(f"manifest-{version}.json", body)
        if not self.claim(f"commits/{n:08d}.json", json.dumps({"version": version, "token": token})):
            raise Conflict(f"snapshot {n} was published by another writer")
        self.replace("pointer.json", json.dumps({"n": n, "version": version}))
        return version

    def previous(self, valid) -> tuple[dict[str, DataFrame] | None, int | None]:
        """What the next run goes on from: the newest snapshot and its number. If valid(tables) raises ValueError, or a
        file of it is lost or no JSON, there are no tables, but the number is still told; (None, None) before the first."""
        n = self.latest() or None
        if n is None:
            return None, None
        try:
            tables = self.current()
            valid(tables)
        except (AnalysisException, TypeError, ValueError):
            return None, n
        return tables, n

    def current(self) -> dict[str, DataFrame]:
        """Tables of the published snapshot; empty before the first."""
        n = self.latest()
        if not n:
            return {}
        manifest = json.loads(self.text(f"manifest-{json.loads(self.text(f'commits/{n:08d}.json'))['version']}.json"))
        return {name: self.spark.read.parquet(f"{self.root}/{p}") for name, p in manifest["tables"].items()}


def to_recompute(planned: DataFrame, previous: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """Planned keys that are new or whose version columns differ, null-safe."""
    old = previous.select(key, *[F.col(v).alias(f"_{v}") for v in versions], F.lit(True).alias("_seen"))
    same = F.lit(True)
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return planned.join(old, key, "left").where(F.col("_seen").isNull() | ~same).select(*planned.columns)


def sweep(known: DataFrame, referenced: DataFrame, key: str, seen: str, now: int, grace: int, most: int) -> DataFrame:
    """Unreferenced keys first seen at least grace ago, oldest first, at most `most` in a run (a feature of sweeping)."""
    idle = known.join(referenced.select(key).distinct(), key, "left_anti").where(F.lit(now) - F.col(seen) >= grace)
    return idle.orderBy(seen, key).limit(most)
