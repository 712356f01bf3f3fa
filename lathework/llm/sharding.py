"""Operator 2: sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards of similar size
(one power of ``fan`` apart) form a tier; when a tier has at least ``fan``
shards that are under the target size, they are merged, without a shuffle, into
files of about the target size (the scan packs shards by bytes). What counts as
the table is said by a versioned manifest alone: a JSON file that is written
aside and then given its name by an operation that fails if the name is taken: a
hard link on a local disk, a rename without overwriting elsewhere, which is
atomic on HDFS. (An object store whose rename isn't atomic needs one writer at a
time.) A writer that loses the race commits again on top of the winner; a merge
whose shards the winner has merged already is dropped.

Files that no manifest names any more are removed by ``vacuum``, but only those
older than ``older_than`` seconds, as a writer may still be about to commit
younger ones. Manifests of removed versions go with them.

Cases: an empty arrival commits a version without new shards; reading a store
without shards gives an empty table of the store's schema; reading a version
that was vacuumed raises ``Gone``; repeated rows and nulls are stored as they are;
any columns are allowed; an arrival's new ones join the store's schema (null in the rows before), those
it lacks are null in it, and one of another type raises ``SchemaMismatch`` before anything is written.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs, shared_dir


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class Gone(LookupError):
    """The version's files were removed by ``vacuum``."""


class SchemaMismatch(TypeError):
    """An arrival's column has another type than the store's, or its name in other letters."""


class ShardStore:
    """A table of shards under ``root``, which any Hadoop file system may hold."""

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan: int = 4, least: int = 1 << 20) -> None:
        self.spark, self.root, self.target, self.fan, self.least = spark, root.rstrip("/"), target, fan, least
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        # A session whose scans pack files by bytes alone, up to the target size.
        self._merger = spark.newSession()
        for name, value in {"files.maxPartitionBytes": target, "files.openCostInBytes": 0, "files.minPartitionNum": 1}.items():
            self._merger.conf.set(f"spark.sql.{name}", str(value))

    def version(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"schema": ..., "shards": [...]} of a version, the latest by default."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "shards": []}
        path = self._path(f"{self.root}/manifests/v{version:09d}.json")
        if not self._fs.exists(path):
            raise Gone(f"version {version} doesn't exist or was vacuumed; the latest is {self.version()}")
        stream = self._fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return {"schema": found["schema"], "shards": [Shard(**s) for s in found["shards"]]}

    def commit(self, version: int, schema: str | None, shards: Iterable[Shard]) -> int:
        """Writes ``version`` aside and gives it its name, or raises ``Conflict``."""
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifests/v{version:09d}.json")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        try:
            if not self._named(aside, final):
                raise Conflict(f"version {version} exists")
        finally:
            self._fs.delete(aside, False)
        return version

    def _named(self, aside, final) -> bool:
        """Gives ``aside`` the name ``final`` unless that is taken."""
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # nothing: don't overwrite
        try:
            files.rename(aside, final, options)
        except Exception as e:  # noqa: BLE001
            if self._fs.exists(final):
                return False
            raise e
        return True

    def _write(self, df: DataFrame) -> list[Shard]:
        """Writes new shards and describes them; nobody sees them before a commit."""
        path = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.parquet(path)
        meta = self.spark.read.schema(df.schema).parquet(path).select("_metadata.file_path", "_metadata.file_size")
        found = meta.groupBy("file_path", "file_size").count().collect()  # a row a file
        return sorted((Shard(r[0], r[1], r[2]) for r in found), key=lambda s: s.path)

    def append(self, df: DataFrame) -> int:
        """An arrival becomes small shards of a new version, on top of whatever
        other writers commit meanwhile. New columns join the store's schema, and those
        that an arrival lacks are null in it; a column of another type is an error."""
        evolved(self.manifest()["schema"], df.schema)
        new = self._write(df)
        while True:
            now = self.version()
            old = self.manifest(now)
            try:
                return self.commit(now + 1, evolved(old["schema"], df.schema).json(), [*old["shards"], *new])
            except Conflict:
                continue

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found["schema"] is None:
            return self.spark.createDataFrame([], T.StructType())
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        return self._load([s.path for s in found["shards"]], schema)

    def _load(self, paths: list[str], schema: T.StructType, session: SparkSession | None = None) -> DataFrame:
        session = session or self.spark
        return session.read.schema(schema).parquet(*paths) if paths else session.createDataFrame([], schema)

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.size, 1) / self.least, self.fan))) if shard.size > self.least else 0

    def compact(self, force: bool = False) -> int:
        """One round: every tier with ``fan`` shards or more (two with ``force``)
        is merged into target-sized files. Returns the version; unchanged if
        there was nothing to merge."""
        now = self.version()
        found = self.manifest(now)
        schema = found["schema"] and T.StructType.fromJson(json.loads(found["schema"]))
        tiers: dict[int, list[Shard]] = {}
        for s in found["shards"]:
            if s.size < self.target * 3 // 4:
                tiers.setdefault(-1 if force else self.tier(s), []).append(s)
        merged: list[Shard] = []
        gone: set[str] = set()
        for _, run in sorted(tiers.items()):
            if len(run) < (2 if force else self.fan) or math.ceil(sum(s.size for s in run) / self.target) >= len(run):
                continue
            merged += self._write(self._load([s.path for s in run], schema, self._merger))
            gone |= {s.path for s in run}
        while merged:
            here = {s.path for s in found["shards"]}
            if not gone <= here:  # merged by another writer; vacuum removes ours
                return now
            try:
                return self.commit(now + 1, found["schema"], [*(s for s in found["shards"] if s.path not in gone), *merged])
            except Conflict:
                now = self.version()
                found = self.manifest(now)
        return now

    def vacuum(self, older_than: float = 86_400) -> int:
        """Removes shard files that the latest manifest doesn't name and that are
        older than ``older_than`` seconds, and the manifests that name them."""
        latest = self.version()
        named = {s.path.rpartition("/shards/")[2] for s in self.manifest(latest)["shards"]}
        oldest = (time.time() - older_than) * 1000
        removed: set[str] = set()
        top = self._path(f"{self.root}/shards")
        for folder in self._fs.listStatus(top) if self._fs.exists(top) else []:
            for f in self._fs.listStatus(folder.getPath()):
                name = f"{folder.getPath().getName()}/{f.getPath().getName()}"
                if name.endswith(".parquet") and name not in named and f.getModificationTime() <= oldest:
                    removed.add(name)
        for version in range(1, latest):
            path = self._path(f"{self.root}/manifests/v{version:09d}.json")
            if removed and self._fs.exists(path) and not removed.isdisjoint(s.path.rpartition("/shards/")[2] for s in self.manifest(version)["shards"]):
                self._fs.delete(path, False)  # before its files, so that no reader finds half a version
        return sum(bool(self._fs.delete(self._path(f"{self.root}/shards/{name}"), False)) for name in sorted(removed))


def evolved(known: str | None, arrived: T.StructType) -> T.StructType:
    """The stored schema (JSON, none at first) with an arrival's new columns, all nullable."""
    fields = [T.StructField(f.name, f.dataType, True) for f in arrived]
    if known is None:
        return T.StructType(fields)
    held = T.StructType.fromJson(json.loads(known))
    types = {f.name.lower(): f for f in held}
    for f in fields:
        old = types.get(f.name.lower())
        if old is None:
            held = held.add(f)
        elif old.name != f.name or old.dataType.simpleString() != f.dataType.simpleString():
            raise SchemaMismatch(f"column {f.name} is {f.dataType.simpleString()}, the store has {old.name} {old.dataType.simpleString()}")
    return held


def compacted(table: DataFrame, root: str, arrivals: int = 4, **options) -> ShardStore:
    """A store that has taken ``table`` in ``arrivals`` appends and is compacted.
    Nobody else writes to it, so that files may go as soon as they are merged."""
    store = ShardStore(table.sparkSession, root, **options)
    for k in range(arrivals):
        store.append(table.filter(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum(older_than=0)
    store.compact(force=True)
    store.vacuum(older_than=0)
    return store


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back through the last manifest."""
    store = compacted(docs(spark, sf_dir), f"{shared_dir(spark)}/lathework-{uuid.uuid4().hex}/store", target=32 << 20)
    out = store.read()
    return out.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
