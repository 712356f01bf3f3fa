"""Versions of fitted models on any file system that Hadoop reaches.

A model is saved in a folder of its own; then an entry of the model's log makes it a version. Entries are
numbered, and an entry appears whole under its number or not at all, so that of two writers one comes first and the other
takes the next number. What is registered, and in which stage, is a table computed from the log."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .learners import Fitted

#: The stages of a version.
STAGES = ("development", "staging", "production", "archived")
DELETED = "deleted"
LOG = (
    "seq long, name string, action string, version int, moves array<struct<version:int,stage:string>>, path string, kind string, "
    "row_id string, target string, features array<string>, metrics map<string,double>, tags map<string,string>, note string"
)


@dataclass(frozen=True)
class ModelStore:
    """Models under the folder ``root``. The rename that commits an entry doesn't overwrite, which is atomic on HDFS; on a
    local disk it is a hard link. An object store without an atomic rename needs one writer at a time."""

    spark: SparkSession
    root: str

    def _at(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _files(self) -> Any:
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self, name: str, seq: int, entry: dict[str, Any]) -> bool:
        """Whether the entry now has the number; False if another one does."""
        files, jvm = self._files(), self.spark._jvm
        aside, final = self._at(name, "aside", uuid.uuid4().hex), self._at(name, "log", f"{seq:010d}.json")
        files.mkdirs(final.getParent())
        out = files.create(aside, False)
        out.write(bytearray(json.dumps({"seq": seq, "name": name} | entry).encode()))
        out.close()
        try:
            if files.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), final.toUri().getPath())
                return True
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # nothing: don't overwrite
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)
            return True
        except Exception:
            if files.exists(final):
                return False
            raise
        finally:
            files.delete(aside, False)

    def _commit(self, name: str, entry: Callable[[list], dict[str, Any]]) -> dict[str, Any]:
        """Adds what ``entry`` makes of the log so far, again if someone else was first."""
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", name):
            raise ValueError(f"{name!r} is no name of letters, digits, dots, dashes and underscores")
        while True:
            known = self.log(name).select("seq", "version", "action", "moves").orderBy("seq").collect()  # a row a change
            new = entry(known)
            if self._claim(name, (known[-1]["seq"] if known else 0) + 1, new):
                return new

    def log(self, name: str | None = None) -> DataFrame:
        """Every change, of one model or of all; no rows if there is none."""
        files = self._files()
        folder = self._at(name or "*", "log")
        if not files.globStatus(folder):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(folder.toString())

    def register(self, name: str, fitted: Fitted, metrics: dict[str, float] | None = None, tags: dict[str, str] | None = None, note: str = "") -> int:
        """Saves ``fitted`` as the next version of ``name``, in the stage development, and returns its number. Numbers of
        deleted versions aren't given again."""
        path = self._at(name, "models", uuid.uuid4().hex).toString()

        def entry(known: list) -> dict[str, Any]:
            v = 1 + sum(r["action"] == "register" for r in known)
            said = {"kind": fitted.kind, "row_id": fitted.row_id, "target": fitted.target, "features": list(fitted.features)}
            return {"action": "register", "version": v, "moves": [{"version": v, "stage": STAGES[0]}], "path": path, "metrics": metrics or {}, "tags": tags or {}, "note": note} | said

        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", name):
            raise ValueError(f"{name!r} is no name of letters, digits, dots, dashes and underscores")
        fitted.model.write().save(path)
        return self._commit(name, entry)["version"]

    @staticmethod
    def _stages(known: list) -> dict[int, str]:
        return {m["version"]: m["stage"] for r in known for m in r["moves"]}

    def set_stage(self, name: str, version: int, stage: str) -> None:
        """Moves a version to a stage. One version is in production: the one that was is archived in the same change."""
        if stage not in STAGES:
            raise ValueError(f"no stage {stage}")

        def entry(known: list) -> dict[str, Any]:
            now = self._stages(known)
            if now.get(version, DELETED) == DELETED:
                raise KeyError(f"no version {version} of {name}")
            moves = [{"version": version, "stage": stage}]
            if stage == "production":
                moves += [{"version": v, "stage": "archived"} for v, s in sorted(now.items()) if s == stage and v != version]
            return {"action": "stage", "version": version, "moves": moves}

        self._commit(name, entry)

    def delete(self, name: str, version: int) -> None:
        """Takes a version off, then its files. The log keeps that it was there."""

        def entry(known: list) -> dict[str, Any]:
            if self._stages(known).get(version, DELETED) == DELETED:
                raise KeyError(f"no version {version} of {name}")
            return {"action": "delete", "version": version, "moves": [{"version": version, "stage": DELETED}]}

        path = self.log(name).filter((F.col("action") == "register") & (F.col("version") == version)).select("path").first()
        self._commit(name, entry)
        self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(path[0]), True)

    def cleanup(self, name: str, keep: int = 3) -> list[int]:
        """Deletes all versions but the latest ``keep`` and those in staging or production; the numbers deleted."""
        rows = self.models(name).select("version", "stage").orderBy(F.desc("version")).collect()  # a row a version
        gone = [r["version"] for r in rows[keep:] if r["stage"] not in ("staging", "production")]
        for v in gone:
            self.delete(name, v)
        return gone

    def models(self, name: str | None = None) -> DataFrame:
        """(name, version, stage, metrics, tags, note, path, kind, row_id, target, features): a row a version that isn't deleted."""
        log = self.log(name)
        moved = log.select("name", "seq", F.explode("moves").alias("m")).groupBy("name", F.col("m.version").alias("version")).agg(F.max_by("m.stage", "seq").alias("stage"))
        said = log.filter("action = 'register'").drop("seq", "action", "moves")
        out = said.join(moved, ["name", "version"]).filter(F.col("stage") != DELETED)
        return out.select("name", "version", "stage", "metrics", "tags", "note", "path", "kind", "row_id", "target", "features")

    def search(self, stage: str | None = None, tags: dict[str, str] | None = None, at_most: dict[str, float] | None = None, at_least: dict[str, float] | None = None) -> DataFrame:
        """``models`` in the stage, with all of the tags, and with metrics within the bounds; a version without a bounded metric isn't found."""
        met: Column = F.lit(True) if stage is None else F.col("stage") == stage
        for k, v in (tags or {}).items():
            met = met & (F.col("tags")[k] == v)
        for k, v in (at_most or {}).items():
            met = met & (F.col("metrics")[k] <= v)
        for k, v in (at_least or {}).items():
            met = met & (F.col("metrics")[k] >= v)
        return self.models().filter(met)

    def load(self, name: str, version: int | None = None, stage: str | None = None) -> Fitted:
        """The version, or the latest one in the stage, or the latest."""
        found = self.models(name)
        if version is not None:
            found = found.filter(F.col("version") == version)
        if stage is not None:
            found = found.filter(F.col("stage") == stage)
        row = found.orderBy(F.desc("version")).first()
        if row is None:
            raise KeyError(f"no such version of {name}")
        return Fitted(PipelineModel.load(row["path"]), row["kind"], row["row_id"], row["target"], tuple(row["features"]))
