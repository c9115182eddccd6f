"""Kept results of a job's stages, and when they can be taken again.

Each stage's table lies in a folder beside a manifest: the files it was made from, with
their lengths and times, its parameters, and the fingerprints of the stages before it. A
stage is read back if its manifest is the one a run would write now, else made anew. A stage
that the caller names as given is never made: it is taken, or refused if it is stale.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


class StaleStage(ValueError):
    """A given stage that is missing, or was made from other files, parameters or stages."""


class Stages:
    """Stages by name; ``folder`` None keeps nothing, and nothing can be given then."""

    def __init__(self, spark: SparkSession, folder: str | None, given: Sequence[str] = ()):
        if given and not folder:
            raise ValueError("stages can be given only with a folder that holds them")
        self.spark, self.folder, self.given = spark, folder and folder.rstrip("/"), set(given)
        self.plans: dict[str, tuple[dict, Callable[[], DataFrame]]] = {}
        self.tables: dict[str, DataFrame] = {}
        self.made: list[str] = []

    def add(
        self,
        name: str,
        build: Callable[[], DataFrame],
        *,
        sources: Mapping[str, str | Sequence[str] | None] | None = None,
        params: Mapping | None = None,
        after: Sequence[str] = (),
    ) -> None:
        """Declare a stage. ``sources``: paths by role, None where the caller has none; ``after``: stages it reads."""
        files = {role: self._files(paths) for role, paths in (sources or {}).items()} if self.folder else {}
        self.plans[name] = ({"stage": name, "sources": files, "params": dict(params or {}), "after": {a: self._print(a) for a in after}}, build)

    def table(self, name: str) -> DataFrame:
        """The stage's table: as kept, or made now."""
        if name not in self.tables:
            self.tables[name] = self._take(name)
        return self.tables[name]

    def _take(self, name: str) -> DataFrame:
        plan, build = self.plans[name]
        if not self.folder:
            return build()
        kept = self._manifest(name)
        path = f"{self.folder}/{name}"
        if name in self.given:
            fault = "it is not there" if kept is None else self._fault(plan, kept)
            if fault:
                raise StaleStage(f"stage {name!r} can't be taken as given: {fault}")
        elif kept != json.loads(json.dumps(plan)):
            self._drop(name)
            build().write.mode("overwrite").parquet(path)
            # Last: a table without its manifest is an unfinished one.
            self._write(name, plan)
            self.made.append(name)
        return self.spark.read.parquet(path)

    def _fault(self, plan: dict, kept: dict) -> str | None:
        """Why a kept stage isn't the given one; what the caller has no path for isn't asked."""
        plan = json.loads(json.dumps(plan))
        for role, files in plan["sources"].items():
            if files is not None and kept["sources"].get(role) != files:
                return f"{role} has changed"
        for key, value in plan["params"].items():
            if kept["params"].get(key) != value:
                return f"{key} was {kept['params'].get(key)!r}"
        for stage, fingerprint in plan["after"].items():
            if fingerprint is not None and kept["after"].get(stage) != fingerprint:
                return f"stage {stage!r} has changed"
        return None

    def _print(self, name: str) -> str | None:
        """Fingerprint of a stage; of a given one, or one whose files the caller lacks, that of what is kept."""
        plan = self.plans[name][0]
        lacking = any(files is None for files in plan["sources"].values()) or None in plan["after"].values()
        if self.folder and (name in self.given or lacking):
            kept = self._manifest(name)
            if kept is None:
                return None
            plan = kept
        return hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()

    def _path(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self, paths: str | Sequence[str] | None) -> list | None:
        """[path, length, modification time] of all files below some paths."""
        if paths is None:
            return None
        found = []
        for path in [paths] if isinstance(paths, str) else paths:
            place, fs = self._path(path)
            files = fs.listFiles(place, True)
            while files.hasNext():
                file = files.next()
                if not file.getPath().getName().startswith(("_", ".")):
                    found.append([file.getPath().toString(), file.getLen(), file.getModificationTime()])
        return sorted(found)

    def _manifest(self, name: str) -> dict | None:
        place, fs = self._path(f"{self.folder}/{name}.json")
        return json.loads(self.spark.read.text(place.toString(), wholetext=True).first()[0]) if fs.exists(place) else None

    def _drop(self, name: str) -> None:
        place, fs = self._path(f"{self.folder}/{name}.json")
        fs.delete(place, False)

    def _write(self, name: str, plan: dict) -> None:
        place, fs = self._path(f"{self.folder}/{name}.json")
        out = fs.create(place, True)
        out.write(bytearray(json.dumps(plan, sort_keys=True).encode()))
        out.close()
