"""Incremental scans: signatures decide what is derived again, versions decide what readers see.

The engine has no streams. A dataset's derived partitions carry the signature of everything they depend on (file
hashes, the parts of cards that count, code version); partitions whose signature is unchanged are kept. A scan
writes a new version folder and publishes it last, by one marker file; a failed scan publishes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stable_hash(value: Any) -> str:
    """Hash of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:32]


def signatures(manifest: DataFrame, by: list[str], depends: str) -> DataFrame:
    """``by, signature``: a hash of the group's files (paths and contents) and of ``depends``."""
    files = F.array_sort(F.collect_list(F.concat_ws("|", "path", "hash")))
    return manifest.groupBy(*by).agg(F.sha2(F.concat_ws("\n", files, F.lit(depends)), 256).alias("signature"))


def stale(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Groups to derive again: new ones and those whose signature changed."""
    return new.join(old, [*by, "signature"], "left_anti").select(*by)


def removed(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose files have all gone."""
    return old.join(new, by, "left_anti").select(*by)


def refreshed(table: DataFrame, derived: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    """A table with the rows of derived and removed groups replaced."""
    out = derived.select(*by).distinct().unionByName(gone.select(*by))
    return table.join(out, by, "left_anti").unionByName(derived)


class Versions:
    """Version folders below ``root``, on any file system that Spark writes to.

    A version counts once its folder holds the marker ``_PUBLISHED``, which is made last and at once; a scan that
    fails or is cancelled leaves an unmarked folder that nobody reads.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._files.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.root))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def current(self) -> str | None:
        """The latest published version's folder."""
        for n in reversed(self._versions()):
            if self._files.exists(self._path(f"{self.root}/v{n}/_PUBLISHED")):
                return f"{self.root}/v{n}"
        return None

    def begin(self) -> str:
        path = f"{self.root}/v{max(self._versions(), default=0) + 1}"
        if not self._files.mkdirs(self._path(path)):
            raise RuntimeError(f"{path} can't be made")
        return path

    def publish(self, path: str, tables: Iterable[str]) -> None:
        """Marks the version at ``path`` if all its tables were written completely."""
        for t in tables:
            if not self._files.exists(self._path(f"{path}/{t}/_SUCCESS")):
                raise RuntimeError(f"{t} is incomplete; nothing is published")
        if not self._files.createNewFile(self._path(f"{path}/_PUBLISHED")):
            raise RuntimeError(f"{path} is published already")

    def incomplete(self) -> list[str]:
        """Folders of scans that never ended."""
        return [f"{self.root}/v{n}" for n in self._versions() if not self._files.exists(self._path(f"{self.root}/v{n}/_PUBLISHED"))]
