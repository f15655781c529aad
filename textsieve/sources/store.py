"""Models on disk, in versions that are either whole or not there.

A version is a folder of tables and a manifest with each table's schema and number of rows. The manifest is written under
another name and gets its own last, which is the commit: a folder without one is never read. Loading compares every table
with the manifest.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from textsieve.sources import readers

MANIFEST = "manifest.json"


class ModelStore:
    """path may lie in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._system = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _folders(self, below: str = "") -> list[str]:
        """Names of version folders, oldest first; with `below` of those that hold it."""
        found = self._system.globStatus(self._at("v*", below) if below else self._at("v*"))
        names = [(f.getPath().getParent() if below else f.getPath()).getName() for f in found or []]
        return sorted((n for n in names if re.fullmatch(r"v\d+-\w+", n)), key=lambda n: (int(n[1:].split("-")[0]), n))

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        return self._folders(MANIFEST)

    def save(self, tables: dict[str, DataFrame], about: dict | None = None) -> str:
        """Writes a new version and returns its name. about: anything that JSON holds."""
        last = self._folders()
        version = f"v{int(last[-1][1:].split('-')[0]) + 1 if last else 1}-{uuid.uuid4().hex[:8]}"
        said = {}
        for name, df in tables.items():
            where = f"{self.path}/{version}/{name}"
            df.write.parquet(where)
            said[name] = {"rows": self.spark.read.schema(df.schema).parquet(where).count(), "schema": json.loads(df.schema.json())}
        readers.write_file(self.spark, f"{self.path}/{version}/{MANIFEST}.part", json.dumps({"tables": said, "about": about or {}}, ensure_ascii=False))
        if not self._system.rename(self._at(version, f"{MANIFEST}.part"), self._at(version, MANIFEST)):
            raise OSError(f"{version} could not be committed")
        return version

    def load(self, version: str | None = None) -> tuple[dict[str, DataFrame], dict]:
        """(tables, about) of a committed version, the newest by default. ValueError where a table is not as the manifest says."""
        known = self.versions()
        version = version or (known[-1] if known else None)
        if version not in known:
            raise FileNotFoundError(f"no committed version {version or ''} in {self.path}")
        manifest = json.loads(readers.read_file(self.spark, f"{self.path}/{version}/{MANIFEST}"))
        tables = {}
        for name, said in manifest["tables"].items():
            where = f"{self.path}/{version}/{name}"
            if not readers.exists(self.spark, where):
                raise ValueError(f"{version} lacks the table {name}")
            tables[name] = self.spark.read.schema(StructType.fromJson(said["schema"])).parquet(where)
            if (rows := tables[name].count()) != said["rows"]:
                raise ValueError(f"{name} of {version} has {rows} rows in place of {said['rows']}")
        return tables, manifest["about"]
