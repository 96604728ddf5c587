"""Tables that change together: versions of Parquet folders, committed by one manifest.

A run starts from the last committed version, writes each new table to a folder of its own and commits all of them at
once: the manifest, which names the folder and schema of every table, is written aside and renamed to the next version's
name. A rename that finds the name taken fails, so of two runs from one version only one commits. Readers see whole
versions: a run that ends before its commit leaves folders that no manifest names, and nothing else. ``vacuum`` drops
versions and folders that are no longer wanted.

The folder must be on a file system that driver and executors share and that renames atomically.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Snapshots:
    """The versions below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        return sorted(int(name[1:-5]) for name in self._names("manifest") if name.startswith("v") and name.endswith(".json"))

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """Folder and schema of each table of a version, of the last one by default; none before the first commit."""
        found = self.versions()
        if not found and version is None:
            return {}
        stream = self._files().open(self._path(self._manifest(found[-1] if version is None else version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version, or None where that has none of this name."""
        return self._open(self.tables(version).get(name))

    def draft(self) -> Draft:
        return Draft(self)

    def vacuum(self, keep: int = 1) -> int:
        """Drops all but the last ``keep`` versions and the folders that none of these names; gives their number.

        No run may be under way, as the folders of an open draft are named by no manifest.
        """
        files, found = self._files(), self.versions()
        kept = found[-keep:] if keep else []
        for version in found[: len(found) - len(kept)]:
            files.delete(self._path(self._manifest(version)), False)
        used = {entry["folder"] for version in kept for entry in self.tables(version).values()}
        dropped = 0
        for name in self._names("data"):
            if not any(folder.startswith(f"data/{name}/") for folder in used):
                dropped += files.delete(self._path(f"data/{name}"), True)
        return dropped

    def _open(self, entry: dict | None) -> DataFrame | None:
        if entry is None:
            return None
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.folder}/{entry['folder']}")

    def _manifest(self, version: int) -> str:
        return f"manifest/v{version:010d}.json"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        return [s.getPath().getName() for s in self._files().globStatus(self._path(f"{part}/*")) or []]


class Draft:
    """A version in the making. Tables that it does not put stay as they were in the version from which it starts."""

    def __init__(self, state: Snapshots):
        self.state, self.run = state, uuid.uuid4().hex
        self.base = max(state.versions(), default=0)
        self.entries = state.tables(self.base) if self.base else {}

    def read(self, name: str) -> DataFrame | None:
        return self.state._open(self.entries.get(name))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table of this draft, in a folder of its own each time, and reads it back."""
        folder = f"data/{self.run}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.state.folder}/{folder}")
        self.entries[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
        return self.read(name)

    def commit(self) -> int:
        """Makes this draft the next version and gives its number; fails if another one was committed meanwhile."""
        state, number = self.state, self.base + 1
        jvm = state.spark._jvm
        aside = state._path(f"manifest/draft-{self.run}")
        out = state._files().create(aside, True)
        try:
            out.write(bytearray(json.dumps(self.entries).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), state.spark._jsc.hadoopConfiguration())
        never = state.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, state._path(state._manifest(number)), never)
        except Exception as error:
            state._files().delete(aside, False)
            raise RuntimeError(f"version {number} was committed by another run") from error
        return number
