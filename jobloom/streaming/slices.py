"""A keyed table in slices that split as it grows, rewritten slice by slice: extendible hashing over Parquet folders.

A slice holds the rows whose key's hash ends in given bits. The directory names each slice by its number of bits and
their value, with its folder and rows; a slice that would pass ``limit`` rows is written with as many more bits as leave
its parts half full or less on average, so slices, and tasks that write them, grow in number with the table and not in size. A batch reads
and rewrites only the slices that its keys touch.

Every batch commits its directory as one file named by its number. A batch that runs again starts from the directory
before its own and writes the same again. Directories before the last two, and folders that neither of those names, are
dropped, so a batch lists what is current and nothing of batches long past.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a slice, and the columns by which its folder is named: bits of the hash, and their value.
LIMIT, SLICE = 1_000_000, ["_slice_bits", "_slice_value"]


class Slices:
    """The slices below a folder."""

    def __init__(self, spark: SparkSession, folder: str, limit: int = LIMIT):
        self.spark, self.folder, self.limit = spark, folder.rstrip("/"), limit

    def directory(self, before: int | None = None) -> dict:
        """The newest directory, or the newest of the batches below a number: ``schema`` and ``slices``."""
        found = [n for n in self._batches() if before is None or n < before]
        if not found:
            return {"schema": None, "slices": []}
        stream = self._files().open(self._path(f"directory/{max(found):012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The whole table, or None before the first batch."""
        now = self.directory()
        return self._open(now, now["slices"]) if now["schema"] else None

    def merge(self, batch: DataFrame, number: int, batch_key: list[Column], key: list[Column], step: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
        """Runs ``step(batch, touched rows or None)`` and puts its rows in the place of the touched slices."""
        before = self.directory(number)
        known = before["slices"] or [{"bits": 0, "value": 0, "rows": 0, "folder": None}]
        incoming = {(r[SLICE[0]], r[SLICE[1]]): r["n"] for r in self._placed(batch, batch_key, known).groupBy(*SLICE).agg(F.count("*").alias("n")).collect()}  # one row a slice
        touched = [s for s in known if (s["bits"], s["value"]) in incoming]
        if not touched:
            return
        held = [s for s in touched if s["folder"]]
        rows = step(batch, self._open(before, held) if held else None)
        parts = []
        for s in touched:
            wanted = s["rows"] + incoming[s["bits"], s["value"]]
            more = math.ceil(math.log2(2 * wanted / self.limit)) if wanted > self.limit else 0  # half full on average
            parts += [{"bits": s["bits"] + more, "value": s["value"] | (k << s["bits"])} for k in range(1 << more)]
        place = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
        out = self._placed(rows, key, parts)
        out.repartition(max(1, min(len(parts), 1 << 14)), *SLICE).write.partitionBy(*SLICE).parquet(f"{self.folder}/{place}")
        written = self.spark.read.schema(f"{SLICE[0]} int, {SLICE[1]} long").parquet(f"{self.folder}/{place}").groupBy(*SLICE).agg(F.count("*").alias("n"))
        sizes = {(r[SLICE[0]], r[SLICE[1]]): r["n"] for r in written.collect()}
        for p in parts:
            p["rows"] = sizes.get((p["bits"], p["value"]), 0)
            p["folder"] = f"{place}/{SLICE[0]}={p['bits']}/{SLICE[1]}={p['value']}" if p["rows"] else None
        self._commit(number, {"schema": json.loads(rows.schema.json()), "slices": [s for s in known if s not in touched] + parts})

    def _placed(self, df: DataFrame, key: list[Column], slices: list[dict]) -> DataFrame:
        """``df`` with bits and value of the slice that each row's key falls into, as ``SLICE``."""
        whole = F.xxhash64(*key)
        tries = [F.struct(F.lit(b).alias(SLICE[0]), whole.bitwiseAND(F.lit((1 << b) - 1)).alias(SLICE[1])) for b in sorted({s["bits"] for s in slices})]
        named = self.spark.createDataFrame([(s["bits"], s["value"]) for s in slices], f"{SLICE[0]} int, {SLICE[1]} long")
        return df.withColumn("_at", F.explode(F.array(*tries))).select("*", "_at.*").drop("_at").join(F.broadcast(named), SLICE)  # one row a slice

    def _open(self, directory: dict, slices: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(directory["schema"])
        paths = [f"{self.folder}/{s['folder']}" for s in slices if s["folder"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, number: int, directory: dict) -> None:
        files = self._files()
        aside = self._path(f"directory/aside-{uuid.uuid4().hex}")
        out = files.create(aside, True)
        try:
            out.write(bytearray(json.dumps(directory).encode()))
        finally:
            out.close()
        last = self._path(f"directory/{number:012d}.json")
        files.delete(last, False)  # of a run of this batch that ended before the stream knew
        if not files.rename(aside, last):
            raise RuntimeError(f"batch {number} could not be committed")
        batches = sorted(self._batches())
        for old in batches[:-2]:
            files.delete(self._path(f"directory/{old:012d}.json"), False)
        used = {s["folder"].split("/")[1] for n in batches[-2:] for s in self.directory(n + 1)["slices"] if s["folder"]}
        for status in files.globStatus(self._path("data/*")) or []:
            if status.getPath().getName() not in used:
                files.delete(status.getPath(), True)

    def _batches(self) -> list[int]:
        names = [s.getPath().getName() for s in self._files().globStatus(self._path("directory/*.json")) or []]
        return [int(name[:-5]) for name in names]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
