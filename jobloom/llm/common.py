"""What the operators share: column wrappers, tables between jobs, and hashing of words in blocks."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of one block. A block is what a task holds in memory at a time, so this bounds its arrays.
BLOCK_WORDS = 500_000
#: Rolling base: odd and 3 modulo 8, so that differences of its powers keep few factors of two.
BASE = np.uint64(0x9E3779B97F4A7C1B)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="jobloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/jobloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, a small table of numbers that can be counted cheaply, to be broadcast only if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, order: list, name: str, place: str = "place") -> DataFrame:
    """``df``, written, with ``place``: a row's number from 0 in the order, which must tell all rows apart.

    Rows are range-sorted; a row's number is its place in its partition and the rows of all partitions before, of which
    there is one count each.
    """
    spread = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = stored(spread.withColumn("__at", F.monotonically_increasing_id()), name)
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row a partition
    return rows.join(F.broadcast(before), part == F.col("__part")).select(*df.columns, (F.col("__before") + at).alias(place))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, b'' for null, without making Python strings."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    elif pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary())
    return [x or b"" for x in texts.to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of ``column`` each; a longer row comes alone."""
    col = batch.column(column)
    sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
    start, total = 0, 0.0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0.0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text_col: str, limit: int = 4 << 20, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over slices of about ``limit`` bytes of text; ``fn`` returns the columns of ``schema`` for a slice.

    ``after`` runs at a task's end, to let go of what ``fn`` has remembered.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col, limit):
                yield pa.RecordBatch.from_pydict(fn(part))
        batch = part = None
        if after:
            after()
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit keyed hashes of words, the same on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    arr = np.empty(len(words), dtype=object)
    arr[:] = words
    return pd.util.hash_array(arr, categorize=False)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < size, size at least n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inv, np.uint64)], dtype=np.uint64)
        _POWERS[0] = (up, down)
    return _POWERS[0]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` word hashes, by prefix sums modulo 2**64."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * down[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * up[width - 1 : n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly over the top bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)].astype(np.int64)


def row_key(*columns) -> F.Column:
    """128 bits that stand for a row's values in joins."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("k1"), F.xxhash64(F.lit(2), *columns).alias("k2"))


def ddl(df: DataFrame, but: str = "__text") -> str:
    """The columns of ``df`` but one as a schema for Arrow functions, each followed by a comma."""
    return "".join(f"{_quoted(f.name)} {type_name(f.dataType)}, " for f in df.schema if f.name != but)


def type_name(kind: T.DataType) -> str:
    """A type's name in a schema, with every field name quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"{_quoted(f.name)}: {type_name(f.dataType)}" for f in kind) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{type_name(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{type_name(kind.keyType)}, {type_name(kind.valueType)}>"
    return kind.simpleString()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
