"""What needs a whole order without one task that holds it: numbers of rows, running sums, quantiles of any group.

Rows are range-sorted; a running sum is a row's sum within its partition and the sums of the partitions before, of which
there is one row each. The sorted rows are written to the shared folder, so that a lost executor does not part sums from
rows. No group is sorted or held by one task, however many rows or different values it has.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; a temporary one only where none is set and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="jobloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: computed once, and its lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], weight: Column, name: str = "running", parts: int | None = None) -> DataFrame:
    """``df`` with ``upto``: the sum of ``weight`` (whole numbers, none null) over all rows up to this one in the order.

    The order must tell rows apart as far as their sums are to be told apart. One column of ``df`` may not be called
    ``upto``.
    """
    rows = df.withColumn("_weight", weight.cast("long"))
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                sums = pc.add(pc.cumulative_sum(batch.column("_weight")), so_far)
                so_far = sums[-1].as_py()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(sums), pa.int32()), sums], names=[f.name for f in schema])

    summed = stored(spread.mapInArrow(run, schema), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = summed.groupBy("_part").agg(F.max("_sum").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return summed.join(F.broadcast(offsets), "_part").withColumn("upto", F.col("_before") + F.col("_sum")).drop("_part", "_sum", "_before", "_weight")


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, which grows with the input, for a join that shuffles both sides.

    Left to the plan it is broadcast while its files or shuffled rows, compressed, seem small; each such table passes
    through the driver whole, several times larger, and a run has dozens of them.
    """
    return df.hint("merge")


def same(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], name: str = "quantiles") -> DataFrame:
    """``by``, ``n`` and the exact quantiles ``shares`` of each group, linear between the two values next to (n - 1) q.

    Equal values are counted first; then all groups' values stand in one order, in which a group is a run of ranks, and
    a quantile is the first value whose rank reaches it. Null values do not count; groups without values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_rows"))
    ranked = running(counts, [*[F.col(k).asc_nulls_first() for k in by], F.col("_value").asc()], F.col("_rows"), name)
    groups = ranked.groupBy(*by).agg(F.min(F.col("upto") - F.col("_rows")).alias("_before"), F.max("upto").alias("_last"))
    rows = ranked.alias("r").join(groups.alias("g"), same(by, "r", "g")).select("r.*", F.expr("_last - _before").alias("n"), (F.col("upto") - F.col("_before")).alias("_rank"))
    at = {q: (F.col("n") - 1) * share for q, share in shares.items()}
    ends = [F.min(F.when(F.col("_rank") > side(x), F.col("_value"))).alias(f"_{q}_{i}") for q, x in at.items() for i, side in enumerate((F.floor, F.ceil))]
    found = rows.groupBy(*by, "n").agg(*ends)
    exact = lambda q: F.col(f"_{q}_0") + (F.col(f"_{q}_1") - F.col(f"_{q}_0")) * (at[q] - F.floor(at[q]))
    return found.select(*by, "n", *[exact(q).alias(q) for q in shares])
