"""Connected components of a table of links, by alternating large and small stars.

Each round is a few joins and grouped minima over the links; nothing is gathered on the driver but one count and
one checksum a round. A node with many links is a group of partial minima, never a list.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another: root is the smallest node it reaches.

    Null ends and links of a node to itself say nothing. Repeated links count once. No links give no rows.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges, before = stored(_forest(edges).distinct(), "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stored(small.union(root.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def _forest(edges: DataFrame) -> DataFrame:
    """Each task's links without those that its earlier links already join, batch by batch."""

    def run(batches):
        for batch in batches:
            keep, up = [], {}
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x, y = find(up, u), find(up, v)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    keep.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in keep], pa.int64()) for i in (0, 1)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def find(up: dict, x):
    """Root of ``x`` in a dict of parents, halving the path."""
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = up[x]
    return x
