"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1; a cosine of at least ``least`` is then a distance of at most
epsilon = sqrt(2 - 2 * least). The leading principal dimensions, from second moments summed over all vectors, carry
a grid of cells epsilon wide, and Spark sorts the vectors by their cells into one sequence, the epsilon grid order.
The sequence is cut into intervals of equal length. An interval meets another only if their bounding boxes on the
leading dimensions are at most epsilon apart: boxes of intervals are joined first, and vectors are sent to the pairs
of intervals that remain. Within such a pair both sequences are halved recursively, and what lies in boxes farther
apart than epsilon is skipped. Single precision screens, double precision decides near the limit.

A vector is sent once for each interval near its own. Where vectors gather in clusters these are few; vectors spread
evenly over many dimensions have no provably distant blocks, and an exact join then has to bring each vector to each
of the n / ``interval`` intervals: intervals are as long as memory allows so that this number is small.

Equal vectors are one from the start, with their number as weight. A group gives each vector's count of links and
a forest of links, so no pairs of a dense group are written out.

Defined results: vectors that are null, zero, or hold null or non-finite components, link with nothing; vectors of
different lengths never link; rows of one id are one vector in the classes, each with its own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked, partitions, read_table, stored
from .components import components
from .ngram_join import classes

LEAST = 0.9
#: Grid and box dimensions, and vectors of an interval compared as a whole.
GRID, BOX, LEAF = 16, 16, 256
#: Vectors of an interval: 8192 at most, and fewer where they would take more bytes than this in double precision.
INTERVAL, INTERVAL_BYTES = 8192, 16 << 20
#: Margin of single precision around the limit, and of the boxes.
MARGIN = 1e-4


def usable(vec) -> F.Column:
    """True for vectors that can link."""
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def principal(rows: DataFrame, dims: int) -> np.ndarray:
    """Directions of largest variance of the unit vectors, from moments that each task sums over its rows.

    The dims + 1 rows of sums that reach the driver depend on the vectors' length alone.
    """

    def moments(batches):
        total, one, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for batch in batches:
            x = matrix(batch.column("vec"), dims)
            total, one, n = total + x.T @ x, one + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_pydict({"at": np.arange(dims + 1), "x": pa.array([*np.c_[total, np.zeros(dims)], np.r_[one, n]], pa.list_(pa.float64()))})

    def added(group: pa.Table) -> pa.Table:
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims + 1)
        return pa.table({"at": group.column("at").slice(0, 1), "x": pa.array([x.sum(0)], pa.list_(pa.float64()))})

    sums = np.zeros((dims + 1, dims + 1))
    for r in rows.select("vec").mapInArrow(moments, "at long, x array<double>").groupBy("at").applyInArrow(added, "at long, x array<double>").collect():
        sums[r["at"]] = r["x"]
    n = max(sums[dims, dims], 1)
    mean = sums[dims, :dims] / n
    _, directions = np.linalg.eigh(sums[:dims, :dims] / n - np.outer(mean, mean))
    return directions[:, ::-1]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of a list column, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(x, single, a, b, least, out):
    """Links between the rows a and b (index arrays) into ``out``; double precision decides near the limit."""
    cos = single[a] @ single[b].T
    i, j = np.nonzero(cos >= least - MARGIN)
    if a is b:
        i, j = i[i < j], j[i < j]
    near = cos[i, j] < least + MARGIN
    i, j = a[i], b[j]
    keep = ~near
    keep[near] = np.einsum("ij,ij->i", x[i[near]], x[j[near]]) >= least
    if keep.any():
        out.append((i[keep], j[keep]))


def _recurse(x, single, box, a, b, eps, least, out):
    """Joins two intervals of the sequence, skipping those whose boxes are farther apart than epsilon.

    The same array twice stands for an interval and itself: each of its pairs is met once.
    """
    low_a, high_a, low_b, high_b = box[a].min(0), box[a].max(0), box[b].min(0), box[b].max(0)
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    if gap @ gap > eps * eps:
        return
    if len(a) <= LEAF and len(b) <= LEAF:
        _compare(x, single, a, b, least, out)
        return
    halves = lambda s: [s] if len(s) <= LEAF else [s[: len(s) // 2], s[len(s) // 2 :]]
    mine = halves(a)
    theirs = mine if a is b else halves(b)
    for k, p in enumerate(mine):
        for q in theirs[k:] if a is b else theirs:
            _recurse(x, single, box, p, q, eps, least, out)


class Links:
    """Counts of links by row and the classes that they join, without the links themselves."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.n, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def append(self, links: tuple[np.ndarray, np.ndarray]) -> None:
        i, j = links
        np.add.at(self.n, i, self.weight[j])
        np.add.at(self.n, j, self.weight[i])
        i, j = self.root[i], self.root[j]
        new = i != j
        if new.any():
            self.root = classes(len(self.root), i[new], j[new])[self.root]


def linked(rows: pa.Table, dims: int, directions: np.ndarray, least: float) -> pa.Table:
    """(id, n, root) of vectors with links in one group: n other vectors, by weight, and a forest of links."""
    ids, side, weight = (rows.column(c).to_numpy() for c in ("id", "side", "weight"))
    alone = not side.any()
    if len(ids) < 2 or (not alone and side.all()):
        return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    x = matrix(rows.column("vec"), dims)
    places = x @ directions
    eps = np.sqrt(2 - 2 * least) * (1 + 1e-9)
    cells = np.floor(places[:, :GRID] / eps).astype(np.int64)
    order = np.lexsort([places[:, 0], *cells.T[::-1]])  # epsilon grid order
    first, second, out = order[side[order] == 0], order[side[order] == 1], Links(weight)
    _recurse(x, x.astype(np.float32), places[:, :BOX], first, first if alone else second, eps, least, out)
    at = np.flatnonzero(out.n)
    return pa.table({"id": ids[at], "n": out.n[at], "root": ids[out.root[at]]})


def ordered(rows: DataFrame, dims: int, directions: np.ndarray, eps: float, interval: int) -> DataFrame:
    """id, weight, vec, ``at`` (leading coordinates) and ``no``, the number of its interval of the epsilon grid order."""
    kind = rows.schema["vec"].dataType.simpleString()
    lead = np.ascontiguousarray(directions[:, : max(min(GRID, dims), min(BOX, dims))])

    def place(batches):
        for batch in batches:
            at = matrix(batch.column("vec"), dims) @ lead
            cells = np.floor(at[:, :GRID] / eps).astype(np.int32)
            lists = {"at": pa.array([*at[:, :BOX]], pa.list_(pa.float64())), "cell": pa.array([*cells], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "weight": batch.column("weight"), "vec": batch.column("vec")} | lists)

    def number(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("id", "weight", "vec", "at")} | {"part": np.full(n, part, np.int32), "place": np.arange(start, start + n)})
            start += n

    fields = f"id long, weight long, vec {kind}, at array<double>"
    spread = rows.mapInArrow(place, f"{fields}, cell array<int>").repartitionByRange(partitions(rows.sparkSession), "cell", "id").sortWithinPartitions("cell", "id")
    numbered = stored(spread.mapInArrow(number, f"{fields}, part int, place long"), "order")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return numbered.join(F.broadcast(before), "part").select("id", "weight", "vec", "at", F.floor((F.col("before") + F.col("place")) / interval).alias("no"))


def near_intervals(placed: DataFrame, dims: int, eps: float) -> DataFrame:
    """(no, low, high): pairs low <= high of intervals with boxes at most epsilon apart, for each of the two.

    Boxes are joined on the cells, epsilon wide, that they touch in the first dimension.
    """
    box = min(BOX, dims)
    edges = lambda f: F.array(*[f(F.col("at")[d]) for d in range(box)])
    boxes = placed.groupBy("no").agg(edges(F.min).alias("lo"), edges(F.max).alias("hi"))
    boxes = stored(boxes, "boxes")
    cells = lambda more: F.explode(F.sequence(F.floor(F.col("lo")[0] / eps) - more, F.floor(F.col("hi")[0] / eps) + more))
    mine = boxes.select(F.col("no").alias("low"), "lo", "hi", cells(0).alias("cell"))
    theirs = boxes.select(F.col("no").alias("high"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), cells(1).alias("cell"))
    gaps = F.zip_with(F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    met = mine.join(theirs, "cell").filter((F.col("low") <= F.col("high")) & (far <= eps * eps + MARGIN)).select("low", "high").distinct()
    both = met.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("no"), "low", "high")
    return stored(both, "near")


def _join_length(rows: DataFrame, dims: int, least: float, interval: int) -> DataFrame:
    directions = principal(rows, dims)
    eps = float(np.sqrt(2 - 2 * least))
    placed = ordered(rows, dims, directions, eps, max(LEAF, min(interval, INTERVAL_BYTES // (8 * dims))))
    near = near_intervals(placed, dims, eps)
    sent = placed.select("id", "weight", "vec", "no").join(checked(near), "no").withColumn("side", (F.col("no") > F.col("low")).cast("int")).drop("no")
    return sent.groupBy("low", "high").applyInArrow(lambda t: linked(t, dims, directions, least), "id long, n long, root long")


def join(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", least: float = LEAST, interval: int = INTERVAL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; see the module for the method."""
    kind = df.schema[vec_col].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    own = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast(kind).alias("vec"))
    plus = F.lit(0).cast(kind[6:-1])  # makes -0.0 the same as 0.0
    own = own.withColumn("key", F.when(usable(F.col("vec")), F.transform("vec", lambda v: v + plus))).drop("vec")
    distinct = own.filter("key IS NOT NULL AND vec_id IS NOT NULL").groupBy(F.col("key").alias("vec")).agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("weight"))
    distinct = stored(distinct.select("id", "weight", "vec"), "vectors")
    lengths = [r[0] for r in distinct.select(F.size("vec")).distinct().collect()]
    found = None
    for dims in sorted(lengths):
        one = _join_length(distinct.filter(F.size("vec") == dims), dims, least, interval)
        found = one if found is None else found.union(one)
    if found is None:
        found = distinct.select("id", F.col("weight").alias("n"), F.col("id").alias("root")).limit(0)
    found = stored(found, "found")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = distinct.join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    classes = classes.select("vec", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    plain = own.filter("key IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))  # they meet nothing
    out = own.filter("key IS NOT NULL").join(classes.withColumnRenamed("vec", "key"), "key", "left").select("vec_id", "n_links", "root").union(plain)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6(spark, sf_dir):
    """Direct links, classes and the vectors kept, over all rows whatever their labels."""
    return join(read_table(spark, sf_dir, "embeddings"))
