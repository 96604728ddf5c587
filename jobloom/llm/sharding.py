"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ranged by a key. A sample drawn with a chance in proportion to size gives the splitters: quantiles of
the sampled keys cut the keys into ranges of near equal bytes. Ranges that hold more than ``CELL_ROWS`` rows are
subdivided by a second hash of the key, and keys that alone hold more than ``HEAVY`` of a shard, or more than
``CELL_ROWS`` rows, by row. Sums of bytes over these cells, in order, and within each cell over its rows, place every
row on one line of bytes; the shard is the stretch of the line that holds it. Rows of one key stay in one shard unless
the key alone holds more than ``HEAVY`` of a shard. Key, size and tie are worked out once and written; all passes read
these alone.

Law ``bytes``: the shards' sizes come near equal. Defined results: null text has 8 bytes and crc32 0; equal
texts are one key; repeated rows keep a place each; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, read_table, stored

SHARDS, OVERHEAD = 24, 8
#: Splitters and the rows sampled for them: both bounded, whatever the input's size.
RANGES, SAMPLE = 192, 200_000
#: Rows of a cell, and the share of a shard above which a key is spread by rows.
CELL_ROWS, HEAVY = 50_000, 0.05


def range_of(key: Column, splitters: list) -> Column:
    """Number of splitters at or below the key: two steps over about the square root of their number."""
    if not splitters:
        return F.lit(0)
    step = max(1, round(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    below = lambda xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda x: x <= key))
    block = F.greatest(below([b[0] for b in blocks]) - 1, F.lit(0))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block + 1)
    return (block * step + F.size(F.filter(inner, lambda x: x <= key))).cast("int")


def splitters(rows: DataFrame, total: int, ranges: int = RANGES, sample: int = SAMPLE) -> list:
    """Keys at the quantiles of a sample drawn in proportion to ``size``; only these come to the driver."""
    if not total:
        return []
    draw = F.shiftrightunsigned(F.xxhash64("key", "tie", F.lit(5)), 11) / float(1 << 53)
    drawn = rows.filter(draw * total < F.col("size") * float(sample)).select("key")
    cuts = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(F.percentile_approx("key", cuts, 10 * ranges).alias("q")).first()["q"]
    return sorted(set(found or []))


def shard(df: DataFrame, key: Column, size: Column, tie: Column, keep: list[Column], shards: int = SHARDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``keep`` columns with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (from 0, without gaps, in a shard)."""
    rows = df.select(F.struct(*keep).alias("row"), key.alias("key"), size.cast("long").alias("size"), tie.alias("tie"))
    rows = stored(rows, "keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    # Keys of more than a share of a shard (at most shards / HEAVY), or of more rows than a cell (rows / CELL_ROWS).
    heavy = rows.groupBy("key").agg((F.sum("size") * shards > HEAVY * total).alias("large"), F.count("*").alias("n"))
    heavy = stored(heavy.filter(F.col("large") | (F.col("n") > cell_rows)).select("key", "large"), "heavy")
    ranged = rows.withColumn("range", range_of(F.col("key"), splitters(rows, total)))
    many = ranged.groupBy("range").agg(F.ceil(F.count("*") / cell_rows).alias("cells"))  # one row a range
    ranged = ranged.join(checked(heavy), "key", "left").join(F.broadcast(many), "range")
    # Cells: heavy keys by row, the rest by a second hash of the key, so that a key stays whole.
    alone = F.col("large").isNotNull()
    own = F.when(alone, F.pmod(F.xxhash64("tie", F.lit(1)), F.col("cells") * 16)).otherwise(F.pmod(F.xxhash64("key", F.lit(2)), F.col("cells")))
    placed = stored(ranged.select("row", "size", "tie", "range", F.coalesce("large", F.lit(False)).alias("large"), F.when(alone, F.col("key")).alias("alone"), own.alias("cell"), F.col("key").alias("group")), "shards")
    # Sums over cells, then within a cell over keys (or rows, of heavy keys). Cells of one key follow one another.
    cell = ["range", "alone", "cell"]
    sums = placed.groupBy(*cell).agg(F.sum("size").alias("bytes"))
    line = Window.orderBy("range", F.col("alone").isNotNull(), "alone", "cell")
    whole = Window.partitionBy("range", "alone")
    starts = sums.withColumn("start", F.sum("bytes").over(line) - F.col("bytes"))
    starts = starts.withColumn("key_middle", F.min("start").over(whole) + F.sum("bytes").over(whole) / 2).drop("bytes")
    same = [placed[c].eqNullSafe(starts[c]) for c in cell]
    inside = Window.partitionBy("range", "alone", "cell")
    laid = placed.join(starts, same[0] & same[1] & same[2]).select(placed["*"], "start", "key_middle")
    upto = F.sum("size").over(inside.orderBy("group", "tie", "row.doc_key").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumn("upto", upto)
    one = Window.partitionBy("range", "alone", "cell", "group")
    middle = F.when(F.col("large"), F.col("start") + F.col("upto") - F.col("size") / 2).when(F.col("alone").isNotNull(), F.col("key_middle"))
    middle = middle.otherwise(F.col("start") + (F.max("upto").over(one) + F.min(F.col("upto") - F.col("size")).over(one)) / 2)
    laid = laid.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1))))).cast("int"))
    # Slots: a cell's rows within a shard follow those of the cells before it.
    counts = laid.groupBy(*cell, "shard").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("range", F.col("alone").isNotNull(), "alone", "cell")
    counts = counts.withColumn("first", F.sum("n").over(order) - F.col("n")).drop("n")
    same = [laid[c].eqNullSafe(counts[c]) for c in [*cell, "shard"]]
    numbered = laid.join(counts, same[0] & same[1] & same[2] & same[3]).select(laid["*"], "first")
    slot = F.col("first") + F.row_number().over(Window.partitionBy("range", "alone", "cell", "shard").orderBy("group", "tie", "row.doc_key")) - 1
    return numbered.select("row.*", "size", "shard", slot.cast("long").alias("slot"))


def op8(spark, sf_dir):
    """Shards 0 to 23 of all documents under the law ``bytes``."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("raw"))
    size = F.coalesce(F.length("raw"), F.lit(0)) + OVERHEAD
    crc = F.crc32(F.coalesce("raw", F.encode(F.lit(""), "utf-8")))
    keep = [F.col("doc_id"), crc.alias("text_crc32"), F.xxhash64("doc_id").alias("doc_key")]
    out = shard(docs, F.xxhash64("raw", F.col("raw").isNull()), size, F.xxhash64("doc_id", "raw"), keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
