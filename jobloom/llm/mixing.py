"""Mixing sources to target weights.

Tokens are added up per source; weights share the whole among the sources, no source more than ``most`` times
its size, the excess reshared by weight; a source's rate is its target over its size. A document is taken
floor(rate) times, and once more with a probability equal to the fraction: when a seeded draw in [0, 1) from a hash
of the document is below it (``drawn``).

The words that such draws take come to the target on average, and miss it by chance the more, the fewer and longer a
source's documents are. A second step corrects what the draws left over: a source that took too few words also takes
the documents whose draws lie just above the fraction, one that took too many gives back those just below it, until the
words of one document are missing or too many (``copies``). ``thresholds`` finds up to which draw.

Defined results: null text has size 0; null is a source, last in order; a source without words has target 0
and is not repeated; rows with equal id, text and source share one draw; columns of the input named like a result are
replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, numbered, read_table, stored

# The weights of sources in order, and the cap on repetition.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = 17
#: Bins of draws in each of two levels: the fraction is found to one part in BINS * BINS.
BINS = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with ``weight`` and ``target``; one row a source.

    Sources share the whole by weight. Those whose share is above their cap get the cap, and the others share what is
    left; this goes on until no share is above its cap, each time over two sums. A source at its cap stays there, as
    the level only rises.
    """
    rows = numbered(sizes, [F.col("source").isNull(), F.col("source")], "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        n, whole, given, open_weight = rows.agg(F.count_if(full), F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        level, capped = ((whole or 0) - (given or 0.0)) / open_weight, n
    return rows.select("source", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, cut): the draws below ``cut`` hold ``need`` words, up to those of the documents in its bin.

    Sizes are added up by source and bin in each task, then by source alone over at most BINS rows; the second
    level does the same inside the one bin of each source in which the first level ends.
    """
    by = Window.partitionBy("source").orderBy("bin")
    first = rows.groupBy("source", F.floor(F.col("draw") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
    first = first.join(checked(rates), first["source"].eqNullSafe(rates["source"])).select(first["*"], "need")
    first = first.withColumn("past", F.sum("words").over(by)).filter("past >= need").groupBy("source").agg(F.min_by(F.struct("bin", (F.col("need") - F.col("past") + F.col("words")).alias("left")), "bin").alias("at"))
    first = stored(first.select(F.col("source").alias("s"), "at.bin", "at.left"), "bins")
    fine = F.floor(F.col("draw") * BINS * BINS) - F.col("b") * BINS
    inner = rows.withColumn("b", F.floor(F.col("draw") * BINS)).join(checked(first), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bin")))
    inner = inner.select("source", "left", F.col("b"), fine.alias("bin"), "size").groupBy("source", "left", "b", "bin").agg(F.sum("size").alias("words"))
    inner = inner.withColumn("past", F.sum("words").over(by)).withColumn("off", F.abs(F.col("past") - F.col("left")))
    none = inner.groupBy("source", "b").agg(F.min_by(F.struct("bin", "off"), F.struct("off", "bin")).alias("end"), F.first("left").alias("left"))
    end = F.when(F.col("end.off") <= F.col("left"), F.col("end.bin") + 1).otherwise(0)
    return none.select("source", ((F.col("b") * BINS + end) / float(BINS * BINS)).alias("cut"))


def mix(df: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights=WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``drawn`` and ``copies`` added, whatever its other columns."""
    extra = ["size", "source_size", "target", "drawn", "copies"]
    rows = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        words(df[text_col]).alias("size"),
        df[source_col].cast("string").alias("source"),
        (F.shiftrightunsigned(F.xxhash64(F.lit(seed), df[id_col], df[text_col], df[source_col]), 11) / float(1 << 53)).alias("draw"),
    )
    slim = rows.select("size", "source", "draw")
    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(rate + 1e-12)).withColumn("fraction", F.greatest(F.lit(0.0), rate - F.col("whole")))
    sources = stored(sources.withColumn("need", F.col("fraction") * F.col("source_size")), "rates")
    cuts = thresholds(slim, sources.filter("need > 0.5").select("source", "need"))
    plan = sources.join(cuts, sources["source"].eqNullSafe(cuts["source"]), "left").select(sources["source"].alias("__s"), sources["source_size"], sources["target"], "whole", "fraction", F.coalesce("cut", F.lit(0.0)).alias("cut"))
    out = rows.join(checked(stored(plan, "plan")), F.col("source").eqNullSafe(F.col("__s")))
    once = lambda below: (F.col("whole") + (F.col("draw") < F.col(below)).cast("int")).cast("int")
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in extra], "size", "source_size", "target", once("fraction").alias("drawn"), once("cut").alias("copies"))


def op2(spark, sf_dir):
    """The mix of all documents: each one's size, its source's size and target, and the words taken of it.

    ``drawn_words`` are those that the draws alone would take.
    """
    mixed = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = {"taken": F.col("size") * F.col("copies"), "drawn_words": F.col("size") * F.col("drawn")}
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", *[v.alias(k) for k, v in taken.items()])
