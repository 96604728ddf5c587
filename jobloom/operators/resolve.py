"""Resolution: fingerprints, grouping across sources, survivorship, change detection, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import classify
from ..functions.text import clean_city, deaccent, normalize_title, slugify_title
from ..schema import AGGREGATORS, EXPIRY_DAYS
from .ordered import shuffled


def fingerprint(title: Column, employer: Column, city: Column, province: Column) -> Column:
    """Match key of a vacancy; a null part counts as empty, so no part ever drops out of the key."""
    parts = [normalize_title(title), F.lower(F.trim(employer)), deaccent(F.lower(F.trim(city))), F.upper(F.trim(province))]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def source_priority(source: Column) -> Column:
    prefix = F.substring_index(source, ":", 1)
    chain = reduce(lambda c, kv: c.when(prefix == kv[0], kv[1]), AGGREGATORS.items(), F)
    return chain.otherwise(0)


def group_into_jobs(raw: DataFrame) -> DataFrame:
    """Sightings with ``group_key``: the fingerprint where it spans more than one source, else one of their own.

    The span is two partial extremes over the fingerprint, not a collected set.
    """
    spans = raw.groupBy("fingerprint").agg((F.min("source_id") != F.max("source_id")).alias("spans"))
    key = F.when(F.col("spans"), F.col("fingerprint")).otherwise(F.concat_ws(":", "fingerprint", F.col("id").cast("string")))
    return raw.join(shuffled(spans), "fingerprint").withColumn("group_key", key)


def pick_canonical(grouped: DataFrame) -> DataFrame:
    """Of each group the sighting of the best source, the smallest id on ties; with the group's size and sources."""
    best = F.min_by(F.struct(*[c for c in grouped.columns if c != "group_key"]), F.struct(source_priority(F.col("source_id")).alias("p"), F.col("id").alias("i")))
    one = grouped.groupBy("group_key").agg(best.alias("row"), F.count("*").alias("sightings"), F.countDistinct("source_id").alias("sources"))
    return one.select("group_key", "sightings", "sources", "row.*")


def enrich_employer(df: DataFrame, registry: DataFrame, name: str = "employer_name") -> DataFrame:
    """Registry id and default city by name; of several entries the last, null where none."""
    last = registry.groupBy(F.col("name").alias("k")).agg(F.max_by(F.struct("employer_id", "default_city"), "employer_id").alias("e"))
    return df.join(last, F.col(name) == F.col("k"), "left").select(df["*"], "e.employer_id", "e.default_city")


def expires_at(posted: Column, closes: Column, days: int = EXPIRY_DAYS) -> Column:
    return F.least(closes, posted + F.make_interval(days=F.lit(days)))


def split_identified(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups whose canonical sighting has a source's job id, and those to quarantine."""
    has = F.coalesce(F.col("source_job_id") != "", F.lit(False))
    return groups.filter(has), groups.filter(~has)


def build_job_rows(canonical: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical job rows, keyed by fingerprint and the source's job id."""
    rows = enrich_employer(canonical, registry)
    key = F.concat_ws(":", "fingerprint", "source_job_id")
    return rows.select(
        slugify_title(F.col("title"), key).alias("slug"), "fingerprint", key.alias("dedupe_key"), "title", "employer_id", "employer_name",
        clean_city(F.col("city"), F.col("default_city")).alias("city"), "province", classify(F.col("title")).alias("category"),
        F.col("source_id").alias("canonical_source"), "posted_at", "closes_at", expires_at(F.col("posted_at"), F.col("closes_at")).alias("expires_at"), F.lit(True).alias("is_active"),
    )


def diff_snapshot(old: DataFrame, new: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """New rows with ``change``: new, changed or unchanged; nulls compare as values."""
    before = old.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_seen"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in key])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in cols])
    change = F.when(F.col("_seen").isNull(), "new").when(differs, "changed").otherwise("unchanged")
    return new.join(shuffled(before), same, "left").select(new["*"], change.alias("change"))


def merge_jobs(old: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The next jobs: rows with ``change`` over old ones by ``dedupe_key``, stamped where they are new or changed.

    Jobs without a row stay as they are; unchanged ones keep both stamps, changed ones the first.
    """
    cols = [c for c in changes.columns if c not in ("dedupe_key", "change")]
    both = old.alias("o").join(changes.alias("n"), "dedupe_key", "full")
    put = [F.when(F.col("change").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in cols]
    moved = F.when(F.col("change").isin("new", "changed"), as_of).otherwise(F.col("o.updated_at"))
    rows = both.select(*put[:2], "dedupe_key", *put[2:], F.coalesce("o.created_at", as_of).alias("created_at"), moved.alias("updated_at"), F.when(F.col("change").isNull(), F.col("o.cause")).alias("cause"))
    return rows.select(*old.columns)


def new_links(links: DataFrame, existing: DataFrame) -> DataFrame:
    """The different (job_key, raw_id) that the link table lacks; a pair is a row, so no group is held in one value."""
    return links.select("job_key", "raw_id").distinct().join(shuffled(existing), ["job_key", "raw_id"], "left_anti")


def content_hash(cols: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def classify_change(known: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows with ``status``: inserted, updated or unchanged, by content hash."""
    before = known.select(*key, F.col("content_hash").alias("_hash"))
    status = F.when(F.col("_hash").isNull(), "inserted").when(F.col("_hash") != F.col("content_hash"), "updated").otherwise("unchanged")
    return incoming.join(shuffled(before), key, "left").withColumn("status", status).drop("_hash")


def resolve(raw: DataFrame, registry: DataFrame, jobs: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """jobs (rows with their change), links (new ones), quarantine and stats of one resolution."""
    grouped = group_into_jobs(raw)
    good, bad = split_identified(pick_canonical(grouped))
    rows = build_job_rows(good, registry)
    cols = [c for c in rows.columns if c != "dedupe_key"]
    changed = diff_snapshot(jobs, rows, ["dedupe_key"], cols)
    keyed = good.select("group_key", F.concat_ws(":", "fingerprint", "source_job_id").alias("job_key"))
    fresh = grouped.join(shuffled(keyed), "group_key").select("job_key", F.col("id").alias("raw_id"))
    stats = changed.agg(F.count("*").alias("jobs"), F.count_if(F.col("change") == "unchanged").alias("unchanged"), F.count_if(F.col("change") != "unchanged").alias("written"))
    merges = good.agg(F.count_if(F.col("sources") > 1).alias("merges"))
    return {"jobs": changed, "links": new_links(fresh, links), "quarantine": bad, "stats": stats.crossJoin(merges)}
