"""Ingest and lifecycle: cutoffs, upserts, expiry, purge, tombstones, run accounting. All take ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CUTOFF_DAYS, MAX_AGE_DAYS, PROTECTED_SLUG, RETENTION_DAYS, UNSEEN_DAYS
from .ordered import shuffled
from .resolve import classify_change


def _days(n: int) -> Column:
    return F.make_interval(days=F.lit(n))


def too_old(as_of: Column, days: int = CUTOFF_DAYS) -> Column:
    """Whether a posting has a date and is older than ``days`` (exactly that age is not)."""
    return F.coalesce(F.col("posted_at") < as_of - _days(days), F.lit(False))


def drop_too_old(stubs: DataFrame, known: DataFrame, as_of: Column, key: list[str], days: int = CUTOFF_DAYS) -> DataFrame:
    """Known stubs, and unknown ones that are not too old."""
    seen = known.select(*key).distinct().withColumn("_known", F.lit(True))
    return stubs.join(shuffled(seen), key, "left").filter(F.col("_known").isNotNull() | ~too_old(as_of, days)).drop("_known")


def split_known(stubs: DataFrame, known: DataFrame, key: list[str], refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to read in full, only to touch): known stubs are touched unless the source refreshes them."""
    if refresh:
        return stubs, stubs.limit(0)
    return stubs.join(shuffled(known), key, "left_anti"), stubs.join(shuffled(known.select(*key)), key, "left_semi")


def with_error(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``error``, the names of the rules they break; empty where they keep all."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda e: e.isNotNull())
    return df.withColumn("error", F.array_join(broken, ","))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the rules they break."""
    checked = with_error(df, rules)
    return checked.filter("error = ''").drop("error"), checked.filter("error != ''")


def merge_raw(existing: DataFrame, incoming: DataFrame, as_of: Column, key: list[str], stay: tuple[str, ...] = ()) -> DataFrame:
    """A new snapshot: incoming rows over existing ones, first sight kept, last sight moved to ``as_of``.

    The columns ``stay`` keep the values that an existing row has.
    """
    cols = [c for c in incoming.columns if c not in key]
    old, new = existing.alias("o"), incoming.withColumn("_in", F.lit(True)).alias("n")
    both = old.join(new, key, "full")
    put = [(F.coalesce(f"o.{c}", f"n.{c}") if c in stay else F.when(F.col("_in"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in cols]
    return both.select(*key, *put, F.coalesce("o.first_seen_at", as_of).alias("first_seen_at"), F.when(F.col("_in"), as_of).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"))


def touch_complete(raw: DataFrame, seen: DataFrame, complete: DataFrame, as_of: Column, key: list[str]) -> DataFrame:
    """Moves the last sight of seen rows, only of sources whose whole list was walked."""
    touched = seen.join(complete.filter("complete").select("source_id"), "source_id", "left_semi").select(*key).distinct().withColumn("_touch", F.lit(True))
    return raw.join(shuffled(touched), key, "left").withColumn("last_seen_at", F.when(F.col("_touch"), as_of).otherwise(F.col("last_seen_at"))).drop("_touch")


#: What can become of a landed row.
OUTCOMES = ("inserted", "updated", "unchanged", "skipped_old")


def classify_batch(landed: DataFrame, raw: DataFrame, as_of: Column, key: list[str]) -> DataFrame:
    """Landed rows with ``status``; unknown ones that are too old are ``skipped_old`` and still count as fetched."""
    classified = classify_change(raw, landed, key)
    return classified.withColumn("status", F.when((F.col("status") == "inserted") & too_old(as_of), "skipped_old").otherwise(F.col("status")))


def ingest_counts(classified: DataFrame) -> DataFrame:
    """Rows by source and outcome, one row a source."""
    return classified.groupBy("source_id").agg(F.count("*").alias("fetched"), *[F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES])


def ingest_batch(landed: DataFrame, raw: DataFrame, as_of: Column, key: list[str], stay: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """One landed batch: change classes, cutoff, new snapshot and counts. ``landed`` has ``content_hash``."""
    classified = classify_batch(landed, raw, as_of, key)
    kept = classified.filter("status != 'skipped_old'").select(*landed.columns)
    return {"raw": merge_raw(raw, kept, as_of, key, stay), "classified": classified, "counts": ingest_counts(classified)}


def seen_jobs(links: DataFrame, raw: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(job_id) backed by a posting seen within ``days``; the sightings are cut before the join."""
    recent = raw.filter(F.col("last_seen_at") > as_of - _days(days)).select("raw_id")
    return links.join(shuffled(recent), "raw_id", "left_semi").select("job_id").distinct()


def unseen_jobs(jobs: DataFrame, links: DataFrame, raw: DataFrame, as_of: Column, days: int = UNSEEN_DAYS) -> DataFrame:
    return jobs.filter("is_active").join(shuffled(seen_jobs(links, raw, as_of, days)), "job_id", "left_anti")


def expire(jobs: DataFrame, links: DataFrame, raw: DataFrame, as_of: Column, days: int = UNSEEN_DAYS) -> tuple[DataFrame, DataFrame]:
    """(jobs with ``cause``, counts): expiry by date first, then unseen; no row counts twice."""
    seen = seen_jobs(links, raw, as_of, days).withColumn("_seen", F.lit(True))
    hard = F.col("is_active") & (F.col("expires_at") <= as_of)
    cause = F.when(hard, "hard").when(F.col("is_active") & F.col("_seen").isNull(), "unseen")
    out = jobs.join(shuffled(seen), "job_id", "left").withColumn("cause", cause).drop("_seen")
    out = out.withColumn("is_active", F.col("is_active") & F.col("cause").isNull())
    return out, out.agg(F.count_if(F.col("cause") == "hard").alias("hard_expired"), F.count_if(F.col("cause") == "unseen").alias("unseen_expired"))


def purge_candidates(jobs: DataFrame, links: DataFrame, raw: DataFrame, as_of: Column, max_age: int | None = MAX_AGE_DAYS, retention: int = RETENTION_DAYS, protected: str = PROTECTED_SLUG) -> DataFrame:
    """Jobs past the age, active ones too, or inactive and unseen; never the protected one."""
    seen = seen_jobs(links, raw, as_of, retention).withColumn("_seen", F.lit(True))
    old = F.col("posted_at") < as_of - _days(max_age) if max_age is not None else F.lit(False)
    test = old | (~F.col("is_active") & F.col("_seen").isNull())
    return jobs.filter(F.col("slug") != protected).join(shuffled(seen), "job_id", "left").filter(test).drop("_seen")


def append_tombstones(existing: DataFrame, slugs: DataFrame) -> DataFrame:
    """The table with slugs it lacks; those it has stay as they are."""
    return existing.unionByName(slugs.select("slug").distinct().join(shuffled(existing), "slug", "left_anti"), allowMissingColumns=True)


def cascade_delete(raw: DataFrame, links: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, links) without the postings that back the victims, and without all links of either."""
    gone = links.join(shuffled(victims.select("job_id")), "job_id", "left_semi").select("raw_id").distinct()
    return raw.join(shuffled(gone), "raw_id", "left_anti"), links.join(shuffled(gone), "raw_id", "left_anti").join(shuffled(victims.select("job_id")), "job_id", "left_anti")


def orphans(raw: DataFrame, links: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return raw.filter(F.col("last_seen_at") < as_of - _days(days)).join(shuffled(links.select("raw_id")), "raw_id", "left_anti")


def purge(jobs: DataFrame, links: DataFrame, raw: DataFrame, tombstones: DataFrame, as_of: Column, max_age: int | None = MAX_AGE_DAYS, retention: int = RETENTION_DAYS) -> dict[str, DataFrame]:
    """New jobs, links, raw, tombstones and counts; orphans are looked for after the cascade."""
    victims = purge_candidates(jobs, links, raw, as_of, max_age, retention)
    raw_left, links_left = cascade_delete(raw, links, victims)
    stray = orphans(raw_left, links_left, as_of, retention)
    rest = raw_left.join(shuffled(stray.select("raw_id")), "raw_id", "left_anti")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(victims, "jobs_purged").crossJoin(n(raw, "_all")).crossJoin(n(rest, "_left")).select("jobs_purged", (F.col("_all") - F.col("_left")).alias("raw_postings_purged"))
    return {"jobs": jobs.join(shuffled(victims.select("job_id")), "job_id", "left_anti"), "links": links_left, "raw": rest, "tombstones": append_tombstones(tombstones, victims), "counts": counts}


def since(runs: DataFrame, source: str, as_of: Column) -> DataFrame:
    """One row: start of the source's last successful run, else a day before ``as_of``."""
    last = runs.filter((F.col("source_id") == source) & (F.col("status") == "success")).agg(F.max("started_at").alias("m"))
    return last.select(F.coalesce("m", as_of - F.make_interval(hours=F.lit(24))).alias("since"))


def fresh_rows(list_pages: DataFrame) -> DataFrame:
    """List rows first seen on their page: of a repeated id in a crawl the one at the smallest offset."""
    first = list_pages.groupBy("source_id", "job_id").agg(F.min("page_offset").alias("page_offset"))
    return first.select("source_id", "page_offset", "job_id")


#: Rows of a full list page, and the offset at which a crawl is given up.
PAGE_ROWS, LAST_OFFSET = 20, 2000


def crawl_ends(list_pages: DataFrame, size: int = PAGE_ROWS, last_offset: int | None = LAST_OFFSET, least: int | None = None) -> DataFrame:
    """(source_id, last_page, last_useful_page): where each source's crawl ends, and the last page with something new.

    ``list_pages`` are (source_id, page_offset, job_id) rows of pages at multiples of ``size``, with ``total`` where the
    list states one; only that of the first page counts, if it is above 0. A crawl ends at a page that is short (below
    ``least`` rows, by default ``size``), brings nothing that an earlier page has not brought, or reaches the total or the last offset, and before a page that was not
    landed. Ends are minima over a source's pages, so no task holds a source. ``last_useful_page`` is null where even the
    first page brings nothing.
    """
    key = ["source_id", "page_offset"]
    total = F.max("total") if "total" in list_pages.columns else F.lit(None).cast("long")
    pages = list_pages.groupBy(*key).agg(F.count("*").alias("rows"), total.alias("total"))
    new = fresh_rows(list_pages).groupBy(*key).agg(F.count("*").alias("fresh"))
    first = pages.filter("page_offset = 0 AND total > 0").select("source_id", F.col("total").alias("_total"))
    before = pages.select("source_id", (F.col("page_offset") + size).alias("page_offset"), F.lit(True).alias("_follows"))
    told = pages.join(new, key, "left").join(before, key, "left").join(first, "source_id", "left")
    after = F.col("page_offset") + size
    more = (F.col("rows") >= (least or size)) & F.col("fresh").isNotNull() & F.coalesce(after < F.col("_total"), F.lit(True))
    more = more if last_offset is None else more & (after < last_offset)
    gap = F.when((F.col("page_offset") > 0) & F.col("_follows").isNull(), F.col("page_offset") - size)
    ends = told.groupBy("source_id").agg(F.least(F.min(F.when(~more, F.col("page_offset"))), F.min(gap), F.max("page_offset")).alias("last_page"))
    # before a gap the last page is the last one of the run from the first page
    run = told.join(ends, "source_id").filter("page_offset <= last_page")
    return run.groupBy("source_id").agg(F.max("page_offset").alias("last_page"), F.max(F.when(F.col("fresh").isNotNull(), F.col("page_offset"))).alias("last_useful_page"))
