"""The posting pipeline: ingest, resolve, expire, purge and notify, in their order, from one committed state to the next.

Every stage writes its tables and the next one reads them; the run commits them together (``operators.snapshots``), so
readers see the state before the run or after it and never one between two stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import lifecycle as L
from ..operators import resolve as R
from ..operators.snapshots import Snapshots

KEY = ["source_id", "source_job_id"]
#: Columns of a landed posting by which it counts as changed.
CONTENT = ["title", "employer_name", "city", "province", "posted_at", "closes_at"]
#: Source under which the runs of the last stage are kept.
NOTIFY = "notify"


def run_pipeline(state: Snapshots, landed: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """One run over ``landed`` postings (canonical columns, ``id`` and ``fingerprint``); gives its row of counts.

    Tables of the new version: ``raw``, ``jobs``, ``links``, ``quarantine``, ``tombstones``, ``queue``, ``counts`` (by
    source, of this run) and ``runs`` (one row a source and run).
    """
    draft = state.draft()
    before = lambda name, none: none if (found := draft.read(name)) is None else found

    hashed = landed.withColumn("content_hash", R.content_hash(CONTENT))
    old_raw = before("raw", hashed.limit(0).withColumns({"first_seen_at": as_of, "last_seen_at": as_of}))
    ingested = L.ingest_batch(hashed, old_raw, as_of, KEY, stay=("id",))
    counts = draft.put("counts", ingested["counts"])
    raw = draft.put("raw", ingested["raw"])

    stamped = {"created_at": as_of, "updated_at": as_of}
    old_jobs = before("jobs", R.build_job_rows(raw.limit(0), registry).withColumns({**stamped, "cause": F.lit(None).cast("string")}))
    old_links = before("links", raw.select(F.col("fingerprint").alias("job_id"), F.col("id").alias("raw_id")).limit(0))
    found = R.resolve(raw, registry, old_jobs, old_links.withColumnRenamed("job_id", "job_key"))
    draft.put("quarantine", found["quarantine"])
    changes = draft.put("changes", found["jobs"])
    links = draft.put("links", old_links.unionByName(found["links"].withColumnRenamed("job_key", "job_id")))
    jobs = draft.put("jobs", R.merge_jobs(old_jobs, changes, as_of))

    seen = raw.select(F.col("id").alias("raw_id"), "last_seen_at")
    active, expiries = L.expire(jobs.drop("cause").withColumn("job_id", F.col("dedupe_key")), links, seen, as_of)
    expired = draft.put("jobs", active.withColumn("updated_at", F.when(F.col("cause").isNotNull(), as_of).otherwise(F.col("updated_at"))))

    stones = before("tombstones", expired.select("slug").limit(0))
    end = L.purge(expired, links, raw.withColumnRenamed("id", "raw_id"), stones, as_of)
    purged = draft.put("purged", end["counts"])
    draft.put("raw", end["raw"].withColumnRenamed("raw_id", "id"))
    draft.put("links", end["links"])
    draft.put("tombstones", end["tombstones"])
    final = draft.put("jobs", end["jobs"].drop("job_id"))

    runs = before("runs", counts.select("source_id", F.lit("").alias("status"), as_of.alias("started_at"), *[F.col(c) for c in counts.columns[1:]]).limit(0))
    mark = L.since(runs, NOTIFY, as_of).first()["since"]  # one row
    queue = draft.put("queue", A.notify_queue(final, F.lit(mark)))
    done = counts.select("source_id", F.lit("success").alias("status"), as_of.alias("started_at"), *counts.columns[1:])
    told = queue.agg(F.count("*").alias("fetched")).select(F.lit(NOTIFY).alias("source_id"), F.lit("success").alias("status"), as_of.alias("started_at"), "fetched")
    draft.put("runs", runs.unionByName(done).unionByName(told, allowMissingColumns=True))

    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns[1:]])
    jobs_of = changes.agg(F.count("*").alias("jobs"), F.count_if(F.expr("change != 'unchanged'")).alias("written"), F.count_if(F.expr("change = 'unchanged'")).alias("kept"))
    linked = found["links"].agg(F.count("*").alias("new_links"))
    queued = queue.agg(F.count_if(F.expr("type = 'URL_UPDATED'")).alias("opened"), F.count_if(F.expr("type = 'URL_DELETED'")).alias("closed"))
    report = draft.put("report", sums.crossJoin(jobs_of).crossJoin(linked).crossJoin(expiries).crossJoin(purged).crossJoin(queued))  # one row each
    draft.commit()
    return report
