"""Queries of the streams over ``events``, each held against its batch form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators.export import write_run_metrics
from ..operators.ordered import shared_folder
from ..operators.resolve import content_hash
from ..operators.snapshots import Snapshots
from ..streaming import streams as S
from ..streaming.timed import rocksdb, unseen_keys
from .bindings import SIGHTINGS, as_of, printed, table
from .living import DIFFERS, LANDED, NOW, first_landed, job_sql, registry
from .living import ORACLE as LIVING
from .pipeline import run_pipeline

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def folder(spark, name: str) -> str:
    return shared_folder(spark, f"stream-{name}")


def events(spark, sf):
    """The events table as a stream; the pattern takes a file or a folder of files."""
    schema = table(spark, sf, "events").schema
    return S.read_stream(spark, f"{sf}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("STM-1", "SELECT event_type AS source_id, count(DISTINCT user_id) AS postings, '2001-08-02 00:00:00' AS seen FROM events GROUP BY 1")
def ingest(spark, sf):
    def step(batch, old):
        rows = batch.select(F.col("event_type").alias("source_id"), F.col("user_id").alias("source_job_id"), F.col("value")).groupBy("source_id", "source_job_id").agg(F.max("value").alias("value"))
        rows = rows.withColumn("content_hash", content_hash(["value"]))
        before = old if old is not None else rows.limit(0).withColumns({"first_seen_at": as_of(), "last_seen_at": as_of()})
        return L.merge_raw(before, rows, as_of(), ["source_id", "source_job_id"])

    raw = S.ingest_stream(events(spark, sf), folder(spark, "ingest"), step, ["event_type", "user_id"], ["source_id", "source_job_id"])
    return raw.groupBy("source_id").agg(F.count("*").alias("postings"), F.max("last_seen_at").cast("string").alias("seen"))


@query("STM-2", "SELECT DISTINCT event_type, user_id FROM events")
def first_seen(spark, sf):
    stream = S.first_sightings(events(spark, sf), ["event_type", "user_id"], "ts", "60 days")
    return S.run_to_table(stream, folder(spark, "first")).select("event_type", "user_id")


@query("STM-3", "SELECT job, count(*) AS times FROM (SELECT event_type || user_id AS job, max(ts) AS last FROM events GROUP BY 1) WHERE date_trunc('millisecond', last) + to_days(1) <= (SELECT date_trunc('millisecond', max(ts)) FROM events) GROUP BY 1")
def unseen(spark, sf):
    stream = S.unseen_stream(events(spark, sf).withColumn("job", F.concat("event_type", F.col("user_id").cast("string"))), "job", "ts", 1)
    return S.run_to_table(stream, folder(spark, "unseen")).groupBy("job").agg(F.count("*").alias("times"))


@query("STM-3-state", ORACLE["STM-3"])
def unseen_state(spark, sf):
    """STM-3 over state in RocksDB with event-time timers."""
    rows = events(spark, sf).withColumn("job", F.concat("event_type", F.col("user_id").cast("string")))
    with rocksdb(spark):
        return S.run_to_table(unseen_keys(rows, "job", "ts", 1), folder(spark, "unseen")).groupBy("job").agg(F.count("*").alias("times"))


@query("STM-4", LIVING["LIF-4"])
def signups(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("email"), F.col("event_type").alias("city"), F.lit(None).cast("string").alias("category"), "ts", F.col("event_id").cast("string").alias("token"))
    return S.signup_stream(rows, folder(spark, "signups"))


@query("STM-5", "SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events WHERE ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2")
def daily(spark, sf):
    out = S.run_to_table(S.daily_counts(events(spark, sf), "event_type", "ts", "1 hour"), folder(spark, "daily"))
    return out.withColumn("day", F.col("day").cast("string"))


@query("SNK-2", "SELECT event_type AS source_id, count(*) AS fetched, 'success' AS status FROM events GROUP BY 1")
def run_table(spark, sf):
    """Counts of a run appended to the run table and read back."""
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("source_id")).agg(F.count("*").alias("fetched"))
    path = folder(spark, "runs")
    write_run_metrics(counts, path, "2001-08-02 00:00:00", "2001-08-02 00:01:00")
    return spark.read.parquet(path).select("source_id", "fetched", "status")


#: Sightings young enough to be read, resolved; all are seen now, so a job ends by its date alone and none is purged.
FRESH = f"""fresh AS (SELECT * FROM printed WHERE source_job_id IS NOT NULL AND posted_at >= {NOW} - to_days(30)),
wide AS (SELECT fingerprint, count(DISTINCT source_id) > 1 AS spans FROM fresh GROUP BY 1),
best AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN spans THEN fingerprint ELSE fingerprint || ':' || id END ORDER BY CASE split_part(source_id, ':', 1) WHEN 'jobbank' THEN 1 WHEN 'adzuna' THEN 2 ELSE 0 END, id) AS place FROM fresh JOIN wide USING (fingerprint)),
ended AS (SELECT least(coalesce(closes_at, posted_at + to_days(60)), posted_at + to_days(60)) <= {NOW} AS ended FROM best WHERE place = 1)"""


@query("SNK-5", f"WITH {SIGHTINGS}, {FRESH} SELECT NOT ended AS is_active, CASE WHEN ended THEN 'hard' END AS cause, count(*) AS n FROM ended GROUP BY ended")
def whole_pipeline(spark, sf):
    """Jobs that stay after all stages over the sightings, by activity and cause."""
    state = Snapshots(spark, folder(spark, "pipeline"))
    run_pipeline(state, printed(spark, sf).filter("source_job_id IS NOT NULL"), registry(spark, sf), as_of())
    return state.read("jobs").groupBy("is_active", "cause").agg(F.count("*").alias("n"))


THEN = f"{NOW} - to_days(1)"
SUMS = "count(*) AS fetched, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'skipped_old') AS skipped_old"
RUNS = f"""named AS (SELECT * FROM landed WHERE source_job_id IS NOT NULL), one AS (SELECT * FROM named WHERE id % 5 <> 0 AND posted_at >= {THEN} - to_days(30)),
two AS (SELECT * FROM named WHERE posted_at >= {NOW} - to_days(30) OR id IN (SELECT id FROM one)), {job_sql("a", "one", "closed_before")}, {job_sql("b", "two", "closes_at")},
again AS (SELECT j.*, o.dedupe_key IS NULL AS is_new, o.dedupe_key IS NULL OR o.ends <= {THEN} OR {DIFFERS} AS written, j.ends <= {NOW} AS ended FROM b_jobs j LEFT JOIN a_jobs o USING (dedupe_key)),
rest AS (SELECT ends <= {THEN} AS before, ends <= {NOW} AS ended FROM a_jobs ANTI JOIN b_jobs USING (dedupe_key)),
in1 AS (SELECT CASE WHEN posted_at < {THEN} - to_days(30) THEN 'skipped_old' ELSE 'inserted' END AS status FROM named WHERE id % 5 <> 0),
in2 AS (SELECT CASE WHEN o.id IS NOT NULL THEN CASE WHEN o.closes_at IS DISTINCT FROM o.closed_before THEN 'updated' ELSE 'unchanged' END WHEN n.posted_at < {NOW} - to_days(30) THEN 'skipped_old' ELSE 'inserted' END AS status FROM named n LEFT JOIN one o USING (id)),
sum1 AS (SELECT {SUMS} FROM in1), sum2 AS (SELECT {SUMS} FROM in2), sum3 AS (SELECT count(*) AS fetched, 0 AS inserted, 0 AS updated, count(*) FILTER (id IN (SELECT id FROM two)) AS unchanged, count(*) FILTER (id NOT IN (SELECT id FROM two)) AS skipped_old FROM named),
q AS (SELECT 1 AS run, count(*) FILTER (ends > {THEN}) AS x, count(*) FILTER (ends <= {THEN}) AS y FROM a_jobs UNION ALL
SELECT 2, count(*) FILTER (NOT ended), count(*) FILTER (ended) FROM (SELECT ended FROM again UNION ALL SELECT ended FROM rest) UNION ALL
SELECT 3, count(*) FILTER (o), count(*) FILTER (c) FROM (SELECT is_new AND NOT ended AS o, ended AS c FROM again UNION ALL SELECT false, ended AND NOT before FROM rest)),
told AS (SELECT run, least(45, x) AS opened, least(45 - least(45, x), y) AS closed FROM q)"""


@query("SNK-5-again", f"""WITH {SIGHTINGS}, {LANDED}, {RUNS} SELECT * FROM (
SELECT 1 AS run, sum1.*, (SELECT count(*) FROM a_jobs) AS jobs, (SELECT count(*) FROM a_jobs) AS written, 0 AS kept, (SELECT count(*) FROM a_links) AS new_links, (SELECT count(*) FILTER (ends <= {THEN}) FROM a_jobs) AS hard_expired FROM sum1 UNION ALL
SELECT 2, sum2.*, (SELECT count(*) FROM again), (SELECT count(*) FILTER (written) FROM again), (SELECT count(*) FILTER (NOT written) FROM again), (SELECT count(*) FROM b_links ANTI JOIN a_links USING (dedupe_key, id)),
  (SELECT count(*) FILTER (ended) FROM again) + (SELECT count(*) FILTER (ended AND NOT before) FROM rest) FROM sum2 UNION ALL
SELECT 3, sum3.*, (SELECT count(*) FROM again), (SELECT count(*) FILTER (ended) FROM again), (SELECT count(*) FILTER (NOT ended) FROM again), 0, (SELECT count(*) FILTER (ended) FROM again) FROM sum3) JOIN told USING (run)""")
def pipeline_again(spark, sf):
    """Reports of three runs: some sightings a day before, then all, then all again, each from the state of the last."""
    reports = _three_runs(spark, sf)
    return reports.select("run", "fetched", "inserted", "updated", "unchanged", "skipped_old", "jobs", "written", "kept", "new_links", "hard_expired", "opened", "closed")


def _three_runs(spark, sf):
    state, rows, reg = Snapshots(spark, folder(spark, "again")), printed(spark, sf).filter("source_job_id IS NOT NULL"), registry(spark, sf)
    day = F.make_interval(days=F.lit(1))
    reports = [run_pipeline(state, landed, reg, at).withColumn("run", F.lit(n)) for n, (landed, at) in enumerate([(first_landed(rows), as_of() - day), (rows, as_of()), (rows, as_of())], 1)]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])
