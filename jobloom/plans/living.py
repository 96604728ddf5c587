"""Queries of resolution, ingest, lifecycle and alerts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import lifecycle as L
from ..operators import resolve as R
from ..schema import CATEGORIES
from .bindings import ALERTS, AS_OF, JOBS, LIFE, SIGHTINGS, alerts, as_of, jobs, lifecycle_jobs, printed, seen, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


S = f"WITH {SIGHTINGS} "
NOW = f"TIMESTAMP '{AS_OF}'"


@query("RES-1", S + "SELECT id, fingerprint FROM printed")
def fingerprints(spark, sf):
    return printed(spark, sf).select("id", "fingerprint")


@query("RES-2", S + "SELECT id, group_key FROM grouped")
def grouping(spark, sf):
    return R.group_into_jobs(printed(spark, sf)).select("id", "group_key")


@query("RES-3", S + "SELECT source_id, CASE split_part(source_id, ':', 1) WHEN 'jobbank' THEN 1 WHEN 'adzuna' THEN 2 ELSE 0 END AS priority, count(*) AS n FROM sightings GROUP BY 1, 2")
def priority(spark, sf):
    return printed(spark, sf).groupBy("source_id", R.source_priority(F.col("source_id")).alias("priority")).agg(F.count("*").alias("n"))


@query("RES-4", S + "SELECT group_key, id FROM canonical WHERE place = 1 AND source_job_id IS NULL")
def quarantined(spark, sf):
    return R.split_identified(R.pick_canonical(R.group_into_jobs(printed(spark, sf))))[1].select("group_key", "id")


@query("WIN-2", S + "SELECT group_key, id, source_id, sightings FROM canonical WHERE place = 1")
def survivors(spark, sf):
    return R.pick_canonical(R.group_into_jobs(printed(spark, sf))).select("group_key", "id", "source_id", "sightings")


@query("AGG-13", S + "SELECT fingerprint, count(DISTINCT source_id) AS sources FROM printed GROUP BY 1 HAVING count(DISTINCT source_id) > 1")
def merged(spark, sf):
    return printed(spark, sf).groupBy("fingerprint").agg(F.countDistinct("source_id").alias("sources")).filter("sources > 1")


@query("RES-6", S + "SELECT id, least(coalesce(closes_at, posted_at + to_days(60)), posted_at + to_days(60))::VARCHAR AS expires_at FROM sightings")
def expiry(spark, sf):
    return printed(spark, sf).select("id", R.expires_at(F.col("posted_at"), F.col("closes_at")).cast("string").alias("expires_at"))


def registry(spark, sf):
    langs = table(spark, sf, "documents").select("lang").filter("lang IS NOT NULL").distinct()
    return langs.select(F.concat(F.lit("Employer "), F.col("lang")).alias("name"), F.concat(F.lit("e-"), F.col("lang")).alias("employer_id"), F.lit("Ottawa").alias("default_city"))


@query("JN-1", S + "SELECT id, 'e-' || lower(province) AS employer_id, CASE WHEN province IS NOT NULL THEN 'Ottawa' END AS default_city FROM sightings")
def enriched(spark, sf):
    return R.enrich_employer(printed(spark, sf), registry(spark, sf)).select("id", "employer_id", "default_city")


@query("PRJ-2", S + """, one AS (SELECT *, fingerprint || ':' || source_job_id AS dedupe_key, regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS dashed FROM canonical WHERE place = 1 AND source_job_id IS NOT NULL)
SELECT dedupe_key, substr(dashed, 1, 60) || '-' || substr(sha256(dedupe_key), 1, 8) AS slug, 'Toronto, Ontario' AS city, source_id AS canonical_source, least(coalesce(closes_at, posted_at + to_days(60)), posted_at + to_days(60))::VARCHAR AS expires_at FROM one""")
def job_rows(spark, sf):
    good, _ = R.split_identified(R.pick_canonical(R.group_into_jobs(printed(spark, sf))))
    return R.build_job_rows(good, registry(spark, sf)).select("dedupe_key", "slug", "city", "canonical_source", F.col("expires_at").cast("string").alias("expires_at"))


def earlier(df):
    """A snapshot before: some rows not yet there, some with another size, some without one."""
    old = F.when(F.col("id") % 7 == 0, F.col("n_chars") + 1).when(F.col("id") % 11 != 0, F.col("n_chars"))
    return df.filter("id % 5 != 0").withColumn("n_chars", old)


EARLIER = ", old AS (SELECT id, CASE WHEN id % 7 = 0 THEN n_chars + 1 WHEN id % 11 <> 0 THEN n_chars END AS n_chars, title FROM sightings WHERE id % 5 <> 0)"


@query("JN-2", S + EARLIER + " SELECT s.id, CASE WHEN o.id IS NULL THEN 'new' WHEN s.n_chars IS DISTINCT FROM o.n_chars OR s.title IS DISTINCT FROM o.title THEN 'changed' ELSE 'unchanged' END AS change FROM sightings s LEFT JOIN old o ON s.id = o.id")
def diff(spark, sf):
    rows = printed(spark, sf)
    return R.diff_snapshot(earlier(rows), rows, ["id"], ["n_chars", "title"]).select("id", "change")


@query("JN-3", S + "SELECT group_key AS job_key, id AS raw_id FROM grouped WHERE id % 3 <> 0")
def links(spark, sf):
    grouped = R.group_into_jobs(printed(spark, sf))
    pairs = grouped.select(F.col("group_key").alias("job_key"), F.col("id").alias("raw_id"))
    return R.new_links(pairs, pairs.filter("raw_id % 3 = 0"))


#: Two landed states of the same sightings: the first lacks some and has others with another closing date.
LANDED = """landed AS (SELECT *, CASE WHEN id % 7 <> 0 THEN closes_at END AS closed_before FROM printed)"""


def first_landed(rows):
    return rows.filter("id % 5 != 0").withColumn("closes_at", F.when(F.col("id") % 7 != 0, F.col("closes_at")))


def job_sql(name: str, rows: str, closes: str) -> str:
    """Groups, jobs and links of the rows ``rows`` in SQL, as tables ``name`` with an ending."""
    return f"""{name}_wide AS (SELECT fingerprint, count(DISTINCT source_id) > 1 AS spans FROM {rows} GROUP BY 1),
{name}_group AS (SELECT r.*, CASE WHEN spans THEN fingerprint ELSE fingerprint || ':' || id END AS group_key, {closes} AS closes FROM {rows} r JOIN {name}_wide USING (fingerprint)),
{name}_best AS (SELECT * FROM {name}_group QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY CASE split_part(source_id, ':', 1) WHEN 'jobbank' THEN 1 WHEN 'adzuna' THEN 2 ELSE 0 END, id) = 1),
{name}_jobs AS (SELECT group_key, fingerprint || ':' || source_job_id AS dedupe_key, title, employer_name, province, source_id, posted_at, closes, least(coalesce(closes, posted_at + to_days(60)), posted_at + to_days(60)) AS ends FROM {name}_best WHERE source_job_id IS NOT NULL),
{name}_links AS (SELECT DISTINCT dedupe_key, id FROM {name}_group JOIN {name}_jobs USING (group_key))"""


DIFFERS = "j.title IS DISTINCT FROM o.title OR j.employer_name IS DISTINCT FROM o.employer_name OR j.province IS DISTINCT FROM o.province OR j.source_id <> o.source_id OR j.posted_at <> o.posted_at OR j.closes IS DISTINCT FROM o.closes"


@query("RES-5", S + f""", {LANDED}, one AS (SELECT * FROM landed WHERE id % 5 <> 0), two AS (SELECT * FROM landed), {job_sql("a", "one", "closed_before")}, {job_sql("b", "two", "closes_at")}
SELECT 1 AS run, count(*) AS jobs, 0 AS unchanged, count(*) AS written, (SELECT count(*) FROM (SELECT group_key FROM a_group SEMI JOIN a_jobs USING (group_key) GROUP BY 1 HAVING count(DISTINCT source_id) > 1)) AS merges, (SELECT count(*) FROM a_links) AS links FROM a_jobs UNION ALL
SELECT 2, count(*), count(*) FILTER (o.dedupe_key IS NOT NULL AND NOT ({DIFFERS})), count(*) FILTER (o.dedupe_key IS NULL OR {DIFFERS}), (SELECT count(*) FROM (SELECT group_key FROM b_group SEMI JOIN b_jobs USING (group_key) GROUP BY 1 HAVING count(DISTINCT source_id) > 1)),
  (SELECT count(*) FROM b_links ANTI JOIN a_links USING (dedupe_key, id)) FROM b_jobs j LEFT JOIN a_jobs o USING (dedupe_key) UNION ALL
SELECT 3, count(*), count(*), 0, (SELECT count(*) FROM (SELECT group_key FROM b_group SEMI JOIN b_jobs USING (group_key) GROUP BY 1 HAVING count(DISTINCT source_id) > 1)), 0 FROM b_jobs""")
def resolved(spark, sf):
    """Three resolutions, each from the jobs and links of the one before: some rows, all rows, all rows again."""
    raw, reg = printed(spark, sf), registry(spark, sf)
    jobs = R.build_job_rows(raw.limit(0), reg)
    links, out = raw.select(F.col("fingerprint").alias("job_key"), F.col("id").alias("raw_id")).limit(0), []
    for run, rows in enumerate((first_landed(raw), raw, raw), 1):
        found = R.resolve(rows, reg, jobs, links)
        out.append(found["stats"].crossJoin(found["links"].agg(F.count("*").alias("links"))).withColumn("run", F.lit(run)))  # one row each
        jobs, links = found["jobs"].drop("change"), links.union(found["links"])
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("LIF-3", S + EARLIER + " SELECT s.id, CASE WHEN o.id IS NULL THEN 'inserted' WHEN s.n_chars IS DISTINCT FROM o.n_chars THEN 'updated' ELSE 'unchanged' END AS status FROM sightings s LEFT JOIN old o ON s.id = o.id")
def change_classes(spark, sf):
    hashed = lambda df: df.withColumn("content_hash", R.content_hash(["title", "n_chars"]))
    rows = printed(spark, sf)
    return R.classify_change(hashed(earlier(rows)).select("id", "content_hash"), hashed(rows), ["id"]).select("id", "status")


OUTCOME = EARLIER + f""", c AS (SELECT source_id, CASE WHEN o.id IS NULL THEN CASE WHEN posted_at < {NOW} - to_days(30) THEN 'skipped_old' ELSE 'inserted' END WHEN s.n_chars IS DISTINCT FROM o.n_chars THEN 'updated' ELSE 'unchanged' END AS status FROM sightings s LEFT JOIN old o ON s.id = o.id)
SELECT source_id, count(*) AS fetched, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'skipped_old') AS skipped_old FROM c GROUP BY 1"""


@query("AGG-12", S + OUTCOME)
def accounting(spark, sf):
    hashed = lambda df: df.withColumn("content_hash", R.content_hash(["title", "n_chars"]))
    rows = printed(spark, sf)
    return L.ingest_counts(L.classify_batch(hashed(rows), hashed(earlier(rows)).select("id", "content_hash"), as_of(), ["id"]))


@query("SNK-1", S + EARLIER + f" SELECT coalesce(s.id, o.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.n_chars ELSE o.n_chars END AS n_chars, CASE WHEN o.id IS NOT NULL THEN '2001-07-01 00:00:00' ELSE '{AS_OF} 00:00:00' END AS first_seen_at, CASE WHEN s.id IS NOT NULL THEN '{AS_OF} 00:00:00' ELSE '2001-07-01 00:00:00' END AS last_seen_at FROM (SELECT * FROM sightings WHERE id % 4 <> 0) s FULL JOIN old o ON s.id = o.id")
def upsert(spark, sf):
    before = F.lit("2001-07-01").cast("timestamp")
    rows = printed(spark, sf).select("id", "n_chars")
    old = earlier(rows).withColumns({"first_seen_at": before, "last_seen_at": before})
    out = L.merge_raw(old, rows.filter("id % 4 != 0"), as_of(), ["id"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_seen_at", "last_seen_at")})


CUT = f"SELECT id FROM sightings s WHERE id IN (SELECT id FROM sightings WHERE id % 5 = 0) OR posted_at >= {NOW} - to_days(30)"


@query("FLT-3", S + CUT)
def cutoff(spark, sf):
    rows = printed(spark, sf)
    return L.drop_too_old(rows, rows.filter("id % 5 = 0").select("id"), as_of(), ["id"]).select("id")


@query("FLT-4", S + "SELECT id, CASE WHEN id % 5 = 0 THEN 'touch' ELSE 'read' END AS step FROM sightings")
def known(spark, sf):
    rows = printed(spark, sf).select("id")
    read, touch = L.split_known(rows, rows.filter("id % 5 = 0"), ["id"])
    return read.withColumn("step", F.lit("read")).union(touch.withColumn("step", F.lit("touch")))


@query("ING-1", S + OUTCOME)
def ingest(spark, sf):
    hashed = lambda df: df.withColumn("content_hash", R.content_hash(["title", "n_chars"]))
    rows = printed(spark, sf)
    before = F.lit("2001-07-01").cast("timestamp")
    old = hashed(earlier(rows)).withColumns({"first_seen_at": before, "last_seen_at": before})
    return L.ingest_batch(hashed(rows), old, as_of(), ["id"])["counts"]


@query("ING-2", "SELECT event_id AS raw_id, CASE WHEN event_type IN ('click', 'view') AND event_id % 3 = 0 THEN '2001-08-02 00:00:00' ELSE strftime(ts - to_days(8218), '%Y-%m-%d %H:%M:%S') END AS last_seen_at FROM events")
def touch(spark, sf):
    _, raw = seen(spark, sf)
    complete = raw.select("source_id").distinct().withColumn("complete", F.col("source_id").isin("click", "view"))
    out = L.touch_complete(raw, raw.filter("raw_id % 3 = 0").select("raw_id", "source_id"), complete, as_of(), ["raw_id"])
    return out.select("raw_id", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at"))


@query("ING-3", S + "SELECT id, concat_ws(',', CASE WHEN source_job_id IS NULL THEN 'no_id' END, CASE WHEN NOT coalesce(n_chars > 300, false) THEN 'short' END) AS error FROM sightings WHERE source_job_id IS NULL OR NOT coalesce(n_chars > 300, false)")
def isolated(spark, sf):
    return L.split_valid(printed(spark, sf), {"no_id": F.col("source_job_id").isNotNull(), "short": F.col("n_chars") > 300})[1].select("id", "error")


LW = f"WITH {LIFE} "


@query("JN-4", LW + "SELECT job_id FROM life WHERE is_active AND job_id NOT IN (SELECT job_id FROM seen_jobs)")
def unseen(spark, sf):
    ln, raw = seen(spark, sf)
    return L.unseen_jobs(lifecycle_jobs(spark, sf), ln, raw, as_of()).select("job_id")


EXPIRED = f"cause AS (SELECT *, CASE WHEN is_active AND expires_at <= {NOW} THEN 'hard' WHEN is_active AND job_id NOT IN (SELECT job_id FROM seen_jobs) THEN 'unseen' END AS cause FROM life)"


@query("LIF-1", LW + f", {EXPIRED} SELECT job_id, cause, is_active AND cause IS NULL AS is_active FROM cause")
def expire(spark, sf):
    ln, raw = seen(spark, sf)
    return L.expire(lifecycle_jobs(spark, sf), ln, raw, as_of())[0].select("job_id", "cause", "is_active")


@query("SET-2", LW + f", {EXPIRED} SELECT count(*) FILTER (cause = 'hard') AS hard_expired, count(*) FILTER (cause = 'unseen') AS unseen_expired FROM cause")
def expire_counts(spark, sf):
    ln, raw = seen(spark, sf)
    return L.expire(lifecycle_jobs(spark, sf), ln, raw, as_of())[1]


PURGED = f"victims AS (SELECT * FROM life WHERE slug <> 'job-8' AND (posted_at < {NOW} - to_days(60) OR (NOT is_active AND job_id NOT IN (SELECT job_id FROM seen_jobs)))), gone AS (SELECT DISTINCT raw_id FROM links WHERE job_id IN (SELECT job_id FROM victims)), raw2 AS (SELECT * FROM rawp WHERE raw_id NOT IN (SELECT raw_id FROM gone)), links2 AS (SELECT * FROM links WHERE raw_id NOT IN (SELECT raw_id FROM gone)), stray AS (SELECT raw_id FROM raw2 WHERE last_seen_at < {NOW} - to_days(7) AND raw_id NOT IN (SELECT raw_id FROM links2))"


@query("SET-3", LW + f", {PURGED} SELECT job_id, slug FROM victims")
def candidates(spark, sf):
    ln, raw = seen(spark, sf)
    return L.purge_candidates(lifecycle_jobs(spark, sf), ln, raw, as_of(), protected="job-8").select("job_id", "slug")


@query("JN-5", LW + f", {PURGED} SELECT raw_id FROM raw2")
def cascade(spark, sf):
    ln, raw = seen(spark, sf)
    victims = L.purge_candidates(lifecycle_jobs(spark, sf), ln, raw, as_of(), protected="job-8")
    return L.cascade_delete(raw, ln, victims)[0].select("raw_id")


@query("JN-6", LW + f" SELECT raw_id FROM rawp WHERE last_seen_at < {NOW} - to_days(7) AND raw_id NOT IN (SELECT raw_id FROM links)")
def orphaned(spark, sf):
    ln, raw = seen(spark, sf)
    return L.orphans(raw, ln, as_of()).select("raw_id")


@query("LIF-2", LW + f", {PURGED.replace(chr(39) + 'job-8' + chr(39), chr(39) + 'none' + chr(39))} SELECT (SELECT count(*) FROM victims) AS jobs_purged, (SELECT count(*) FROM gone) + (SELECT count(*) FROM stray) AS raw_postings_purged")
def purge(spark, sf):
    ln, raw = seen(spark, sf)
    life = lifecycle_jobs(spark, sf)
    return L.purge(life, ln, raw, life.select("slug").limit(0), as_of())["counts"]


@query("SNK-3", LW + f", {PURGED}, old AS (SELECT slug FROM life WHERE job_id % 3 = 0) SELECT slug FROM old UNION SELECT slug FROM victims")
def tombstones(spark, sf):
    ln, raw = seen(spark, sf)
    life = lifecycle_jobs(spark, sf)
    return L.append_tombstones(life.filter("job_id % 3 = 0").select("slug"), L.purge_candidates(life, ln, raw, as_of(), protected="job-8"))


QUERIES["SET-4"], ORACLE["SET-4"] = tombstones, ORACLE["SNK-3"]


@query("LIF-7", "SELECT since0[:19] AS since FROM (SELECT coalesce(max(ts) FILTER (user_id = 8 AND event_type <> 'error'), TIMESTAMP '2001-08-01')::VARCHAR AS since0 FROM events)")
def since(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    return L.since(runs, "8", as_of()).select(F.substring(F.col("since").cast("string"), 1, 19).alias("since"))


AW = f"WITH {JOBS}, {ALERTS} "
MATCH = "hits AS (SELECT alert_id, id AS job_id, posted_at FROM alerts a JOIN jobs j ON j.is_active AND a.is_active AND confirmed_at IS NOT NULL AND (a.city IS NULL OR a.city = j.city) AND (a.category IS NULL OR a.category = j.category) AND posted_at > coalesce(last_sent_at, confirmed_at))"


@query("DIG-1", AW + "SELECT alert_id FROM alerts WHERE is_active AND confirmed_at IS NOT NULL")
def eligible(spark, sf):
    return A.eligible(alerts(spark, sf)).select("alert_id")


@query("JN-7", AW + f", {MATCH} SELECT alert_id, job_id FROM hits")
def matched(spark, sf):
    return A.match_alerts(alerts(spark, sf), jobs(spark, sf)).select("alert_id", "job_id")


@query("DIG-2", AW + f", {MATCH} SELECT alert_id, count(*) AS n, string_agg(job_id::VARCHAR, ',' ORDER BY posted_at DESC, job_id) AS jobs, count(*) || CASE WHEN count(*) = 1 THEN ' new job' ELSE ' new jobs' END AS subject FROM hits GROUP BY 1")
def digest(spark, sf):
    return A.digests(alerts(spark, sf), jobs(spark, sf), shown=lambda ids: F.array_join(F.transform(ids, lambda j: j.cast("string")), ","))


@query("DIG-2-heads", AW + f", {MATCH} SELECT alert_id, city, category, count(*) AS n, count(*) || CASE WHEN count(*) = 1 THEN ' new job' ELSE ' new jobs' END AS subject FROM hits JOIN alerts USING (alert_id) GROUP BY 1, 2, 3")
def digest_heads(spark, sf):
    """What each digest says, from places alone: its list is the first n of its criteria's."""
    return A.digest_heads(A.places(alerts(spark, sf), jobs(spark, sf))[0])


@query("DIG-2-lists", AW + """, p AS (SELECT CASE WHEN k % 2 = 0 THEN city END AS city, CASE WHEN k < 2 THEN category END AS category, id, posted_at FROM jobs, (SELECT unnest(range(4)) AS k) WHERE is_active)
SELECT city, category, row_number() OVER (PARTITION BY city, category ORDER BY posted_at DESC, id) AS place, id AS job_id FROM (SELECT DISTINCT * FROM p)""")
def digest_lists(spark, sf):
    """The lists of all criteria, of which each alert has a head."""
    return A.places(alerts(spark, sf), jobs(spark, sf))[1].drop("posted_at")


@query("DIG-2-rows", AW + f", {MATCH} SELECT alert_id, row_number() OVER (PARTITION BY alert_id ORDER BY posted_at DESC, job_id) AS rank, job_id FROM hits")
def digest_lines(spark, sf):
    """DIG-2's lists as rows, so that an alert that takes every job is no single value."""
    return A.digest_rows(alerts(spark, sf), jobs(spark, sf)).drop("posted_at")


@query("LIF-5", AW + "SELECT alert_id, (CASE WHEN is_active AND alert_id % 6 = 0 THEN coalesce(confirmed_at, TIMESTAMP '2001-08-01') ELSE confirmed_at END)::VARCHAR AS confirmed_at, is_active AND alert_id % 6 <> 1 AS is_active FROM alerts")
def tokens(spark, sf):
    a = alerts(spark, sf)
    clicks = a.filter("alert_id % 6 < 2").select("token", F.when(F.col("alert_id") % 6 == 0, "confirm").otherwise("unsubscribe").alias("action"), F.lit("2001-08-01").cast("timestamp").alias("ts"))
    return A.apply_tokens(a, clicks.union(clicks)).select("alert_id", F.col("confirmed_at").cast("string").alias("confirmed_at"), "is_active")


@query("LIF-6", AW + f"SELECT alert_id, (CASE WHEN alert_id % 2 = 0 THEN {NOW} ELSE last_sent_at END)::VARCHAR AS last_sent_at FROM alerts")
def watermark(spark, sf):
    a = alerts(spark, sf)
    return A.advance_watermark(a, a.filter("alert_id % 2 = 0").select("alert_id"), as_of()).select("alert_id", F.col("last_sent_at").cast("string").alias("last_sent_at"))


@query("SRT-5", LW + f" SELECT slug, type FROM (SELECT slug, 'URL_UPDATED' AS type, 0 AS p, created_at AS t FROM life WHERE is_active AND created_at >= {NOW} - to_days(1) UNION ALL SELECT slug, 'URL_DELETED', 1, updated_at FROM life WHERE NOT is_active AND updated_at >= {NOW} - to_days(1)) ORDER BY p, t DESC, slug LIMIT 45")
def queue(spark, sf):
    return A.notify_queue(lifecycle_jobs(spark, sf), as_of() - F.make_interval(days=F.lit(1)))


@query("FLT-10", "SELECT c_custkey AS id, lower(trim(c_name)) || '@example.org' AS email, CASE WHEN c_custkey % 3 <> 0 THEN 'Town ' || c_nationkey END AS city, CASE WHEN c_custkey % 4 = 0 THEN 'nursing' END AS category FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def signups(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.alias("id"),
        F.when(k % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("@example.org "))).alias("email"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, F.repeat(F.lit("x"), F.lit(101))).otherwise("  ")).otherwise(F.concat(F.lit("Town "), F.col("c_nationkey").cast("string"))).alias("city"),
        F.when(k % 4 == 0, "nursing").otherwise("plumbing").alias("category"),
        F.when(k % 7 == 0, "spam").alias("website"),
    )
    return A.validate_signups(rows, CATEGORIES).select("id", "email", "city", "category")


@query("LIF-4", """WITH RECURSIVE r AS (SELECT event_id AS request_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT request_id, user_id, event_type, ts AS sent, k, 'send' AS outcome FROM r WHERE k = 1
UNION ALL SELECT r.request_id, r.user_id, r.event_type, CASE WHEN w.sent > r.ts - INTERVAL 10 MINUTE THEN w.sent ELSE r.ts END, r.k, CASE WHEN w.sent > r.ts - INTERVAL 10 MINUTE THEN 'throttled' ELSE 'send' END FROM w JOIN r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.k = w.k + 1)
SELECT request_id, outcome FROM w""")
def signup_states(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("email"), F.col("event_type").alias("city"), F.lit(None).cast("string").alias("category"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("token"))
    return A.apply_signups(rows)


@query("SET-1", "SELECT DISTINCT c_mktsegment AS employer_name, c_nationkey AS place FROM customer")
def distinct_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("employer_name"), F.col("c_nationkey").alias("place")).dropDuplicates()
