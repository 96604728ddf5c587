"""Queries of the read side, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import is_plausible_band
from ..functions.rules import role_of
from ..operators import serve as S
from ..operators.ordered import quantiles
from .bindings import BANDS, JOBS, bands, jobs, table

QUERIES, ORACLE = {}, {}
TYPES = ("O", "P", "F")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


WITH = f"WITH {JOBS} "
FEED = f"""WITH {JOBS}, feed AS (SELECT *, posted_at::DATE AS posted_day, row_number() OVER (PARTITION BY employer_name, posted_at::DATE ORDER BY posted_at DESC, id) AS employer_day_rank FROM jobs WHERE is_active) """
FILTERS = {"city": ["NATION_1", "NATION_7"], "category": ["1-URGENT", "2-HIGH"], "employment_type": ["O"]}


@query("SRC-1", WITH + "SELECT id, employer_name, city, category FROM jobs WHERE is_active")
def scan(spark, sf):
    return S.scan_active(jobs(spark, sf), ["id", "employer_name", "city", "category"])


@query("PRJ-1", WITH + "SELECT id, NULL::VARCHAR AS role, trim(regexp_replace(lower(employer_name), '[^a-z0-9]+', '-', 'g'), '-') AS employer_slug FROM jobs WHERE is_active")
def catalog(spark, sf):
    return S.catalog(jobs(spark, sf), role_of(F.col("company"))).select("id", "role", "employer_slug")


@query("FLT-1", WITH + "SELECT id FROM jobs WHERE city IN ('NATION_1', 'NATION_7') AND category IN ('1-URGENT', '2-HIGH') AND employment_type IN ('O')")
def facets(spark, sf):
    return S.apply_facets(jobs(spark, sf), FILTERS | {"province": []}).select("id")


@query("FLT-6", f"WITH {BANDS} SELECT b.id, g.id IS NOT NULL AS plausible FROM bands b LEFT JOIN good g ON b.id = g.id")
def plausible(spark, sf):
    return bands(spark, sf).select("id", is_plausible_band(F.col("salary_min"), F.col("salary_max"), F.col("salary_period")).alias("plausible"))


@query("FLT-8", WITH + "SELECT city, count(*) AS n FROM jobs WHERE is_active AND category IS NOT NULL GROUP BY city HAVING count(*) >= 3")
def indexable(spark, sf):
    counts = jobs(spark, sf).filter("is_active AND category IS NOT NULL").groupBy("city").agg(F.count("*").alias("n"))
    return S.indexable(counts, 3, "city")


@query("FLT-9", WITH + """SELECT 'job-' || l_orderkey AS slug, CASE WHEN j.id IS NOT NULL AND j.is_active THEN 'active' WHEN l_orderkey % 2 = 0 THEN 'gone' ELSE 'unknown' END AS status
FROM (SELECT DISTINCT l_orderkey + 5 AS l_orderkey FROM lineitem) LEFT JOIN jobs j ON j.id = l_orderkey""")
def lookup(spark, sf):
    slugs = table(spark, sf, "lineitem").select((F.col("l_orderkey") + 5).alias("k")).distinct()
    named = slugs.select(F.concat(F.lit("job-"), F.col("k").cast("string")).alias("slug"), "k")
    return S.lookup_slug(named.select("slug"), jobs(spark, sf), named.filter("k % 2 = 0"))


@query("AGG-1", WITH + "SELECT category, count(*) AS n FROM jobs WHERE category IS NOT NULL GROUP BY 1")
def count_by(spark, sf):
    return S.count_by(jobs(spark, sf), "category")


@query("AGG-2", WITH + "SELECT company, count(*) AS n FROM jobs WHERE company <> '' GROUP BY 1")
def tally(spark, sf):
    return S.tally(jobs(spark, sf), "company")


@query("AGG-3", WITH + "SELECT city, category, count(*) AS n FROM jobs WHERE is_active AND category IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def pairs(spark, sf):
    return S.pair_counts(jobs(spark, sf).filter("is_active"))


@query("AGG-4", WITH + """SELECT facet, value, sum(ok::INT)::BIGINT AS n FROM (
SELECT 'city' AS facet, city AS value, coalesce(category IN ('1-URGENT', '2-HIGH'), false) AND employment_type = 'O' AS ok FROM jobs WHERE is_active
UNION ALL SELECT 'category', category, city IN ('NATION_1', 'NATION_7') AND employment_type = 'O' FROM jobs WHERE is_active
UNION ALL SELECT 'employment_type', employment_type, city IN ('NATION_1', 'NATION_7') AND coalesce(category IN ('1-URGENT', '2-HIGH'), false) FROM jobs WHERE is_active
UNION ALL SELECT 'employer_name', employer_name, city IN ('NATION_1', 'NATION_7') AND coalesce(category IN ('1-URGENT', '2-HIGH'), false) AND employment_type = 'O' FROM jobs WHERE is_active)
WHERE value IS NOT NULL GROUP BY 1, 2""")
def facet_counts(spark, sf):
    return S.facet_counts(jobs(spark, sf).filter("is_active"), FILTERS, ["city", "category", "employment_type", "employer_name"])


SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


def _set(kind: str, keys: list[str], least: int) -> str:
    path = " || '/' || ".join([f"'{kind}'", *(SLUG.format(k + "::VARCHAR") for k in keys)])
    return f"SELECT '{kind}' AS kind, {path} AS path, count(*) AS n, max(updated_at)::VARCHAR AS last FROM jobs WHERE is_active AND {' AND '.join(k + ' IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)} HAVING count(*) >= {least}"


SETS = {"category": ["category"], "province": ["province"], "province-category": ["province", "category"], "employer": ["employer_name"], "company": ["company"], "city": ["city"], "city-category": ["city", "category"], "employer-province": ["employer_name", "province"], "employer-city": ["employer_name", "city"], "job": ["slug"]}
LEAST = {"city": 3, "city-category": 3, "company": 5}


@query("AGG-5", WITH + " UNION ALL ".join(_set(kind, keys, LEAST.get(kind, 1)) for kind, keys in SETS.items()))
def sitemap(spark, sf):
    out = S.landing_sets(jobs(spark, sf).filter("is_active"), SETS, LEAST)
    return out.withColumn("last", F.col("last").cast("string"))


PAY = """per AS (SELECT {0}, salary_period AS period, count(*) AS n, quantile_cont((salary_min + salary_max) / 2, 0.5) AS median, quantile_cont((salary_min + salary_max) / 2, 0.25) AS p25,
quantile_cont((salary_min + salary_max) / 2, 0.75) AS p75, min(salary_min) AS low, max(salary_max) AS high FROM good GROUP BY {0}, salary_period),
pay AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY n DESC, period <> 'hour') AS place FROM per) WHERE place = 1)"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("median", "p25", "p75", "low", "high"))


@query("AGG-6", f"WITH {BANDS}, {PAY.format('city')} SELECT city, period, n, {ROUND} FROM pay")
def pay(spark, sf):
    return _rounded(S.summarize_pay(bands(spark, sf), ["city"]), "median", "p25", "p75", "low", "high")


@query("AGG-7", f"""WITH {BANDS}, {PAY.format('category, province')}, {PAY.format('category').replace('per AS', 'per2 AS').replace('FROM per)', 'FROM per2)').replace('pay AS', 'pay2 AS')}
SELECT pay.category, province, pay.period, pay.n, {ROUND.replace('round(', 'round(pay.')} FROM pay JOIN pay2 ON pay.category = pay2.category AND pay.period = pay2.period WHERE pay2.n >= 5""")
def guide(spark, sf):
    return _rounded(S.pay_guide(bands(spark, sf), "category", "province", 5), "median", "p25", "p75", "low", "high")


@query("AGG-8", WITH + """, g AS (SELECT city, count(*) AS n, array_to_string(list_sort(list(DISTINCT employer_name)), ', ') AS employers,
array_to_string(list_filter(['O', 'P', 'F'], lambda t: list_contains(list(DISTINCT employment_type), t)), ', ') AS types, count(salary_period) AS paid,
count(*) FILTER (salary_period = 'hour') AS h, count(*) FILTER (salary_period = 'year') AS y, min(salary_min) FILTER (salary_period = 'hour') AS lh, max(salary_max) FILTER (salary_period = 'hour') AS hh,
min(salary_min) FILTER (salary_period = 'year') AS ly, max(salary_max) FILTER (salary_period = 'year') AS hy, max(posted_at)::VARCHAR AS newest FROM jobs WHERE is_active GROUP BY city)
SELECT city, n, employers, types, paid, CASE WHEN h >= y AND h > 0 THEN 'hour' WHEN y > 0 THEN 'year' END AS period, CASE WHEN h >= y AND h > 0 THEN lh ELSE ly END AS pay_low, CASE WHEN h >= y AND h > 0 THEN hh ELSE hy END AS pay_high, newest FROM g""")
def glance(spark, sf):
    return S.glance(jobs(spark, sf).filter("is_active"), ["city"], TYPES).withColumn("newest", F.col("newest").cast("string"))


@query("AGG-9", WITH + "SELECT employer_name, province, n FROM (SELECT employer_name, province, count(*) AS n, row_number() OVER (PARTITION BY employer_name ORDER BY count(*) DESC, province) AS r FROM jobs GROUP BY 1, 2) WHERE r = 1")
def mode(spark, sf):
    return S.mode_by(jobs(spark, sf), ["employer_name"], "province")


@query("AGG-10", WITH + "SELECT province, array_to_string(list_sort(list(DISTINCT city)), ',') AS items FROM jobs WHERE is_active GROUP BY 1")
def cities(spark, sf):
    return S.distinct_sorted(jobs(spark, sf).filter("is_active"), "province", "city").withColumn("items", F.array_join("items", ","))


@query("AGG-11", WITH + "SELECT CASE WHEN count(DISTINCT province) = 1 THEN min(province) ELSE 'Canada' END AS region FROM jobs WHERE is_active")
def region(spark, sf):
    return S.region_name(jobs(spark, sf).filter("is_active"))


@query("AGG-14", WITH + "SELECT province, category, link, n, rank FROM (SELECT province, category, city AS link, count(*) AS n, row_number() OVER (PARTITION BY province, category ORDER BY count(*) DESC, city) AS rank FROM jobs WHERE is_active AND category IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3) WHERE rank <= 15")
def links(spark, sf):
    out = S.landing_links(jobs(spark, sf).filter("is_active AND category IS NOT NULL"), ["province", "category"], "city", 3, 15, plausible=True)
    return out.select("province", "category", F.col("city").alias("link"), "n", F.col("rank").cast("long").alias("rank"))


@query("AGG-15", WITH + f"""SELECT count(*) AS active, count(*) FILTER (posted_at::DATE = DATE '2001-08-01') AS today, count(DISTINCT employer_name) AS employers,
(SELECT string_agg(category, ',' ORDER BY n DESC, category) FROM (SELECT category, count(*) AS n FROM jobs WHERE is_active AND category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2)) AS top_categories,
(SELECT employment_type FROM jobs WHERE is_active GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_type FROM jobs WHERE is_active""")
def overview(spark, sf):
    return S.overview(jobs(spark, sf), F.lit("2001-08-01").cast("timestamp"))


@query("WIN-1", FEED + "SELECT id, posted_day::VARCHAR AS posted_day, employer_day_rank FROM feed")
def feed(spark, sf):
    return S.feed_rank(jobs(spark, sf)).select("id", F.col("posted_day").cast("string").alias("posted_day"), F.col("employer_day_rank").cast("long").alias("employer_day_rank"))


@query("WIN-3", WITH + "SELECT category, id, rank FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY posted_at DESC, id) AS rank FROM jobs WHERE is_active) WHERE rank <= 15")
def newest(spark, sf):
    return S.newest(jobs(spark, sf).filter("is_active"), ["category"], 15).select("category", "id", F.col("rank").cast("long").alias("rank"))


@query("WIN-4", "SELECT event_type AS source_id, min(floor(event_id / 100))::BIGINT AS page_offset, user_id AS job_id FROM events GROUP BY 1, 3")
def novelty(spark, sf):
    from ..operators.lifecycle import fresh_rows

    pages = table(spark, sf, "events").select(F.col("event_type").alias("source_id"), F.floor(F.col("event_id") / 100).alias("page_offset"), F.col("user_id").alias("job_id"))
    return fresh_rows(pages)


@query("WIN-4-pages", """WITH r AS (SELECT event_type AS source_id, (event_id // 100 * 20)::BIGINT AS page, user_id % 97 AS job_id FROM events),
f AS (SELECT source_id, page, job_id, row_number() OVER (PARTITION BY source_id, job_id ORDER BY page) = 1 AS fresh FROM r),
p AS (SELECT source_id, page, count(*) AS n, count(*) FILTER (fresh) AS fresh, row_number() OVER (PARTITION BY source_id ORDER BY page) - 1 AS k FROM f GROUP BY 1, 2),
e AS (SELECT source_id, min(page) FILTER (n < 12 OR fresh = 0 OR page + 20 >= 1500) AS stop, max(page) FILTER (page = k * 20) AS held FROM p GROUP BY 1)
SELECT source_id, least(stop, held) AS last_page, max(page) FILTER (fresh > 0) AS last_useful_page FROM p JOIN e USING (source_id) WHERE page <= least(stop, held) GROUP BY 1, 2""")
def crawl_end(spark, sf):
    """Where crawls end whose lists repeat; of a hundred events each type's make one page, full from twelve rows on."""
    from ..operators.lifecycle import crawl_ends

    page = F.floor(F.col("event_id") / 100) * 20
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source_id"), page.alias("page_offset"), (F.col("user_id") % 97).alias("job_id"))
    return crawl_ends(rows, 20, 1500, least=12)


ORDERED = "ORDER BY posted_day DESC, employer_day_rank, posted_at DESC, id"


@query("SRT-1", FEED + f"SELECT id, row_number() OVER ({ORDERED}) AS place FROM feed")
def newest_feed(spark, sf):
    return S.placed(S.feed_rank(jobs(spark, sf)), S.newest_order()).select("id", "place")


@query("SRT-2", FEED + "SELECT id, salary_min, row_number() OVER (ORDER BY salary_min DESC NULLS LAST, id) AS place FROM feed")
def salary_feed(spark, sf):
    return S.placed(S.feed_rank(jobs(spark, sf)), S.salary_order()).select("id", "salary_min", "place")


@query("SRT-3", FEED + f"SELECT id, total FROM (SELECT *, count(*) OVER () AS total FROM feed WHERE category = '1-URGENT') {ORDERED} LIMIT 25 OFFSET 50")
def one_page(spark, sf):
    hits = S.feed_rank(jobs(spark, sf)).filter("category = '1-URGENT'")
    total = hits.agg(F.count("*").alias("total"))
    return S.page(hits, 3).select("id").crossJoin(total)  # one row of totals


@query("SRT-4", WITH + ", t AS (SELECT id, posted_at::DATE = DATE '2001-08-01' AS is_today, row_number() OVER (ORDER BY (posted_at::DATE = DATE '2001-08-01') DESC, posted_at DESC, id) AS r FROM jobs WHERE is_active) SELECT id, is_today FROM t WHERE r <= 4 AND (is_today OR NOT EXISTS (SELECT 1 FROM t WHERE is_today))")
def recent(spark, sf):
    return S.today_or_recent(jobs(spark, sf), F.lit("2001-08-01").cast("timestamp")).select("id", "is_today")


def _tier(tier: int, keys: list[str], null: bool) -> str:
    test = "a.category IS NULL" if null else "a.category IS NOT NULL"
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    part = ", ".join(keys)
    pool = "" if null else "WHERE category IS NOT NULL"
    return f"SELECT a.id, b.id AS other, b.posted_at, {tier} AS tier FROM act a JOIN (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY posted_at DESC, id) AS r FROM act {pool}) b ON {on} AND a.id <> b.id AND r <= 40 WHERE {test}"


@query("JN-8", f"""WITH {JOBS}, act AS (SELECT * FROM jobs WHERE is_active), pairs AS ({' UNION ALL '.join([_tier(1, ['category', 'city'], False), _tier(2, ['category', 'province'], False), _tier(3, ['category'], False), _tier(1, ['city'], True), _tier(2, ['province'], True)])}),
best AS (SELECT id, other, min(tier) AS tier, max(posted_at) AS posted_at FROM pairs GROUP BY 1, 2)
SELECT id, rank, other, tier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, posted_at DESC, other) AS rank FROM best) WHERE rank <= 3""")
def similar(spark, sf):
    return S.similar_jobs(jobs(spark, sf)).select("id", F.col("rank").cast("long").alias("rank"), "other", "tier")


@query("JN-9", WITH + ", k AS (SELECT lower(trim(city)) AS k, province AS p, min(city) AS match FROM jobs GROUP BY 1, 2) SELECT s_suppkey AS id, match FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN k ON k = lower(n_name) AND p = r_name")
def match_city(spark, sf):
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    locs = table(spark, sf, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.lower("n_name").alias("city"), F.col("r_name").alias("province"))
    return S.match_city(locs, jobs(spark, sf)).select("id", "match")


@query("JN-10", WITH + ", c AS (SELECT trim(regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), '-') AS k, min(city) AS match, count(DISTINCT city) AS collide FROM jobs GROUP BY 1) SELECT s_suppkey AS id, match, collide FROM (SELECT s_suppkey, 'nation-' || (s_suppkey % 30) AS slug FROM supplier) LEFT JOIN c ON slug = k")
def resolve_slug(spark, sf):
    slugs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("nation-"), (F.col("s_suppkey") % 30).cast("string")).alias("slug"))
    return S.resolve_slug(slugs, jobs(spark, sf)).select("id", "match", "collide")


@query("JN-11", WITH + "SELECT id, slug FROM jobs WHERE is_active AND id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def saved(spark, sf):
    marked = table(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("slug"))
    return S.saved_jobs(marked, jobs(spark, sf)).select("id", "slug")


@query("NUM-3", f"WITH {BANDS} SELECT province, round(quantile_cont(salary_min, 0.9), 6) AS p90 FROM bands GROUP BY 1")
def quantile(spark, sf):
    found = quantiles(bands(spark, sf), ["province"], "salary_min", {"p90": 0.9})
    return found.select("province", F.round("p90", 6).alias("p90"))
