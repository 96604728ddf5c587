"""The given tables seen as posting-shaped tables, as DataFrames and as SQL for the oracle.

Every query reads the given tables through these; each takes (spark, sf_dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings: an order is a job, its customer's segment the employer, nation and region the place."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    place = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    posted = F.col("o_orderdate").cast("timestamp")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("slug"),
        F.col("c_mktsegment").alias("employer_name"),
        F.col("c_name").alias("company"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("province"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("category"),
        F.col("o_orderstatus").alias("employment_type"),
        F.col("o_totalprice").alias("salary_min"),
        (F.col("o_totalprice") + 1000).alias("salary_max"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 3 == 0, "hour").otherwise("year").alias("salary_period"),
        posted.alias("posted_at"),
        (posted + F.make_interval(days=(F.col("o_orderkey") % 10).cast("int"))).alias("updated_at"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
    )


JOBS = """jobs AS (
  SELECT o_orderkey AS id, 'job-' || o_orderkey AS slug, c_mktsegment AS employer_name, c_name AS company, n_name AS city, r_name AS province,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS category, o_orderstatus AS employment_type, o_totalprice AS salary_min, o_totalprice + 1000 AS salary_max,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'hour' ELSE 'year' END AS salary_period,
    o_orderdate::TIMESTAMP AS posted_at, o_orderdate::TIMESTAMP + to_days((o_orderkey % 10)::INT) AS updated_at, o_orderstatus <> 'F' AS is_active
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay bands: an order's smallest and largest line, by the hour (over 300) where most lines are returned."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.max("l_returnflag").alias("flag"))
    pay = jobs(spark, sf_dir).drop("salary_min", "salary_max", "salary_period").join(lines, F.col("id") == F.col("l_orderkey"))
    hour = F.col("flag") == "R"
    share = F.when(hour, F.lit(300.0)).otherwise(1.0)
    return pay.withColumns({"salary_min": F.col("low") / share, "salary_max": F.col("high") / share, "salary_period": F.when(hour, "hour").otherwise("year")})


BANDS = JOBS + """, lines AS (SELECT l_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, max(l_returnflag) AS flag FROM lineitem GROUP BY 1),
bands AS (SELECT jobs.* EXCLUDE (salary_min, salary_max, salary_period), low / CASE WHEN flag = 'R' THEN 300.0 ELSE 1.0 END AS salary_min,
  high / CASE WHEN flag = 'R' THEN 300.0 ELSE 1.0 END AS salary_max, CASE WHEN flag = 'R' THEN 'hour' ELSE 'year' END AS salary_period
  FROM jobs JOIN lines ON id = l_orderkey),
good AS (SELECT * FROM bands WHERE salary_min > 0 AND salary_max >= salary_min AND CASE salary_period WHEN 'hour' THEN salary_min >= 10 AND salary_max <= 500 ELSE salary_min >= 15000 AND salary_max <= 1000000 END)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings: a document is a posting seen at a source; its first 60 characters are the title."""
    d = table(spark, sf_dir, "documents")
    prefix = F.when(F.col("source") == "src0", "jobbank:0").when(F.col("source") == "src1", "adzuna:1").otherwise(F.concat(F.lit("direct:"), F.col("source")))
    return d.select(
        F.col("doc_id").alias("id"), prefix.alias("source_id"), F.when(F.col("doc_id") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("doc_id").cast("string")).alias("source_job_id"),
        F.substring("text", 1, 60).alias("title"), F.concat(F.lit("Employer "), F.col("lang")).alias("employer_name"), F.lit("Toronto, Ontario").alias("city"), F.upper("lang").alias("province"),
        (F.lit("2001-06-01").cast("timestamp") + F.make_interval(days=(F.col("doc_id") % 60).cast("int"))).alias("posted_at"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("2001-07-15").cast("timestamp")).alias("closes_at"), F.col("n_chars"),
    )


#: The fingerprint's title: lower case without accents, requisition numbers gone, words of letters and digits.
#: Letters that do not fall apart into a letter and marks (and so keep no ASCII letter) part words, as in the engine.
NORMAL = r"array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(lower(strip_accents({0})), '\breq\s*#?\s*\d+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE w WHEN 'rn' THEN 'registered nurse' WHEN 'rpn' THEN 'registered practical nurse' WHEN 'lpn' THEN 'licensed practical nurse' WHEN 'np' THEN 'nurse practitioner' WHEN 'psw' THEN 'personal support worker' WHEN 'hca' THEN 'health care aide' WHEN 'mlt' THEN 'medical laboratory technologist' WHEN 'mrt' THEN 'medical radiation technologist' WHEN 'slp' THEN 'speech language pathologist' ELSE w END), ' ')"
SIGHTINGS = f"""sightings AS (
  SELECT doc_id AS id, CASE source WHEN 'src0' THEN 'jobbank:0' WHEN 'src1' THEN 'adzuna:1' ELSE 'direct:' || source END AS source_id,
    CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id::VARCHAR END AS source_job_id, substr(text, 1, 60) AS title, 'Employer ' || lang AS employer_name, 'Toronto, Ontario' AS city, upper(lang) AS province,
    TIMESTAMP '2001-06-01' + to_days((doc_id % 60)::INT) AS posted_at, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2001-07-15' END AS closes_at, n_chars
  FROM documents),
printed AS (SELECT *, sha256(coalesce({NORMAL.format('title')}, '') || '|' || coalesce(lower(trim(employer_name)), '') || '|toronto, ontario|' || coalesce(upper(trim(province)), '')) AS fingerprint FROM sightings),
spans AS (SELECT fingerprint, count(DISTINCT source_id) > 1 AS spans FROM printed GROUP BY 1),
grouped AS (SELECT printed.*, CASE WHEN spans THEN fingerprint ELSE fingerprint || ':' || id END AS group_key FROM printed JOIN spans USING (fingerprint)),
canonical AS (SELECT *, count(*) OVER g AS sightings, row_number() OVER (PARTITION BY group_key ORDER BY CASE split_part(source_id, ':', 1) WHEN 'jobbank' THEN 1 WHEN 'adzuna' THEN 2 ELSE 0 END, id) AS place FROM grouped WINDOW g AS (PARTITION BY group_key))"""


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.resolve import fingerprint

    return sightings(spark, sf_dir).withColumn("fingerprint", fingerprint(F.col("title"), F.col("employer_name"), F.col("city"), F.col("province")))


def seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(links, raw): an event is a raw posting of its user's job, last seen at its time moved to the jobs' days."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("raw_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("source_id"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL '-8218' DAY")).alias("last_seen_at"))
    return rows.filter("raw_id % 10 != 0").select("job_id", "raw_id"), rows.select("raw_id", "source_id", "last_seen_at")


SEEN = """rawp AS (SELECT event_id AS raw_id, user_id AS job_id, event_type AS source_id, ts - to_days(8218) AS last_seen_at FROM events),
links AS (SELECT job_id, raw_id FROM rawp WHERE raw_id % 10 <> 0)"""


def lifecycle_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the columns that expiry and purge need; days are near ``AS_OF``."""
    j = jobs(spark, sf_dir)
    posted = as_of() - F.make_interval(days=(F.col("id") % 90).cast("int"))
    return j.select(F.col("id").alias("job_id"), "slug", "is_active", posted.alias("posted_at"), (posted + F.make_interval(days=F.lit(60))).alias("expires_at"), posted.alias("created_at"), (posted + F.make_interval(days=F.lit(3))).alias("updated_at"))


LIFE = JOBS + ", " + SEEN + f""", life AS (SELECT id AS job_id, slug, is_active, TIMESTAMP '{AS_OF}' - to_days((id % 90)::INT) AS posted_at, TIMESTAMP '{AS_OF}' - to_days((id % 90)::INT) + to_days(60) AS expires_at,
  TIMESTAMP '{AS_OF}' - to_days((id % 90)::INT) AS created_at, TIMESTAMP '{AS_OF}' - to_days((id % 90)::INT) + to_days(3) AS updated_at FROM jobs),
seen_jobs AS (SELECT DISTINCT job_id FROM links JOIN rawp USING (raw_id, job_id) WHERE last_seen_at > TIMESTAMP '{AS_OF}' - to_days(7))"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions: a customer's, with the four patterns of criteria by key, some inactive, unconfirmed or sent."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    day = lambda base, m: F.lit(base).cast("timestamp") + F.make_interval(days=(k % m).cast("int"))
    category = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")]), (k % 4 + 1).cast("int"))
    return c.select(
        k.alias("alert_id"), F.concat(F.lit("t"), k.cast("string")).alias("token"), F.when(k % 4 < 2, F.col("n_name")).alias("city"), F.when(k % 2 == 0, category).alias("category"),
        (k % 11 != 0).alias("is_active"), F.when(k % 5 != 0, day("2001-07-01", 20)).alias("confirmed_at"), F.when(k % 3 == 0, day("2001-07-10", 15)).alias("last_sent_at"),
    )


ALERTS = """alerts AS (SELECT c_custkey AS alert_id, 't' || c_custkey AS token, CASE WHEN c_custkey % 4 < 2 THEN n_name END AS city,
  CASE WHEN c_custkey % 2 = 0 THEN ['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'][(c_custkey % 4 + 1)::INT] END AS category, c_custkey % 11 <> 0 AS is_active,
  CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2001-07-01' + to_days((c_custkey % 20)::INT) END AS confirmed_at,
  CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2001-07-10' + to_days((c_custkey % 15)::INT) END AS last_sent_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
