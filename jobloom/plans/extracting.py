"""Queries of sources, extraction and normalization: payloads are derived from the given tables by Spark.

A part is a posting: its payload is built in each platform's shape, one in seven without a title and one in eleven
on a foreign host, so both the good rows and the quarantine have something to show.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import province_name
from ..schema import PROVINCES
from ..sources import extract as X
from ..sources import normalize as N
from ..sources.lists import LISTS, list_stubs
from .bindings import as_of, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


CODES = list(PROVINCES)
CODES_SQL = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"


def parts(spark, sf):
    """Parts with what every payload needs: id, title, host, address, day, place, bounds of pay."""
    p = table(spark, sf, "part")
    good = F.concat(F.lit("RN "), F.col("p_name"))
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (key() % len(CODES) + 1).cast("int"))
    return p.withColumns(
        {
            "id": key().cast("string"), "title": F.when(key() % 7 != 0, good), "host": F.when(key() % 11 == 0, "other.example.org").otherwise("jobs.example.org"),
            "day": F.date_format(F.lit("2001-06-01").cast("timestamp") + F.make_interval(days=(key() % 50).cast("int")), "yyyy-MM-dd"),
            "code": code, "prov": province_name(code), "town": F.concat(F.lit("Town "), F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 9))), "low": (key() % 30 + 20).cast("double"), "high": (key() % 30 + 30).cast("double"),
        }
    )


def key():
    return F.col("p_partkey")


def title():
    return F.coalesce("title", F.lit(""))


def body():
    return cat("<p>", F.col("p_brand"), "</p>")


def landed(df, payload, url, place_from_posting=None, header_fields=None):
    aliases = F.create_map(F.lit("Home Site"), F.lit("Alias Town, ON"))
    reg = F.struct(F.lit("Example Health").alias("name"), F.lit("ex").alias("key"), F.lit("jobs.example.org").alias("host"), F.lit("Sudbury").alias("default_city"), F.lit("ON").alias("province"), aliases.alias("aliases"), *[(F.lit(False) if c is None else c).alias(n) for n, c in (("place_from_posting", place_from_posting), ("header_fields", header_fields))])
    return df.select(payload.alias("payload"), url.alias("url"), F.lit("2001-07-01").cast("timestamp").alias("last_modified"), reg.alias("reg"), F.to_json(F.struct(F.lit("").alias("employer"), F.lit("Permanent").alias("status"))).alias("list_fields"))


def cat(*xs):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def ld(record):
    return cat("<html><script type=\"application/ld+json\">", F.to_json(record), "</script></html>")


def s(**k):
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in k.items()])


def page(path):
    return cat("https://", F.col("host"), path, F.col("id"))


def address():
    return s(addressLocality=F.col("town"), addressRegion=F.col("prov"))


def posting(**k):
    return s(**{"@type": "JobPosting", "title": F.col("title"), "description": body(), "datePosted": F.col("day"), "employmentType": "PART_TIME"} | k)


def micro(text):
    return cat('<link rel="canonical" href="', page("/job/x/"), '"><meta property="og:title" content="', title(), '"><meta itemprop="datePosted" content="', F.col("day"), '"><meta itemprop="addressLocality" content="', F.col("town"), '"><span class="jobdescription">', text, "</span>")


#: Places as employers write them: plain, behind a name, on a last line with a note, an address, a name with an alias.
def written_place():
    plain = cat(F.col("town"), ", ", F.col("prov"))
    kinds = F.array(plain, cat("LTC - ", plain), cat("Home 12\n", plain, " (Annex)"), cat("12 King Street, ", F.col("prov")), F.lit(" Home  Site"))
    return F.element_at(kinds, (key() % 5 + 1).cast("int"))


PAYLOADS = {
    "workday": lambda: (F.to_json(s(jobPostingInfo=s(title=F.col("title"), jobDescription=cat("Job Number: 1&#xa;Minimum - Maximum Hourly Rate: $", F.col("low").cast("string"), " - $", F.col("high").cast("string"), "&#xa;Hours: Nights&#xa;Job Type: Part-Time<p>", F.col("p_brand"), "</p>"), location=written_place(), timeType="Full time", startDate=F.col("day"), jobReqId=F.col("id"), externalUrl=page("/j/")))), page("/j/")),
    "oraclecloud": lambda: (F.to_json(s(Id=F.col("id"), Title=F.col("title"), ExternalPostedStartDate=F.col("day"), PrimaryLocation=cat(F.col("town"), ", ", F.col("prov"), ", Canada"), ExternalDescriptionStr=cat("<p>Type: Part-Time Shift Information: Nights Salary or Pay Band: $", F.col("low").cast("string"), " to $", F.col("high").cast("string"), "</p>"))), page("/j/")),
    "jibe": lambda: (F.to_json(s(slug=F.col("id"), title=F.col("title"), description=cat("The salary range for this position is CAD $", F.col("low").cast("string"), " - CAD $", F.col("high").cast("string"), " / hour"), city=F.col("town"), state=F.col("prov"), posted_date=F.col("day"), tags1=F.array(F.lit("Part Time")))), page("/j/")),
    "smartrecruiters": lambda: (F.to_json(s(id=F.col("id"), name=F.col("title"), releasedDate=F.col("day"), location=s(city=F.col("town"), region=F.col("prov")), typeOfEmployment=s(label="Part-time"), applyUrl=F.when(F.col("host") == "jobs.example.org", cat("https://jobs.smartrecruiters.com/", F.col("id"))).otherwise(page("/j/")), jobAd=s(sections=s(jobDescription=s(text=F.col("p_brand")))))), page("/j/")),
    "talentpoolbuilder": lambda: (F.to_json(s(campaign_id=F.col("id"), job_title=F.col("title"), status=F.when(key() % 5 == 0, "Closed").otherwise("Hiring"), created=cat(F.col("day"), " 00:00:00"), city=F.col("town"), state=F.col("prov"), employment_status_name="Part Time", wage_from=F.col("low"), wage_to=F.col("high"), wage_type="Hourly", description=body())), page("/j/")),
    "icims": lambda: (cat(ld(posting(url=cat(page("/jobs/"), "/job"), jobLocation=F.array(s(address=address())), baseSalary=s(minValue=F.col("low"), maxValue=F.col("high")))), "<dt>Shift:</dt><dd>Nights</dd>"), page("/jobs/")),
    "bchealthjobs": lambda: (cat(ld(posting(jobLocation=s(address=address()))), '<h6 class="card-title">Hourly Wage:</h6><p class="card-text">$', F.col("low").cast("string"), " - $", F.col("high").cast("string"), "</p>"), page("/ViewJobPosting/")),
    "phenom": lambda: (ld(F.struct(F.array(s(**{"@type": "Organization"}).cast("struct<`@type`:string>")).alias("x"), F.array(posting(jobLocation=s(address=address()))).alias("@graph"))), cat(page("/job/"), "/t")),
    "wpjobmanager": lambda: (ld(posting(jobLocation=s(address=F.col("town")))), page("/poste/")),
    "sehc": lambda: (ld(posting(jobLocation=s(address=s(addressLocality=cat(F.col("town"), ", ", F.col("prov")))))), page("/careers/")),
    "silkroad": lambda: (F.when(key() % 2 == 0, ld(posting(jobLocation=s(address=address())))).otherwise(cat('<b id="Jobs_JobDetail_TitleText">', title(), '</b><div id="ConfigurablePageDetail__JobDescription">', F.col("p_brand"), '</div><div id="ConfigurablePageDetail__L"><h2>Job Location</h2><div>', F.col("town"), ", ", F.col("prov"), ', Canada</div></div><div id="ConfigurablePageDetail__D"><h2>Posted Date</h2><div>', F.date_format(F.col("day").cast("timestamp"), "M/d/yyyy"), "</div></div>")), page("/t/b/jobs/")),
    "taleo": lambda: (cat('<link rel="canonical" href="', page("/job-"), '"><h1 class="title">', title(), '</h1><p class="job_post_date"><b class="field_value">', F.date_format(F.col("day").cast("timestamp"), "MMM d, yyyy"), '</b></p>location: { name: "Zone, ', F.col("town"), '"<div class="job_description"><ul><li>Employee Class: </b>Part Time</li><li>Minimum Salary: </b>$', F.col("low").cast("string"), "</li><li>Maximum Salary: </b>$", F.col("high").cast("string"), "</li><li>Shift Pattern: </b>Nights</li></ul><!-- TEC-19749"), page("/job-")),
    "successfactors": lambda: (micro(cat("Type of Employment: Part-Time Union: none Pay $", F.col("low").cast("string"), " - $", F.col("high").cast("string"), " per hour")), page("/job/x/")),
    "successfactors_mb": lambda: (micro(cat("<p><strong>FTE:</strong> 0.5</p><p><strong>Salary:</strong> $", F.col("low").cast("string"), " - $", F.col("high").cast("string"), "</p><p><b>Anticipated Shift:</b> Nights</p>")), page("/job/x/")),
}
#: Which platforms say the province, pay, shift, and employment type in these payloads.
NO_PROVINCE, NO_PAY = ("taleo", "successfactors", "successfactors_mb", "wpjobmanager"), ("smartrecruiters", "phenom", "wpjobmanager", "sehc", "silkroad")
SHIFTS, NO_TYPE = ("workday", "oraclecloud", "icims", "taleo", "successfactors_mb"), ("silkroad",)


def _oracle(platform: str) -> str:
    host = "true" if platform in ("oraclecloud", "jibe") else "p_partkey % 11 <> 0"
    only = "p_partkey % 5 <> 0" if platform == "talentpoolbuilder" else "true"
    wage = (lambda e: "NULL::DOUBLE" if platform in NO_PAY else f"({e})::DOUBLE")
    return f"""SELECT '{platform}:ex' AS source_id, p_partkey::VARCHAR AS source_job_id, CASE WHEN p_partkey % 7 <> 0 THEN 'RN ' || p_name END AS title, 'Town ' || upper(p_type[1]) || lower(p_type[2:10]) AS city,
{"'ON'" if platform in NO_PROVINCE else f"{CODES_SQL}[(p_partkey % 13 + 1)::INT]"} AS province, strftime(TIMESTAMP '2001-06-01' + to_days((p_partkey % 50)::INT), '%Y-%m-%d') AS posted,
{"NULL" if platform in NO_TYPE else "'part_time'"} AS employment_type, {"'night'" if platform in SHIFTS else "NULL"} AS shift_type, {wage('p_partkey % 30 + 20')} AS salary_min, {wage('p_partkey % 30 + 30')} AS salary_max,
p_partkey % 7 <> 0 AND {host} AS good FROM part WHERE {only}"""


#: A record without a title is no record to this platform, and the page then has no labels either.
_NONE = "p_partkey % 14 = 0"
_SILKROAD = {"'Town ' || upper(p_type[1]) || lower(p_type[2:10])": "'Sudbury'", f"{CODES_SQL}[(p_partkey % 13 + 1)::INT]": "'ON'", "strftime(TIMESTAMP '2001-06-01' + to_days((p_partkey % 50)::INT), '%Y-%m-%d')": "NULL"}


def _silkroad(sql: str) -> str:
    for usual, none in _SILKROAD.items():
        sql = sql.replace(usual, f"CASE WHEN {_NONE} THEN {none} ELSE {usual} END")
    return sql


def _query(platform: str):
    def run(spark, sf):
        payload, url = PAYLOADS[platform]()
        rows = parts(spark, sf)
        options = (key() % 3 == 0, key() % 2 == 0) if platform == "workday" else ()
        both = N.checked(platform, landed(rows, payload, url, *options), as_of()).withColumn("good", F.col("error") == "")
        return both.select(
            "source_id", "source_job_id", F.nullif("title", F.lit("")).alias("title"), "city", "province", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "employment_type", "shift_type",
            F.col("salary_min").cast("double").alias("salary_min"), F.col("salary_max").cast("double").alias("salary_max"), "good",
        )

    return run


for _n, _platform in enumerate(("workday", "taleo", "icims", "jibe", "successfactors", "successfactors_mb", "bchealthjobs", "wpjobmanager", "talentpoolbuilder", "phenom", "oraclecloud", "smartrecruiters", "silkroad", "sehc"), 1):
    QUERIES[f"NRM-{_n}"], ORACLE[f"NRM-{_n}"] = _query(_platform), _oracle(_platform)
ORACLE["NRM-13"] = _silkroad(ORACLE["NRM-13"])
#: A third of the employers let the posting name its place, half of them open descriptions with a header.
ORACLE["NRM-1"] = f"""SELECT 'workday:ex' AS source_id, p_partkey::VARCHAR AS source_job_id, CASE WHEN p_partkey % 7 <> 0 THEN 'RN ' || p_name END AS title,
CASE WHEN p_partkey % 3 <> 0 THEN 'Sudbury' WHEN p_partkey % 5 < 3 THEN 'Town ' || upper(p_type[1]) || lower(p_type[2:10]) WHEN p_partkey % 5 = 4 THEN 'Alias Town' END AS city,
CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 5 = 4 THEN 'ON' WHEN p_partkey % 5 < 3 THEN {CODES_SQL}[(p_partkey % 13 + 1)::INT] END AS province, strftime(TIMESTAMP '2001-06-01' + to_days((p_partkey % 50)::INT), '%Y-%m-%d') AS posted,
CASE WHEN p_partkey % 2 = 0 THEN 'part_time' ELSE 'full_time' END AS employment_type, CASE WHEN p_partkey % 2 = 0 THEN 'night' END AS shift_type,
CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 30 + 20)::DOUBLE END AS salary_min, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 30 + 30)::DOUBLE END AS salary_max,
p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND (p_partkey % 3 <> 0 OR p_partkey % 5 <> 3) AS good FROM part"""


@query("SRC-3", "SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_source(spark, sf):
    """The JSON property of each event, read with an explicit schema."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k long")["k"].alias("k"))


#: Postings on a list page, and what pages say of their age.
PAGE = 20


def list_pages(rows, platform):
    """Each platform's list pages of the parts, ``PAGE`` of them a page."""
    age = (key() % 33).cast("int")
    said = F.when(age == 0, "Posted Today").when(age == 1, "Posted Yesterday").when(age > 30, "Posted 30+ Days Ago").otherwise(cat("Posted ", age.cast("string"), " Days Ago"))
    name, place = F.col("p_name").alias("t"), s(city=F.col("town"), region=F.col("code"))
    entry = {
        "workday": s(title=name, externalPath=cat("/job/x/", F.col("id")), locationsText=F.col("town"), postedOn=said, bulletFields=F.when(key() % 4 != 0, F.array(F.col("id"))).otherwise(F.array().cast("array<string>"))),
        "oraclecloud": s(Id=F.col("id"), Title=name, PostedDate=F.col("day"), PrimaryLocation=F.col("town")),
        "smartrecruiters": s(id=F.col("id"), name=name, releasedDate=F.col("day"), location=place),
        "jibe": s(data=s(slug=F.col("id"), req_id=F.when(key() % 2 == 0, cat("R", F.col("id"))).otherwise(""), title=name, posted_date=F.col("day"), location_name="", city=F.col("town"))),
        "talentpoolbuilder": s(campaign_id=key(), job_title=name, status=F.when(key() % 5 == 0, "Closed").otherwise("Hiring"), created=cat(F.col("day"), " 00:00:00"), city=F.col("town"), state=F.col("code")),
    }[platform]
    entries = F.collect_list(entry).alias("e")  # PAGE entries
    pages = rows.groupBy(F.floor(key() / PAGE).alias("page")).agg(entries)
    wrapped = {"workday": s(jobPostings=F.col("e")), "oraclecloud": s(items=F.array(s(requisitionList=F.col("e")))), "smartrecruiters": s(content=F.col("e"))}.get(platform, s(jobs=F.col("e")))
    return pages.select(F.to_json(wrapped).alias("payload"))


def _stubs_sql(platform: str) -> str:
    town = "'Town ' || upper(p_type[1]) || lower(p_type[2:10])"
    code = f"{CODES_SQL}[(p_partkey % 13 + 1)::INT]"
    job = {"workday": "CASE WHEN p_partkey % 4 <> 0 THEN p_partkey::VARCHAR ELSE '/job/x/' || p_partkey END", "jibe": "CASE WHEN p_partkey % 2 = 0 THEN 'R' || p_partkey ELSE p_partkey::VARCHAR END"}.get(platform, "p_partkey::VARCHAR")
    path = {"workday": "/job/x/", "smartrecruiters": "/postings/", "jibe": "/jobs/"}.get(platform, "/job/")
    place = f"{town} || ', ' || {code}" if platform in ("smartrecruiters", "talentpoolbuilder") else town
    day = "DATE '2001-08-02' - least(p_partkey % 33, 31)::INT" if platform == "workday" else "DATE '2001-06-01' + (p_partkey % 50)::INT"
    only = "p_partkey % 5 <> 0" if platform == "talentpoolbuilder" else "true"
    return f"SELECT '{platform}' AS platform, {job} AS source_job_id, '{path}' || p_partkey AS path, p_name AS title, {place} AS location, ({day})::VARCHAR AS posted FROM part WHERE {only}"


@query("SRC-3-lists", " UNION ALL ".join(map(_stubs_sql, LISTS)))
def list_feeds(spark, sf):
    """Stubs of the list pages of all JSON platforms."""
    rows = parts(spark, sf)
    stubs = [list_stubs(p, list_pages(rows, p), as_of()).withColumn("platform", F.lit(p)) for p in LISTS]
    return reduce(DataFrame.unionByName, stubs).select("platform", "source_job_id", "path", "title", "location", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


@query("SRC-4", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN 'RN ' || p_name END AS title FROM part")
def jsonld_source(spark, sf):
    payload, _ = PAYLOADS["phenom"]()
    found = X.extract_jsonld(parts(spark, sf).select(key().alias("id"), cat("<script type=\"application/ld+json\">{bad</script>", payload).alias("html")))
    return found.select("id", F.get_json_object("posting", "$.title").alias("title"))


@query("SRC-5", "SELECT p_partkey::VARCHAR AS id, '2001-06-02 00:00:00' AS lastmod FROM part WHERE p_partkey % 3 <> 0")
def sitemap_source(spark, sf):
    return X.parse_sitemap(sitemap_files(parts(spark, sf)), r"/job/(\d+)/", True).select("id", F.col("lastmod").cast("string").alias("lastmod"))


#: Fixed value: the most addresses that the sitemap protocol lets one file have.
SITEMAP_ADDRESSES = 50_000


def sitemap_files(rows):
    """Sitemap files of the parts; their number grows with the table, each stays below the protocol's bound."""
    entry = cat("<url><loc>https://jobs.example.org/job/", F.col("id"), "/x</loc>", F.when(key() % 3 != 0, "<lastmod>2001-06-02T00:00:00Z</lastmod>").otherwise(""), "</url>")
    return rows.groupBy(F.floor(key() / SITEMAP_ADDRESSES).alias("file")).agg(F.array_join(F.collect_list(entry), "").alias("content"))


@query("SRC-5-index", "SELECT p_partkey::VARCHAR AS id, '2001-06-02 00:00:00' AS lastmod FROM part WHERE p_partkey % 3 <> 0")
def sitemap_index(spark, sf):
    """SRC-5 by way of three levels of indexes that also name each other, themselves and what was not landed."""
    base, k = "https://jobs.example.org/", F.floor(key() / 40)
    entry = cat("<url><loc>https://jobs.example.org/job/", key().cast("string"), "/x</loc>", F.when(key() % 3 != 0, "<lastmod>2001-06-02T00:00:00Z</lastmod>").otherwise(""), "</url>")
    maps = parts(spark, sf).groupBy(k.alias("n")).agg(F.array_join(F.collect_list(entry), "").alias("content"))  # 40 entries a file
    name = lambda kind, c: cat(base, kind, c.cast("string"), ".xml")
    loc = lambda c: cat("<sitemap><loc>", c, "</loc></sitemap>")
    index = lambda body: cat("<?xml?><sitemapindex xmlns='x'>", body, loc(F.lit(f"{base}gone.xml")), "</sitemapindex>")
    listed = maps.groupBy(F.floor(F.col("n") / 50).alias("j")).agg(F.array_join(F.collect_list(loc(name("map", F.col("n")))), "").alias("body"))  # 50 files an index
    middle = listed.select(name("part", F.col("j")).alias("url"), index(cat(F.col("body"), loc(F.lit(f"{base}root.xml")), loc(name("part", F.col("j"))))).alias("content"))
    root = listed.agg(F.array_join(F.collect_list(loc(name("part", F.col("j")))), "").alias("body")).select(F.lit(f"{base}root.xml").alias("url"), index(cat(F.col("body"), loc(F.lit(f"{base}root.xml")))).alias("content"))
    files = maps.select(name("map", F.col("n")).alias("url"), "content").union(middle).union(middle).union(root)
    found = X.resolve_sitemaps(spark.createDataFrame([(f"{base}root.xml",)], "url string"), files)
    return X.parse_sitemap(found, r"/job/(\d+)/", True).select("id", F.col("lastmod").cast("string").alias("lastmod"))


@query("SRC-6", r"SELECT page_id, regexp_extract(x, '^([^<]*)</a>', 1) AS word, count(*) > 0 AS listed FROM (SELECT page_id, unnest(string_split_regex(html, '<li><a href=[^>]*>')[2:]) AS x FROM pages) WHERE regexp_extract(x, '^([^<]*)</a>', 1) <> '' GROUP BY 1, 2")
def list_source(spark, sf):
    rows = X.parse_list_rows(table(spark, sf, "pages"), ["page_id"], "<li>", {"word": r"^<a href=[^>]*>([^<]*)</a>"})
    return rows.select("page_id", "word", F.lit(True).alias("listed"))


@query("SRC-7", "SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size::VARCHAR AS size FROM part")
def field_source(spark, sf):
    html = cat("<dl><dt>Brand:</dt><dd>", F.col("p_brand"), "</dd><dt>Kind</dt><dd>old</dd><dt>Kind</dt><dd>", F.col("p_type"), "</dd></dl>")
    prose = cat("Department: x Size: ", F.col("p_size").cast("string"), " Union: none")
    rows = table(spark, sf, "part").select(key().alias("id"), X.dl_fields(html).alias("f"), X.prose_fields(prose, ["Department", "Size", "Union"]).alias("g"))
    return rows.select("id", F.col("f")["brand"].alias("brand"), F.col("f")["kind"].alias("kind"), F.col("g")["Size"].alias("size"))


@query("SRC-8", "SELECT source_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{p}:ex' AS source_id FROM part WHERE p_partkey % 7 <> 0 AND {'true' if p in ('jibe', 'oraclecloud') else 'p_partkey % 11 <> 0'}" for p in ("workday", "jibe", "oraclecloud")) + ") GROUP BY 1")
def union_source(spark, sf):
    rows = parts(spark, sf)
    goods = [N.normalize(p, landed(rows, *PAYLOADS[p]()), as_of())[0] for p in ("workday", "jibe", "oraclecloud")]
    return X.union_sources(*goods).groupBy("source_id").agg(F.count("*").alias("n"))
