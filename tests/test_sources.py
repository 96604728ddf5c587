"""Normalizers and list feeds over the shapes that platforms send; own values throughout."""

import json

import pytest
from pyspark.sql import functions as F

from jobloom.functions import money, text
from jobloom.operators import lifecycle
from jobloom.sources import extract, lists, normalize

def now():
    return F.lit("2026-03-10").cast("timestamp")

REG = "struct('Example Health' AS name, 'ex' AS key, 'jobs.example.org' AS host, 'Sudbury' AS default_city, 'ON' AS province, map('Home Site', 'Elm, AB') AS aliases, {place} AS place_from_posting, {header} AS header_fields)"


def landed(spark, payloads, place="false", header="false", url="https://jobs.example.org/j/1"):
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    return df.select("payload", F.lit(url).alias("url"), F.lit("2026-03-01").cast("timestamp").alias("last_modified"), F.expr(REG.format(place=place, header=header)).alias("reg"), F.lit("{}").alias("list_fields"))


def workday(**k):
    info = {"title": "RN", "jobDescription": "<p>Care</p>", "location": "Elm Site", "startDate": "2026-03-01", "timeType": "Full time", "jobReqId": "JR1", "externalUrl": "https://jobs.example.org/j/1"}
    return json.dumps({"jobPostingInfo": info | k})


PLACES = [
    ("LTC - Elm - 12 - 3rd Ave, P.O. Box 4, Elm, Alberta", ("Elm", "AB")),
    ("Home - Oak (Oak St.) 12 Oak Street \nSudbury, ON", ("Sudbury", "ON")),
    ("LTC - Town, ON", ("Town", "ON")),
    ("Lake Town, Ontario (Main St Posting)", ("Lake Town", "ON")),
    (" Home   Site ", ("Elm", "AB")),
    ("Home 7, ON", (None, None)),
    ("12 King Street, ON", (None, None)),
    ("Elm", (None, None)),
    ("Elm, Nowhere", (None, None)),
    (", ON", (None, None)),
    ("", (None, None)),
    (None, (None, None)),
]


def test_workday_places_opted_in_and_out(spark):
    payloads = [workday(location=p, jobReqId=str(i)) for i, (p, _) in enumerate(PLACES)]
    rows = {int(r["source_job_id"]): r for r in normalize.checked("workday", landed(spark, payloads, place="true"), now()).collect()}
    for i, (_, want) in enumerate(PLACES):
        assert (rows[i]["city"], rows[i]["province"]) == want and rows[i]["error"] == ("" if want[0] else "place"), PLACES[i]
    good, bad = normalize.normalize("workday", landed(spark, payloads), now())
    assert {(r["city"], r["province"]) for r in good.collect()} == {("Sudbury", "ON")} and bad.count() == 0


def test_workday_headers_opted_in_and_out(spark):
    head = "Job Number: 9&#xa;Union: U&amp;#xa;Minimum - Maximum Hourly Rate: $1,030.50 - 1,041&#xa;Hours: Saturday, Sunday weekend&#xa;Job Type: Casual Full-Time<br />Body $99.00 - $199.00"
    rows = normalize.checked("workday", landed(spark, [workday(jobDescription=head)], header="true"), now()).collect()
    assert (float(rows[0]["salary_min"]), float(rows[0]["salary_max"]), rows[0]["salary_period"], rows[0]["shift_type"], rows[0]["employment_type"]) == (1030.5, 1041.0, "hour", "weekend", "casual")
    assert rows[0]["description"].startswith("<br") and "99" in rows[0]["description"]
    yearly = head.replace("Hourly Rate", "Annual Salary")
    row = normalize.checked("workday", landed(spark, [workday(jobDescription=yearly)], header="true"), now()).first()
    assert row["salary_period"] == "year"
    for plain, kind in ((head, "full_time"), ("Position Summary: We hire. $20.00 - $30.00<p>x</p>", "full_time")):
        row = normalize.checked("workday", landed(spark, [workday(jobDescription=plain)]), now()).first()
        assert row["salary_min"] is None and row["shift_type"] is None and row["employment_type"] == kind
    body = normalize.checked("workday", landed(spark, [workday(jobDescription="Position Summary: We hire.<p>x</p>")], header="true"), now()).first()
    assert body["description"].startswith("Position Summary")


def test_workday_rejects_what_it_cannot_use(spark):
    payloads = [workday(externalUrl="http://jobs.example.org/j/1"), workday(externalUrl="https://evil.example.org/j"), workday(startDate="soon"), workday(title=""), "{", workday(jobReqId=None)]
    errors = [r["error"] for r in normalize.checked("workday", landed(spark, payloads), now()).collect()]
    assert errors[:4] == ["host", "host", "posted_at", "title"] and "id" in errors[4] and errors[5] == "id"


def test_stated_ranges(spark):
    cases = [
        ("pay is $38.43 - $50.99 hourly.", (38.43, 50.99, "hourly")), ("CAD $41.42 – CAD 59.52 / hour", (41.42, 59.52, "hour")), ("$100,000 to 150,000 per year", (100000.0, 150000.0, "per year")),
        ("$12 - $15", None), ("none", None), (None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    found = money.stated_range(F.col("c"), after=r"\s*(hourly|/\s*hour|per year)")
    for r in df.select("i", found.alias("r")).collect():
        want = cases[r["i"]][1]
        assert (r["r"]["low"], r["r"]["high"]) == ((want[0], want[1]) if want else (None, None))


def test_cards_need_a_title_with_text_right_behind(spark):
    html = '<h6 class="card-title x"> Facility: </h6>\n<p class="card-text">Elm <b>House</b></p><h6 class="card-title">Facility</h6><p class="card-text">Other</p><p class="card-text">Share</p><h6 class="card-title">Alone</h6><div>no</div><H6 CLASS="card-title">Wage:</H6><P class="card-text">$1</P>'
    (row,) = spark.createDataFrame([(html,)], "h string").select(extract.card_fields(F.col("h")).alias("f")).collect()
    assert row["f"] == {"facility": "Elm House", "wage": "$1"}


LISTS = {
    "workday": (
        {"total": 3, "jobPostings": [
            {"title": "RN", "externalPath": "/job/a/RN_1", "locationsText": "Elm", "postedOn": "Posted 8 Days Ago", "bulletFields": ["JR1", "x"]},
            {"title": "LPN", "externalPath": "/job/a/LPN", "postedOn": "Posted 30+ Days Ago", "bulletFields": []},
            {"title": "Cook", "externalPath": "/job/a/C", "postedOn": "Posted Yesterday", "bulletFields": ["JR3"]}, {"title": "Bad", "externalPath": "/other", "bulletFields": ["JR4"]}, {"title": "Old", "externalPath": "/job/o"},
        ]},
        [("JR1", "/job/a/RN_1", "RN", "Elm", "2026-03-02"), ("/job/a/LPN", "/job/a/LPN", "LPN", None, "2026-02-07"), ("JR3", "/job/a/C", "Cook", None, "2026-03-09"), ("/job/o", "/job/o", "Old", None, None)],
    ),
    "oraclecloud": ({"items": [{"TotalJobsCount": 2, "requisitionList": [{"Id": "7", "Title": "RN", "PostedDate": "2026-03-01", "PrimaryLocation": "Elm, SK"}, {"Id": "", "Title": "x", "PostedDate": "2026-03-01"}]}]}, [("7", "/job/7", "RN", "Elm, SK", "2026-03-01")]),
    "smartrecruiters": ({"totalFound": 2, "content": [{"id": "a1", "name": "RN", "releasedDate": "2026-03-01T10:00:00.000Z", "location": {"city": "Elm", "region": ""}}, {"id": "a2", "name": "PT", "releasedDate": "?", "location": {"city": "Elm", "region": "ON"}}]}, [("a1", "/postings/a1", "RN", "Elm", "2026-03-01"), ("a2", "/postings/a2", "PT", "Elm, ON", None)]),
    "jibe": ({"totalCount": 2, "jobs": [{"data": {"slug": "s1", "req_id": "", "title": "RN", "posted_date": "2026-03-01", "location_name": "", "city": "Elm"}}, {"data": {"slug": "s2", "req_id": "R2", "title": "PT", "posted_date": "2026-03-01", "location_name": "Elm House", "city": "Elm"}}]}, [("s1", "/jobs/s1", "RN", "Elm", "2026-03-01"), ("R2", "/jobs/s2", "PT", "Elm House", "2026-03-01")]),
    "talentpoolbuilder": ({"result": True, "jobs": [{"campaign_id": 5, "job_title": "RN", "status": "Hiring", "created": "2026-03-01 08:00:00", "city": "Elm", "state": "AB"}, {"campaign_id": 6, "job_title": "RN", "status": "Closed", "created": "2026-03-01 08:00:00"}, {"campaign_id": 7, "job_title": "RN", "status": "Hiring", "created": "soon"}]}, [("5", "/job/5", "RN", "Elm, AB", "2026-03-01")]),
}


@pytest.mark.parametrize("platform", LISTS)
def test_lists_give_stubs(spark, platform):
    payload, want = LISTS[platform]
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, "{"), (3, None), (4, "{}")], "page int, payload string")
    got = lists.list_stubs(platform, df, now(), keep=("page",)).select("source_job_id", "path", "title", "location", F.date_format("posted_at", "yyyy-MM-dd").alias("d")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_landed_files_are_read_with_their_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(LISTS["workday"][0]))
    (tmp_path / "b.json").write_text("{broken")
    rows = extract.read_json_payloads(spark, str(tmp_path), lists.LISTS["workday"][0], "jobPostings").collect()
    assert [r["title"] for r in rows] == ["RN", "LPN", "Cook", "Bad", "Old"]
    assert [r["jobPostings"] for r in extract.read_json_payloads(spark, str(tmp_path), lists.LISTS["workday"][0]).collect() if r["_corrupt_record"]] == [None]


@pytest.mark.parametrize("platform", sorted(normalize.NORMALIZERS))
def test_a_payload_is_parsed_once_and_bad_ones_are_kept_apart(spark, platform):
    df = normalize.checked(platform, landed(spark, [None, "", "{", "<html>"]), now())
    assert df.filter("error = ''").count() == 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and plan.count("from_json") + plan.count("JsonToStructs") <= 4


def test_towns_of_lines_need_a_province(spark):
    df = spark.createDataFrame([(p,) for p, _ in PLACES], "p string").select(text.town_of_line(F.col("p"), F.expr("map('Home Site', 'Elm, AB')")).alias("t"))
    assert [(r["t"]["city"], r["t"]["province"]) if r["t"] else (None, None) for r in df.collect()] == [w for _, w in PLACES]


def test_sitemap_indexes_resolve_to_lists_met_once(spark):
    loc = lambda *urls: "".join(f"<sitemap><loc> {u} </loc></sitemap>" for u in urls)
    index = lambda *urls: f"<sitemapindex xmlns='x'>{loc(*urls)}</sitemapindex>"
    files = [("root", index("a", "b", "root", "gone")), ("a", index("m1", "b", "root")), ("b", index("m2", "a", "c")), ("c", index("m1", "m3")), ("stray", "<urlset/>"), *[(f"m{i}", f"<urlset><url><loc>u{i}</loc></url></urlset>") for i in (1, 2, 3)], ("m1", "<urlset/>"), ("none", None)]
    landed = spark.createDataFrame(files, "url string, content string")
    lists = lambda *roots: sorted(r["url"] for r in extract.resolve_sitemaps(spark.createDataFrame([(r,) for r in roots], "url string"), landed).collect())
    assert lists("root") == ["m1", "m2", "m3"] and lists("c", "c", "stray") == ["m1", "m3", "stray"] and lists("gone") == []


def test_crawls_end_where_nothing_new_comes(spark):
    page = lambda source, offset, ids, total=None: [(source, offset, i, total) for i in ids]
    rows = page("short", 0, range(20)) + page("short", 20, range(20, 35)) + page("short", 40, range(90, 99))
    rows += page("again", 0, range(20)) + page("again", 20, range(20, 40)) + page("again", 40, range(20)) + page("again", 60, range(50, 70))
    rows += page("total", 0, range(20), 40) + page("total", 20, range(20, 40), 0) + page("total", 40, range(40, 60), 0)
    rows += page("zero", 0, range(20), 0) + page("zero", 20, range(20, 40), 20) + page("zero", 40, [1])
    rows += page("gap", 0, range(20)) + page("gap", 20, range(20, 40)) + page("gap", 80, range(80, 100))
    rows += [r for k in range(4) for r in page("last", 20 * k, range(20 * k, 20 * k + 20))]
    rows += page("twice", 0, [5] * 20) + page("twice", 20, [5] * 20) + page("late", 20, range(20))
    got = lifecycle.crawl_ends(spark.createDataFrame(rows, "source_id string, page_offset long, job_id long, total long"), last_offset=60).collect()
    assert {r["source_id"]: (r["last_page"], r["last_useful_page"]) for r in got} == {"short": (20, 20), "again": (40, 20), "total": (20, 20), "zero": (40, 20), "gap": (20, 20), "last": (40, 40), "twice": (20, 0)}
