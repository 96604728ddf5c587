"""List feeds to stubs: what a platform's list says of each posting, before its details are read.

A landed row's ``payload`` is one list page. A stub has source_job_id, path, title, location and posted_at; entries
without an id or a title, and pages that are no such list, give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.nested import first_filled

# Each platform's list: its schema, the array of entries in it, and what the entry says.
_PLACE = "struct<city: string, region: string>"
LISTS = {
    "workday": ("jobPostings array<struct<title: string, externalPath: string, locationsText: string, postedOn: string, bulletFields: array<string>>>", "jobPostings"),
    "oraclecloud": ("items array<struct<requisitionList: array<struct<Id: string, Title: string, PostedDate: string, PrimaryLocation: string>>>>", "items.requisitionList"),
    "smartrecruiters": (f"content array<struct<id: string, name: string, releasedDate: string, location: {_PLACE}>>", "content"),
    "jibe": ("jobs array<struct<data: struct<slug: string, req_id: string, title: string, posted_date: string, location_name: string, city: string>>>", "jobs.data"),
    "talentpoolbuilder": ("jobs array<struct<campaign_id: string, job_title: string, status: string, created: string, city: string, state: string>>", "jobs"),
}


def _entry(platform: str, as_of: Column) -> dict[str, Column]:
    e = lambda name: F.col(f"e.{name}")
    joined = lambda *parts: F.array_join(F.filter(F.array(*[F.nullif(p, F.lit("")) for p in parts]), lambda x: x.isNotNull()), ", ")
    if platform == "workday":
        return {"source_job_id": F.coalesce(F.try_element_at(e("bulletFields"), F.lit(1)), e("externalPath")), "path": F.when(e("externalPath").startswith("/job/"), e("externalPath")), "title": e("title"), "location": e("locationsText"), "posted_at": D.posted_since(e("postedOn"), as_of)}
    if platform == "oraclecloud":
        return {"source_job_id": e("Id"), "path": F.concat(F.lit("/job/"), e("Id")), "title": e("Title"), "location": e("PrimaryLocation"), "posted_at": D.parse_date(e("PostedDate"))}
    if platform == "smartrecruiters":
        return {"source_job_id": e("id"), "path": F.concat(F.lit("/postings/"), e("id")), "title": e("name"), "location": joined(e("location.city"), e("location.region")), "posted_at": D.parse_date(e("releasedDate"))}
    if platform == "jibe":
        return {"source_job_id": first_filled(e("req_id"), e("slug")), "path": F.concat(F.lit("/jobs/"), e("slug")), "title": e("title"), "location": first_filled(e("location_name"), e("city")), "posted_at": D.parse_date(e("posted_date"))}
    created = F.try_to_timestamp(e("created"), F.lit("yyyy-MM-dd HH:mm:ss"))
    open_since = F.when(e("status") == "Hiring", created)  # closed and undated entries are no postings
    return {"source_job_id": F.when(open_since.isNotNull(), e("campaign_id")), "path": F.concat(F.lit("/job/"), e("campaign_id")), "title": e("job_title"), "location": joined(e("city"), e("state")), "posted_at": open_since}


def list_stubs(platform: str, landed: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the stubs of each list page."""
    schema, entries = LISTS[platform]
    pages = landed.select(*keep, F.from_json("payload", schema).alias("l"))
    array = F.flatten(F.col("l.items.requisitionList")) if platform == "oraclecloud" else F.col(f"l.{entries}")
    rows = pages.select(*keep, F.explode(array).alias("e"))
    stubs = rows.select(*keep, *[c.alias(n) for n, c in _entry(platform, as_of).items()])
    return stubs.filter("source_job_id != '' AND path IS NOT NULL AND title IS NOT NULL")
