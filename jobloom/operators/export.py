"""Exports: structured job records and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_escape, source_job_id

# Employment types in the vocabulary of structured job records.
EMPLOYMENT = {"full_time": "FULL_TIME", "part_time": "PART_TIME", "casual": "PER_DIEM", "temporary": "TEMPORARY", "contract": "CONTRACTOR"}


def export_jobposting_json(jobs: DataFrame) -> DataFrame:
    """(slug, json): a record per job; pay only with both bounds and a known period; nulls drop out."""
    kinds = F.create_map(*[F.lit(x) for pair in EMPLOYMENT.items() for x in pair])
    unit = F.when(F.col("salary_period") == "hour", "HOUR").when(F.col("salary_period") == "year", "YEAR")
    pay = F.when(
        F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull() & unit.isNotNull(),
        F.struct(F.lit("CAD").alias("currency"), F.struct(F.col("salary_min").alias("minValue"), F.col("salary_max").alias("maxValue"), unit.alias("unitText")).alias("value")),
    )
    record = F.struct(
        F.lit("JobPosting").alias("@type"),
        F.col("title"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("datePosted"),
        F.date_format("expires_at", "yyyy-MM-dd").alias("validThrough"),
        F.try_element_at(kinds, F.col("employment_type")).alias("employmentType"),
        F.struct(F.col("employer_name").alias("name")).alias("hiringOrganization"),
        F.struct(F.col("city").alias("addressLocality"), F.col("province").alias("addressRegion")).alias("jobLocation"),
        F.struct(source_job_id(F.col("dedupe_key")).alias("value")).alias("identifier"),
        pay.alias("baseSalary"),
    )
    return jobs.select("slug", json_escape(F.to_json(record)).alias("json"))


def write_run_metrics(counts: DataFrame, path: str, started, finished, status: str = "success", error: str | None = None) -> None:
    """Appends one audit row a source to the run table."""
    counts.withColumns({"started_at": F.lit(started), "finished_at": F.lit(finished), "status": F.lit(status), "error": F.lit(error).cast("string")}).write.mode("append").parquet(path)
