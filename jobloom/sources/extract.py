"""Landed payloads and pages as rows: JSON files, JSON-LD blocks, sitemaps, list rows, labelled fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nested import bound, filled, label_map
from ..functions.text import html_to_text, squeeze
from ..operators.ordered import stored

JSON_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def read_json_payloads(spark: SparkSession, path: str, schema: str, items: str | None = None) -> DataFrame:
    """Landed JSON files, one payload a file; ``items`` names an array to open into rows."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df if items is None else df.select(F.explode(items).alias("item")).select("item.*")


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(JSON_LD), 1)


def job_posting(html: Column, rule: str = "graph") -> Column:
    """Text of a page's job record: the ``first`` block, the first of the ``type``, or that also inside a ``graph``."""
    blocks = F.filter(json_ld_blocks(html), lambda b: F.try_parse_json(b).isNotNull())
    if rule == "first":
        return F.try_element_at(json_ld_blocks(html), F.lit(1))
    if rule == "graph":
        nodes = F.transform(blocks, lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>"), F.array(b)))
        blocks = F.flatten(nodes)
    return F.try_element_at(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "JobPosting"), F.lit(1))


def extract_jsonld(pages: DataFrame, html: str = "html", rule: str = "graph") -> DataFrame:
    """Pages with ``posting``, the job record's JSON text, null where a page has none."""
    return pages.withColumn("posting", job_posting(F.col(html), rule))


def parse_sitemap(files: DataFrame, id_pattern: str, require_lastmod: bool, content: str = "content") -> DataFrame:
    """(id, loc, lastmod) of a sitemap's addresses that match; without a date where none is needed."""
    entry = F.explode(F.split(F.col(content), "</url>|</sitemap>"))
    rows = files.select(entry.alias("e")).select(
        F.regexp_extract("e", r"<loc>\s*([^<\s]+)\s*</loc>", 1).alias("loc"),
        F.try_to_timestamp(F.nullif(F.regexp_extract("e", r"<lastmod>\s*([^<\s]+)\s*</lastmod>", 1), F.lit(""))).alias("lastmod"),
    )
    rows = rows.withColumn("id", F.nullif(F.regexp_extract("loc", id_pattern, 1), F.lit(""))).filter("id IS NOT NULL")
    return (rows.filter("lastmod IS NOT NULL") if require_lastmod else rows).select("id", "loc", "lastmod")


def resolve_sitemaps(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(url, content) of the lists of addresses that ``roots`` (url) reach through indexes, each once.

    ``files`` are landed files (url, content). The frontier holds addresses not met before, so an index that names itself
    or one above it ends; each level is one join with the files and is written to the shared folder. Addresses without a
    landed file are left out.
    """
    index = F.col("content").rlike(r"<sitemapindex[\s>]")
    seen = frontier = stored(roots.select("url").distinct(), "sitemaps")
    lists = files.select("url", "content").limit(0)
    while not frontier.isEmpty():
        met = stored(files.join(frontier, "url").groupBy("url").agg(F.max("content").alias("content")), "sitemaps")
        lists = lists.union(met.filter(~index))
        named = met.filter(index).select(F.explode(F.split("content", "</sitemap>")).alias("e"))
        children = named.select(F.regexp_extract("e", r"<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url")).filter("url != ''").distinct()
        frontier = stored(children.join(seen, "url", "left_anti"), "sitemaps")
        seen = seen.union(frontier)
    return lists


def parse_list_rows(pages: DataFrame, keys: list[str], row_split: str, patterns: dict[str, str], html: str = "html") -> DataFrame:
    """One row per list row with the pattern columns as text; rows without the first pattern, and repeats of it, go."""
    first = next(iter(patterns))
    parts = pages.select(*keys, F.posexplode(F.split(F.col(html), row_split)).alias("at", "part")).filter("at > 0")
    rows = parts.select(*keys, "at", *[html_to_text(F.regexp_extract("part", p, 1)).alias(c) for c, p in patterns.items()]).filter(F.col(first) != "")
    rank = F.row_number().over(Window.partitionBy(*keys, first).orderBy("at"))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r", "at")


def prose_fields(text: Column, labels: list[str], limit: int = 200) -> Column:
    """MAP of "Label: value" out of prose: a value ends where any of the labels starts."""
    stop = "|".join(re.escape(label) for label in labels)
    values = [F.substring(F.trim(F.regexp_extract(text, rf"(?s){re.escape(label)}\s*:\s*(.*?)(?=\s*(?:{stop})\s*:|$)", 1)), 1, limit) for label in labels]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(label) for label in labels]), F.array(*values)), lambda k, v: v != "")


def tag_fields(html: Column, pattern_label: str, pattern_value: str, keep_last: bool = False) -> Column:
    """MAP of parallel label and value elements, such as dt and dd."""
    found = lambda pattern: F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), html_to_text)

    def paired(both: Column) -> Column:
        size = F.least(F.size(both["labels"]), F.size(both["values"]))
        return label_map(F.slice(both["labels"], F.lit(1), size), F.slice(both["values"], F.lit(1), size), keep_last)

    return bound(F.struct(found(pattern_label).alias("labels"), found(pattern_value).alias("values")), paired)


def dl_fields(html: Column) -> Column:
    return tag_fields(html, r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd", r"(?is)<dt[^>]*>.*?</dt>\s*<dd[^>]*>(.*?)</dd>", keep_last=True)


def card_fields(html: Column) -> Column:
    """MAP of cards: a title heading with a text paragraph right behind it; of a repeated title the first stays."""
    after = F.transform(F.split(html, "(?i)<h6(?=[^a-z0-9])"), lambda x: F.split(x, "(?i)</h6>", 2))
    cards = F.filter(after, lambda x: F.try_element_at(x, F.lit(1)).rlike("^[^>]*card-title") & F.try_element_at(x, F.lit(2)).rlike(r"(?i)^\s*<p(?=[^a-z0-9])[^>]*card-text"))
    inside = lambda x: F.regexp_replace(x, r"^\s*(?:<p)?[^>]*>", "")
    labels = F.transform(cards, lambda x: html_to_text(inside(x[0])))
    values = F.transform(cards, lambda x: html_to_text(inside(F.element_at(F.split(x[1], "(?i)</p>"), 1))))
    return label_map(labels, values)


def li_fields(html: Column) -> Column:
    return tag_fields(html, r"(?is)<li>(?:<b>)?([^:<]+):\s*(?:</b>\s*)*[^<]*</li>", r"(?is)<li>(?:<b>)?[^:<]+:\s*(?:</b>\s*)*([^<]*)</li>", keep_last=True)


def meta(html: Column, attribute: str, name: str) -> Column:
    return filled(F.regexp_extract(html, rf'(?i)<meta[^>]*{attribute}="{re.escape(name)}"[^>]*content="([^"]*)"', 1))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources as one canonical table; columns that a source lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def decoded(c: Column) -> Column:
    """Basic references as characters, tags untouched."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def plain_title(c: Column, times: int = 1) -> Column:
    for _ in range(times):
        c = decoded(c)
    return squeeze(c)
