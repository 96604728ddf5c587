"""Read-side operators over job tables: scans, facets, feeds, aggregates, pay, roll-ups, similar jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import is_plausible_band
from ..functions.text import is_plausible_city, province_name, slugify_city
from ..schema import LANDING_MINIMUM, PAGE_SIZE
from .ordered import quantiles, running, same, stored


def scan_active(jobs: DataFrame, cols: list[str]) -> DataFrame:
    """Chosen columns of active rows; filter and columns reach the scan."""
    return jobs.filter("is_active").select(*cols)


def catalog(jobs: DataFrame, role: Column) -> DataFrame:
    """Active rows with their role and employer slug."""
    return jobs.filter("is_active").withColumns({"role": role, "employer_slug": slugify_city(F.col("employer_name"))})


def matches(filters: dict[str, list]) -> Column:
    """OR within a facet, AND across facets; an empty facet does not filter."""
    tests = [F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in filters.items() if values]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_facets(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    return df.filter(matches(filters))


def facet_counts(df: DataFrame, filters: dict[str, list], facets: list[str]) -> DataFrame:
    """(facet, value, n): rows under the filters of all other facets; values seen under none of them count 0.

    One pass: a row gives an entry for each facet with whether the other facets' filters hold.
    """
    entries = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), matches({k: v for k, v in filters.items() if k != f}).alias("ok")) for f in facets]
    rows = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("value IS NOT NULL AND value != ''")
    return rows.groupBy("facet", "value").agg(F.count_if("ok").alias("n"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def tally(df: DataFrame, key: str) -> DataFrame:
    return count_by(df.filter(F.col(key) != ""), key)


def pair_counts(df: DataFrame, a: str = "city", b: str = "category", least: int = LANDING_MINIMUM) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def indexable(agg: DataFrame, least: int, city: str | None = None) -> DataFrame:
    """Groups of at least ``least`` rows, with a plausible city where one is named."""
    kept = agg.filter(F.col("n") >= least)
    return kept.filter(is_plausible_city(F.col(city))) if city else kept


def landing_sets(jobs: DataFrame, sets: dict[str, list[str]], least: dict[str, int], updated: str = "updated_at") -> DataFrame:
    """(kind, path, n, last) for all key sets at once: one Expand over grouping sets, then thresholds."""
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    groups = [[F.col(k) for k in s] for s in sets.values()]
    out = jobs.groupingSets(groups, *keys).agg(F.count("*").alias("n"), F.max(updated).alias("last"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    kinds, tests = [], []
    for kind, own in sets.items():
        here = reduce(lambda a, b: a & b, [(F.col(f"_{k}") == (0 if k in own else 1)) for k in keys])
        filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in own])
        kinds.append(F.when(here & filled & (F.col("n") >= least.get(kind, 1)), F.struct(F.lit(kind).alias("kind"), F.concat_ws("/", F.lit(kind), *[slugify_city(F.col(k).cast("string")) for k in own]).alias("path"))))
        tests.append(here)
    return out.withColumn("at", F.coalesce(*kinds)).filter("at IS NOT NULL").select("at.kind", "at.path", "n", "last")


QUARTERS = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def summarize_pay(df: DataFrame, by: list[str]) -> DataFrame:
    """Pay by group from plausible bands of the group's majority period (a tie goes to the hour).

    Quantiles come from ranks in one order over all groups (``ordered.quantiles``), so no task sorts or holds a group.
    """
    good = df.filter(is_plausible_band(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))).withColumn("_mid", (F.col("salary_min") + F.col("salary_max")) / 2)
    good = stored(good.select(*by, "salary_period", "salary_min", "salary_max", "_mid"), "bands")  # read for bounds, ranks and their sample
    per = good.groupBy(*by, "salary_period").agg(F.count("*").alias("_n"), F.min("salary_min").alias("low"), F.max("salary_max").alias("high"))
    hour = F.when(F.col("salary_period") == "hour", 1).otherwise(0)
    best = F.max_by(F.struct("salary_period", "low", "high"), F.struct("_n", hour.alias("h"), "salary_period"))
    top = per.groupBy(*by).agg(best.alias("t")).select(*by, "t.*")
    keys = [*by, "salary_period"]
    found = quantiles(good, keys, "_mid", QUARTERS, "pay")
    return found.alias("q").join(top.alias("t"), same(keys, "q", "t")).select(*[F.col(f"q.`{k}`") for k in by], F.col("q.salary_period").alias("period"), "n", *QUARTERS, "low", "high")


def pay_guide(df: DataFrame, role: str, province: str, least: int) -> DataFrame:
    """Pay by role and province where the province's majority period is the role's."""
    whole = summarize_pay(df, [role]).filter(F.col("n") >= least).select(F.col(role).alias("r"), F.col("period").alias("p"))
    part = summarize_pay(df, [role, province])
    return part.join(whole, (F.col(role) == F.col("r")) & (F.col("period") == F.col("p"))).drop("r", "p")


def glance(df: DataFrame, by: list[str], types: tuple[str, ...]) -> DataFrame:
    """Number, employers, employment types in taxonomy order, paid rows with bounds of the majority period, newest."""
    paid = F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull() & F.col("salary_period").isNotNull()
    hour, year = paid & (F.col("salary_period") == "hour"), paid & (F.col("salary_period") == "year")
    agg = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("employer_name")), ", ").alias("employers"),
        F.collect_set("employment_type").alias("seen"),
        F.count_if(paid).alias("paid"),
        F.count_if(hour).alias("h"),
        F.count_if(year).alias("y"),
        *[f(F.when(test, F.col(c))).alias(f"{c}_{p}") for p, test in (("hour", hour), ("year", year)) for c, f in (("salary_min", F.min), ("salary_max", F.max))],
        F.max("posted_at").alias("newest"),
    )
    hourly = (F.col("h") >= F.col("y")) & (F.col("h") > 0)
    return agg.select(
        *by, "n", "employers",
        F.array_join(F.filter(F.array(*[F.lit(t) for t in types]), lambda t: F.array_contains("seen", t)), ", ").alias("types"),
        "paid", F.when(hourly, "hour").when(F.col("y") > 0, "year").alias("period"),
        F.when(hourly, F.col("salary_min_hour")).otherwise(F.col("salary_min_year")).alias("pay_low"),
        F.when(hourly, F.col("salary_max_hour")).otherwise(F.col("salary_max_year")).alias("pay_high"),
        "newest",
    )


def mode_by(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most common value of each group; ties go to the smaller value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter("rank = 1").drop("rank")


def distinct_sorted(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).select(group, value).distinct().groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("items"))


def region_name(df: DataFrame, province: str = "province") -> DataFrame:
    """One row: the only province's name, or the country's."""
    n = df.agg(F.countDistinct(province).alias("n"), F.min(province).alias("one"))
    return n.select(F.when(F.col("n") == 1, province_name(F.col("one"))).otherwise("Canada").alias("region"))


def landing_links(df: DataFrame, page: list[str], link: str, least: int, top: int, plausible: bool = False) -> DataFrame:
    """Of each page's rows, the ``top`` most common link values with at least ``least`` rows."""
    counts = df.filter(F.col(link).isNotNull()).groupBy(*page, link).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if plausible:
        counts = counts.filter(is_plausible_city(F.col(link)))
    rank = F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("n"), link))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def overview(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row: active rows, those of today, the two largest categories, the most common type, employers."""
    active = jobs.filter("is_active")
    one = active.agg(F.count("*").alias("active"), F.count_if(F.to_date("posted_at") == F.to_date(as_of)).alias("today"), F.countDistinct("employer_name").alias("employers"))
    top = count_by(active, "category").limit(2).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category"))), lambda s: s["category"]), ",").alias("top_categories"))
    kind = count_by(active, "employment_type").limit(1).agg(F.max("employment_type").alias("top_type"))
    return one.crossJoin(top).crossJoin(kind)  # three tables of one row


def feed_rank(jobs: DataFrame) -> DataFrame:
    """Active rows with their day and their place among their employer's rows of that day.

    The place is taken over all active rows, before any filter; the window's key bounds each employer by day.
    """
    day = jobs.filter("is_active").withColumn("posted_day", F.to_date("posted_at"))
    by = Window.partitionBy("employer_name", "posted_day").orderBy(F.desc("posted_at"), "id")
    return day.withColumn("employer_day_rank", F.row_number().over(by))


NEWEST = (F.desc, "posted_day"), (F.asc, "employer_day_rank"), (F.desc, "posted_at"), (F.asc, "id")


def newest_order() -> list[Column]:
    return [f(c) for f, c in NEWEST]


def order_feed(feed: DataFrame) -> DataFrame:
    return feed.orderBy(*newest_order())


def salary_order() -> list[Column]:
    return [F.desc_nulls_last("salary_min"), F.asc("id")]


def order_salary(feed: DataFrame) -> DataFrame:
    return feed.orderBy(*salary_order())


def placed(feed: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with ``place``, their number from 1 in the whole order."""
    return running(feed, order, F.lit(1), "placed").withColumnRenamed("upto", "place")


def page(feed: DataFrame, number: int, size: int = PAGE_SIZE, order: list[Column] | None = None) -> DataFrame:
    """One page in order: a top-k of the rows up to its end, never a full sort's output."""
    return feed.orderBy(*(order or newest_order())).offset((number - 1) * size).limit(size)


def newest(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k newest rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("posted_at"), "id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def today_or_recent(jobs: DataFrame, as_of: Column, k: int = 4) -> DataFrame:
    """Today's newest k active rows, or the newest k of all where today has none."""
    active = jobs.filter("is_active").withColumn("is_today", F.to_date("posted_at") == F.to_date(as_of))
    first = active.orderBy(F.desc("is_today"), F.desc("posted_at"), "id").limit(k)
    any_today = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return first.withColumn("any", F.max("is_today").over(any_today)).filter("is_today OR NOT any").drop("any")


def similar_jobs(jobs: DataFrame, k: int = 3) -> DataFrame:
    """(id, rank, other, tier) for all rows: same category and city, then category and province, then category;
    rows without category: city, then province. Newest first, no row itself, none twice.

    Each tier's lists are cut to the first ``3 * k`` rows of a group before the join: of those at most one is the row
    itself and at most 2 * k are taken by the tiers before.
    """
    rows = jobs.filter("is_active").select("id", "category", "city", "province", "posted_at")
    tiers = [(1, ["category", "city"], "category IS NOT NULL"), (2, ["category", "province"], "category IS NOT NULL"), (3, ["category"], "category IS NOT NULL"), (1, ["city"], "category IS NULL"), (2, ["province"], "category IS NULL")]
    found = None
    for tier, keys, test in tiers:
        # Rows without a category look among all rows of their place.
        pool = rows.filter(test) if "category" in keys else rows
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("posted_at"), "id"))
        heads = pool.withColumn("r", rank).filter(F.col("r") <= 3 * k + 1).select(*keys, F.col("id").alias("other"), F.col("posted_at").alias("other_at"))
        one = rows.filter(test).select("id", *keys).join(heads, keys).filter("id != other").select("id", "other", "other_at", F.lit(tier).alias("tier"))
        found = one if found is None else found.union(one)
    best = found.groupBy("id", "other").agg(F.min("tier").alias("tier"), F.max("other_at").alias("other_at"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("tier", F.desc("other_at"), "other"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "other", "tier")


def match_city(locs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stored spelling of each (city, province), whatever the case; of several the first."""
    stored = jobs.groupBy(F.lower(F.trim("city")).alias("k"), F.col("province").alias("p")).agg(F.min("city").alias("match"))
    return locs.join(stored, (F.lower(F.trim(locs["city"])) == F.col("k")) & (locs["province"] == F.col("p")), "left").drop("k", "p")


def resolve_slug(slugs: DataFrame, cities: DataFrame) -> DataFrame:
    """Stored city of each slug, the first of several, with the number that collide; null where none."""
    known = cities.select("city").distinct().groupBy(slugify_city(F.col("city")).alias("k")).agg(F.min("city").alias("match"), F.count("*").alias("collide"))
    return slugs.join(known, slugify_city(F.col("slug")) == F.col("k"), "left").drop("k")


def saved_jobs(saved: DataFrame, jobs: DataFrame) -> DataFrame:
    return jobs.filter("is_active").join(saved, "slug", "left_semi").orderBy(F.desc("posted_at"), "slug")


def lookup_slug(slugs: DataFrame, jobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(slug, status): active, gone or unknown."""
    live = jobs.filter("is_active").select("slug", F.lit(True).alias("live"))
    dead = tombstones.select("slug", F.lit(True).alias("dead")).distinct()
    both = slugs.join(live, "slug", "left").join(dead, "slug", "left")
    return both.select("slug", F.when(F.col("live"), "active").when(F.col("dead"), "gone").otherwise("unknown").alias("status"))
