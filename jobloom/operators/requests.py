"""Requests and addresses as tables: sanitised search parameters, allowed hosts, alias joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..schema import CATEGORIES, EMPLOYMENT_TYPES, LAST_PAGE

# Limits of a search request and its sort orders.
MAX_QUERY, MAX_NAME, MAX_VALUES, SORTS = 120, 80, 20, ("newest", "salary")


def _names(c: Column) -> Column:
    kept = F.filter(F.transform(F.slice(c, 1, MAX_VALUES), lambda v: F.trim(v)), lambda v: (v != "") & (F.length(v) <= MAX_NAME))
    return _filled(F.array_distinct(kept))


def _filled(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _enum(c: Column, allowed: tuple[str, ...]) -> Column:
    return _filled(F.array_intersect(F.slice(c, 1, MAX_VALUES), F.array(*[F.lit(a) for a in allowed])))


def normalize_requests(df: DataFrame, categories: tuple[str, ...] = CATEGORIES, types: tuple[str, ...] = EMPLOYMENT_TYPES) -> DataFrame:
    """Request rows with valid parameters only: bad values go one by one, bad scalars fall to their default."""
    q, page = F.trim("q"), F.trim("page").try_cast("int")
    return df.withColumns(
        {
            "q": F.when((q != "") & (F.length(q) <= MAX_QUERY), q),
            "city": _names(F.col("city")),
            "employer": _names(F.col("employer")),
            "category": _enum(F.transform("category", lambda v: F.replace(v, F.lit("-"), F.lit("_"))), categories),
            "employment_type": _enum(F.col("employment_type"), types),
            "sort": F.when(F.col("sort").isin(*SORTS), F.col("sort")).otherwise("newest"),
            "page": F.when(page.between(1, LAST_PAGE), page).otherwise(1),
        }
    )


def require_host(df: DataFrame, url: str, hosts: list[str], schemes: tuple[str, ...] = ("https",)) -> tuple[DataFrame, DataFrame]:
    """Rows whose address has an allowed scheme and host, or a host below one; and the others."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    here = F.lit(False)
    for h in hosts:
        here = here | (host == h) | host.endswith("." + h)
    ok = F.coalesce(here & F.lower(F.try_parse_url(F.col(url), F.lit("PROTOCOL"))).isin(*schemes), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def apply_aliases(df: DataFrame, registry: DataFrame, location: str = "location") -> DataFrame:
    """``df`` with ``place``: the registry's alias of a location (white space squeezed), else the location."""
    known = registry.select(F.explode("aliases").alias("a", "place")).groupBy(squeeze(F.col("a")).alias("a")).agg(F.min("place").alias("place"))
    joined = df.join(F.broadcast(known), squeeze(F.col(location)) == F.col("a"), "left") if bounded(registry) else df.join(known, squeeze(F.col(location)) == F.col("a"), "left")
    return joined.drop("a").withColumn("place", F.coalesce("place", location))


def bounded(df: DataFrame, most: int = 8 << 20) -> bool:
    """True where the plan's own estimate proves a table small enough to broadcast."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def read_registry(df: DataFrame, schemas: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): active employers of supported platforms whose settings have all fields of the platform's schema."""
    rows = df.filter(F.col("is_active") & F.col("ats_platform").isin(*schemas))
    ok = F.lit(False)
    for platform, schema in schemas.items():
        parsed = F.from_json("ats_config", schema)
        fields = [f.split()[0] for f in schema.split(", ")]
        whole = F.lit(True)
        for f in fields:
            whole = whole & parsed.getField(f).isNotNull()
        ok = ok | ((F.col("ats_platform") == platform) & whole)
    ok = F.coalesce(ok, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)
