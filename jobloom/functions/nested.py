"""Maps, sections and default chains of semi-structured payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added, each worked out once a row.

    The optimizer puts a plain column's expression into filters and other places that use it. It leaves alone what
    depends on the partition at hand, which is why a condition on its number, always true, stands around each column.
    """
    return df.withColumns({name: F.when(F.spark_partition_id() >= 0, c) for name, c in columns.items()})


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it.

    Spark works out a repeated expression again in each branch of a condition and for each element inside a lambda; here
    it is the variable of a lambda over one element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(c: Column) -> Column:
    """The value, null where it is empty."""
    return bound(c, lambda v: F.nullif(v, F.lit("")))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*map(filled, columns))


def json_path(c: Column, path: str, default: Column | None = None) -> Column:
    found = F.get_json_object(c, path)
    return found if default is None else F.coalesce(found, default)


def join_sections(*sections: tuple[Column, Column, str]) -> Column:
    """(title, text, heading where the title is missing) in order, those without text left out."""
    parts = [F.when(F.coalesce(F.trim(text), F.lit("")) != "", F.concat(F.lit("<h3>"), first_filled(title, F.lit(heading)), F.lit("</h3>"), text)) for title, text, heading in sections]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "")


def normal_label(c: Column) -> Column:
    """A label without format characters, colon and surplus white space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), ":", ""), r"\s+", " ")))


def pick(fields: Column, *labels: str, normal: bool = False) -> Column:
    """Value of the first of the labels that a map has, whatever its case; ``normal`` maps have ``normal_label`` keys."""
    low = fields if normal else F.transform_keys(F.map_filter(fields, lambda k, v: k.isNotNull()), lambda k, v: normal_label(k))
    return F.coalesce(*[F.try_element_at(low, F.lit(label.lower())) for label in labels])


def pick_matching(fields: Column, pattern: str) -> Column:
    """Value of the first entry whose key matches."""
    return F.try_element_at(F.filter(F.map_entries(fields), lambda e: e["key"].rlike(pattern)), F.lit(1))["value"]


def label_map(labels: Column, values: Column, keep_last: bool = False) -> Column:
    """A map of two parallel arrays; of a repeated label the first value stays, or the last."""
    pairs = F.arrays_zip(F.transform(labels, normal_label).alias("k"), values.alias("v"))
    pairs = F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    keys = lambda ordered: F.transform(ordered, lambda q: q["key"])
    first = lambda ordered: bound(keys(ordered), lambda k: F.filter(ordered, lambda p, i: ~F.array_contains(F.slice(k, 1, i), p["key"])))
    return F.map_from_entries(bound(F.reverse(pairs) if keep_last else pairs, first))
