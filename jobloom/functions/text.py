"""String functions over columns: titles, slugs, cities, names, HTML text and escaping."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PROVINCES

# Abbreviations of clinical roles and what they stand for.
ALIASES = {
    "rn": "registered nurse", "rpn": "registered practical nurse", "lpn": "licensed practical nurse", "np": "nurse practitioner",
    "psw": "personal support worker", "hca": "health care aide", "mlt": "medical laboratory technologist",
    "mrt": "medical radiation technologist", "slp": "speech language pathologist",
}
# What feeds write where a city should be, and how long a city's name may be.
PLACEHOLDERS = (
    "tbd", "tba", "n/a", "na", "none", "unknown", "various", "multiple", "other", "various locations", "multiple locations",
    "multiple sites", "various sites", "remote", "canada", "province wide", "provincewide", "all locations",
)
CITY_CHARS, CITY_WORDS = 40, 5
# Words of a title that keep their capitals, and those that stay small.
ACRONYMS = (
    "RN", "RPN", "LPN", "NP", "PSW", "HCA", "RCA", "MLT", "MRT", "SLP", "MOA", "LPNS",
    "ICU", "NICU", "PICU", "CCU", "ER", "OR", "UPCC", "MHSU", "ECG", "EEG", "MRI", "CT",
    "I", "II", "III", "IV", "V",
)
SMALL = ("of", "and", "the", "at", "in", "for", "to", "on", "or", "a")


#: Bytes of text that are Python strings at a time.
HELD = 4 << 20
# Fixed value: the combining marks that deaccenting removes.
MARKS = re.compile("[\u0300-\u036f]+")


def decomposed(v: str) -> str:
    """Canonical decomposition without the combining marks."""
    return MARKS.sub("", unicodedata.normalize("NFD", v))


def _accents() -> tuple[str, str]:
    """Characters of all scripts that become one other, with that one; marks that go are last and have none."""
    chars = [chr(n) for n in range(0x80, 0x30000) if not 0xD800 <= n <= 0xDFFF]  # the planes above hold none
    pairs = [(c, decomposed(c)) for c in chars]
    kept = [(c, d) for c, d in pairs if len(d) == 1 and d != c] + [(c, d) for c, d in pairs if not d]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


_FROM, _TO = _accents()


def deaccent(c: Column) -> Column:
    """Letters without their accents, by one native ``translate``; combining marks go.

    Characters that decompose to several, such as Hangul syllables, stay; ``deaccent_exact`` takes those too.
    """
    return F.translate(c, _FROM, _TO)


def deaccent_exact(c: Column) -> Column:
    """Canonical decomposition of any text without U+0300 to U+036F; text beyond ASCII goes through Arrow."""
    return F.coalesce(F.arrow_udf(_decomposed, "string")(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def _decomposed(texts: pa.Array) -> pa.Array:
    """``decomposed`` of each text; about ``HELD`` bytes of them are Python strings at a time, whatever the batch holds."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // HELD
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    done = [pa.array([None if t is None else decomposed(t) for t in texts[a:b].to_pylist()], pa.string()) for a, b in zip(edges, edges[1:], strict=False)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(done)


def normalize_title(c: Column) -> Column:
    """Lower-case ASCII words, requisition numbers gone, abbreviations spelled out."""
    plain = F.regexp_replace(F.lower(deaccent(c)), r"\breq\s*#?\s*\d+", " ")
    words = F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def slugify_title(title: Column, key: Column) -> Column:
    """At most 60 characters of dashed words, one dash trimmed at each end before the cut, and 8 of the key's hash."""
    dashed = F.regexp_replace(F.lower(deaccent(title)), "[^a-z0-9]+", "-")
    return F.concat(F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 60), F.lit("-"), F.substring(F.sha2(key, 256), 1, 8))


def slugify_city(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(deaccent(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_plausible_city(c: Column) -> Column:
    """True where a value reads like one place name; null is not one."""
    v = squeeze(c)
    good = (v != "") & ~F.lower(v).isin(*PLACEHOLDERS) & (F.length(v) <= CITY_CHARS) & (F.size(F.split(v, " ")) <= CITY_WORDS) & v.rlike("[A-Za-z]")
    return F.coalesce(good, F.lit(False))


def salvage_city(c: Column) -> Column:
    """The leading place name of a longer value, or null."""
    head = F.trim(F.element_at(F.split(c, ",|\\(|/|;| - | – "), 1))
    few = is_plausible_city(head) & (F.size(F.split(head, r"\s+")) <= 3)
    lead = F.regexp_extract(head, "^([A-ZÀ-Ý]\\S*(?: [A-ZÀ-Ý]\\S*){0,2})", 1)
    return F.when(few, head).when(is_plausible_city(lead), lead)


def clean_city(c: Column, default: Column | None = None) -> Column:
    """A plausible value itself, else what can be salvaged, else the default, else the value."""
    v = squeeze(c)
    other = F.trim(default) if default is not None else F.lit(None).cast("string")
    return F.when(is_plausible_city(v), v).otherwise(F.coalesce(salvage_city(v), F.when(is_plausible_city(other), other), v))


def _cased(c: Column, kept: Column) -> Column:
    """Words of letters and apostrophes capitalised; ``kept(upper word)`` ones upper, small ones but the first lower."""
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z'’]+|[^A-Za-z'’]+)"), 1)  # words and what is between them in turn
    first = F.when(c.rlike("^[A-Za-z'’]"), 0).otherwise(1)
    small = F.array(*[F.lit(w) for w in SMALL])
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    one = lambda w, i: F.when(kept(F.upper(w)), F.upper(w)).when((i != first) & F.array_contains(small, F.lower(w)), F.lower(w)).otherwise(capital(w))
    return F.array_join(F.transform(runs, one), "")


def title_case(c: Column, province: Column | None = None) -> Column:
    """A name in title case; of codes only the given province's keeps its capitals."""
    own = F.lit(None).cast("string") if province is None else F.upper(province)
    return _cased(c, lambda w: F.coalesce(w == own, F.lit(False)))


def display_title(c: Column) -> Column:
    """The title in title case with acronyms and numerals in capitals, where it is all capitals; else as it is."""
    return F.when(F.upper(c) == c, _cased(c, lambda w: w.isin(*ACRONYMS))).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Tags become spaces, basic references characters, and white space one space."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return squeeze(c)


def strip_header(c: Column) -> Column:
    """A description that starts with its job number loses all before its first tag."""
    at = F.locate("<", c)
    return F.when(c.startswith("Job Number:") & (at > 0), F.substr(c, at)).otherwise(c)


def json_escape(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def html_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def employer_line(employer: Column, facility: Column, city: Column) -> Column:
    """The employer, with its facility unless that is empty or starts with the city."""
    place = F.trim(F.coalesce(facility, F.lit("")))
    same = F.lower(F.trim(F.element_at(F.split(place, ","), 1))) == F.lower(F.trim(city))
    return F.when((place == "") | F.coalesce(same, F.lit(False)), employer).otherwise(F.concat(employer, F.lit(" · "), place))


def describe_criteria(city: Column, label: Column) -> Column:
    """What an alert asks for, in words; ``label`` is the category's label or null."""
    role = F.concat(label, F.lit(" jobs"))
    return (
        F.when(role.isNotNull() & city.isNotNull(), F.concat(role, F.lit(" in "), city))
        .when(role.isNotNull(), F.concat(role, F.lit(" anywhere")))
        .when(city.isNotNull(), F.concat(F.lit("All roles in "), city))
        .otherwise("All new healthcare jobs")
    )


def format_salary(low: Column, high: Column, period: Column) -> Column:
    money = lambda x: F.when(period == "hour", F.concat(F.lit("$"), F.format_string("%.2f", x.cast("double")))).otherwise(F.concat(F.lit("$"), F.format_number(x.cast("double"), 0)))
    return F.when(low.isNotNull() & high.isNotNull() & period.isNotNull(), F.concat(money(low), F.lit("–"), money(high), F.when(period == "hour", "/hr").otherwise("/yr")))


def lower_first(c: Column) -> Column:
    return F.when(c.rlike("^[A-Z][a-z]"), F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def province_name(code: Column) -> Column:
    """Name of a code; anything else passes through."""
    names = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def province_code(c: Column) -> Column:
    """Code of a name or code, whatever its case and accents, with or without the country's prefix; else null."""
    plain = F.regexp_replace(deaccent(F.lower(F.trim(c))), "^ca-", "")
    names = F.create_map(*[F.lit(x) for code, name in PROVINCES.items() for key in (name.lower(), code.lower()) for x in (key, code)])
    return F.try_element_at(names, plain)


def province_slug(code: Column) -> Column:
    return slugify_city(province_name(code))


def split_location(c: Column) -> Column:
    """(city, province) of "City, Province", "Zone, City, Province" or a province alone; bracket notes go."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(c, r"\s*\([^)]*\)", ""), ","), lambda p: F.trim(p)), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    code = province_code(last)
    city = F.try_element_at(parts, F.when(code.isNotNull(), F.lit(-2)).otherwise(F.lit(-1)))
    return F.struct(F.when(city.rlike(r"^\d"), F.lit(None).cast("string")).otherwise(city).alias("city"), code.alias("province"))


def town_of_line(location: Column, aliases: Column) -> Column:
    """(city, province) of a hand-written location: an alias of the whole, else its last line without a bracket note.

    The town stands before a closing province, behind any "Name - "; both are null where the province is unknown or
    the town is empty or has a digit, which makes it an address.
    """
    line = F.regexp_replace(squeeze(F.element_at(F.split(location, "\n"), -1)), r"\s*\([^)]*\)$", "")
    parts = F.split(F.coalesce(F.try_element_at(aliases, squeeze(location)), line), ",")
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    town = F.trim(F.element_at(F.split(F.try_element_at(parts, F.lit(-2)), " - "), -1))
    code = province_code(F.try_element_at(parts, F.lit(-1)))
    good = code.isNotNull() & (town != "") & ~town.rlike("[0-9]")
    return F.when(good, F.struct(town.alias("city"), code.alias("province")))


def category_slug(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("-"))


def source_job_id(key: Column) -> Column:
    """All after the first colon of a job's key."""
    return F.substr(key, F.locate(":", key) + 1)
