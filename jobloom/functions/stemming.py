"""English stems by the published Porter2 rules, worked out once for each different word of a batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: letters, endings with their replacements (longest first within a step), exceptions.
VOWELS = "aeiouy"
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_FIRST = re.compile(r"^(?:gener|commun|arsen)")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_VERB = re.compile(r"(?:ingly|edly|ing|ed)$")


def _regions(word: str) -> tuple[int, int]:
    """Where the word's first and second region start: behind the first consonant after a vowel, and again."""
    start = _FIRST.match(word) or _REGION.search(word)
    first = start.end() if start else len(word)
    again = _REGION.search(word, first)
    return first, again.end() if again else len(word)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        return word[:-1]
    return word


def _verb(word: str, first: int) -> str:
    for end in ("eedly", "eed"):
        if word.endswith(end):
            return word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
    if (end := _VERB.search(word)) and re.search("[aeiouy]", word[: end.start()]):
        word = word[: end.start()]
        if word.endswith(("at", "bl", "iz")):
            return word + "e"
        if _DOUBLE.search(word):
            return word[:-1]
        if first >= len(word) and _SHORT.search(word):
            return word + "e"
    return word


def english_stem(word: str) -> str:
    """The stem of a lower-case word of letters and digits."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub("(^|[aeiouy])y", lambda m: m[1] + "Y", word)
    first, second = _regions(word)
    word = _plural(word)
    if word in FINAL:
        return word
    word = _verb(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    for end, put in STEP_2.items():
        if word.endswith(end):
            before = word[: -len(end)]
            if len(before) >= first and (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in set("cdeghkmnrt")):
                word = before + put
            break
    for end, put in STEP_3.items():
        if word.endswith(end):
            if len(word) - len(end) >= (second if end == "ative" else first):
                word = word[: -len(end)] + put
            break
    for end in STEP_4:
        if word.endswith(end):
            before = word[: -len(end)]
            if len(before) >= second and (end != "ion" or before[-1:] in ("s", "t")):
                word = before
            break
    if word.endswith("e"):
        if len(word) - 1 >= second or (len(word) - 1 >= first and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


_remembered = lru_cache(1 << 17)(english_stem)


def stem_all(words: Column) -> Column:
    """Arrays of words as arrays of stems, nulls in their places; a batch's different words are stemmed once."""
    return F.arrow_udf(_stem_arrays, "array<string>")(words)


def _stem_arrays(words: pa.Array) -> pa.Array:
    flat = words.flatten().dictionary_encode()
    stems = pa.array([None if w is None else _remembered(w) for w in flat.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(words), 0)
    ends = pc.cumulative_sum(sizes)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stems.take(flat.indices), mask=words.is_null())


def stem(words: Column) -> Column:
    return F.pandas_udf(_stems, "string")(words)


def _stems(words: pd.Series) -> pd.Series:
    known = {w: english_stem(w) for w in words.dropna().unique()}
    return words.map(known)
