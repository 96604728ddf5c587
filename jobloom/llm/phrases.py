"""Phrase collocation mining by best-first branch and bound over prefixes.

Words and pairs of words are counted over the whole corpus; pairs that occur often enough are the branches. A phrase of
three words that begins with the pair (x, y) occurs at most ``m = min(f(x y), most that y is followed by one word)``
times, and cutting it after x scores at most ``SCALE * m / f(x)``, as what follows x occurs as often as the phrase at
least. That bound is admissible, so a language's branches are taken in the order of the larger of their own score and
their bound: all with ``threshold`` or more are expanded in one scan of the texts, which counts just the phrases of three
words that begin with one of them, and those that end with a pair whose own survival is asked. Then every phrase with a
score of the threshold or more is known, and whether it survives. Languages that have ``top`` such phrases are settled,
ties included; for the others the threshold falls and the frontier grows, in the end to all branches.

Scans run in Arrow batches and add up blocks of words before Spark adds up the tasks' rows, so a phrase that is common
sends one row a block. Thresholds come from counts of the at most SCALE + 1 bounds of a language. A frontier of up to
``SENT`` pairs travels to the scan as 64-bit hashes (two pairs of one hash only cost a count more); a larger one does
not, and then all phrases of three words are counted and meet the frontier in a join.

Defined results: null text is empty; null lang is ``und``; repeated rows count each time; the last result is ordered by
score, count and phrase, which tell all phrases of a language apart; an empty table has no phrases. Scores are computed
in decimals of 38 digits, exact while counts stay below 10**15.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, give_back, mixed, pieces, read_table, stored, utf8, word_hashes

SCALE = 1_000_000
#: Least count of a phrase, phrases wanted of each language, and the share in percent at which a longer phrase covers a shorter.
LEAST, TOP, COVER = 10, 2000, 50
#: Branches of a language that are expanded first, for each phrase wanted, and by how much more each time.
WIDTH, GROWTH = 8, 8
#: Pairs of a frontier that are sent to the scan.
SENT = 1_000_000
#: Words that a task holds, bytes of a text that it splits at a time, rows that it hands on at a time.
BLOCK, SLICE, ROWS = 1_000_000, 2 << 20, 65_536

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 10)
_EDGE = re.compile(rb"[ .]")


def words(raw: bytes, most: int = SLICE):
    """Lists of a text's words in order, with ``.`` between pieces; a text beyond ``most`` bytes comes in several."""
    raw = raw.translate(_LOWER)
    start = 0
    while start < len(raw):
        edge = _EDGE.search(raw, start + most)
        end = edge.start() if edge else len(raw)
        yield raw[start:end].replace(b".", b" . ").split()
        start = end


def scan(df: DataFrame, sizes: tuple[int, ...], chosen=None, most: int = BLOCK) -> DataFrame:
    """Rows (lang, phrase, n) of the n-grams of the given sizes, added up over blocks of words of one language.

    ``chosen(codes, unique, lang)`` tells at which places phrases are wanted, of a block's words as places in ``unique``.
    A block of ``most`` words takes up where the one before it ended, so that none is lost or met twice between them;
    ``phrase`` is null in the rows with the number of words.
    """
    back = max(sizes) - 1

    def counted(lang: str, block: list[bytes], carried: int):
        arr = np.empty(len(block), object)
        arr[:] = block
        codes, unique = pd.factorize(arr)
        names, n = pa.array(unique, pa.binary()), len(unique)
        real = np.array([w != b"." for w in unique.tolist()], bool)[codes]
        wanted = chosen(codes, unique, lang) if chosen else None
        for size in sizes:
            places = len(codes) - size + 1
            first = max(0, carried - size + 1)
            if places <= first:
                continue
            valid = np.logical_and.reduce([real[k : places + k] for k in range(size)])
            valid[:first] = False
            if wanted is not None:
                valid &= wanted
            at = np.flatnonzero(valid)
            if not len(at):
                continue
            if size == 1:
                yield lang, None, np.array([len(at)])
            key = codes[at].astype(np.int64)
            for k in range(1, size):
                key = key * n + codes[at + k]
            key, many = np.unique(key, return_counts=True)
            parts = []
            for _ in range(size):
                parts.append(names.take(pa.array(key % n)))
                key = key // n
            parts = parts[::-1]
            phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, b" ")
            yield lang, phrase.cast(pa.string()), many

    def rows(lang, block, carried):
        for name, phrase, many in counted(lang, block, carried):
            for start in range(0, len(many), ROWS):
                n = pa.array(many[start : start + ROWS], pa.int64())
                own = pa.nulls(len(n), pa.string()) if phrase is None else phrase[start : start + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), own, n], ["lang", "phrase", "n"])

    def run(batches):
        held: dict[str, tuple[list[bytes], int]] = {}
        size = 0
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                for lang, raw in zip(part.column("lang").to_pylist(), utf8(part.column("text")), strict=True):
                    for more in words(raw):
                        block, _ = held.setdefault(lang, ([], 0))
                        block += more
                        size += len(more)
                        if size > most:
                            for name, (block, carried) in held.items():
                                yield from rows(name, block, carried)
                            tail = held[lang][0][-back:] if back else []
                            held, size = {lang: (tail, len(tail))}, len(tail)
                    held.setdefault(lang, ([], 0))[0].append(b".")
        for name, (block, carried) in held.items():
            yield from rows(name, block, carried)
        give_back()

    return df.mapInArrow(run, "lang string, phrase string, n long")


def pair_hashes(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    own = mixed(word_hashes([lang.encode()]))[0]
    return mixed(mixed(first + own) * np.uint64(3) + second)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n) of words and pairs with LEAST occurrences, and of each language's words (phrase null)."""
    return _added(scan(docs, (1, 2))).filter(f"phrase IS NULL OR n >= {LEAST}")


def triples(docs: DataFrame, frontier: DataFrame, most: int = SENT) -> DataFrame:
    """(lang, phrase, n) of the phrases of three words that begin or end with a pair of the frontier."""
    if frontier.count() <= most:
        sent = _hashes(frontier)

        def chosen(codes: np.ndarray, unique: np.ndarray, lang: str) -> np.ndarray:
            hashes = word_hashes(unique.tolist())
            pairs = pair_hashes(hashes[codes[:-1]], hashes[codes[1:]], lang)
            known = [_among(pairs, some) for some in sent]
            return known[0][:-1] | known[1][1:]

        return _added(scan(docs, (3,), chosen))
    found = _added(scan(docs, (3,)))
    both = found.withColumn("head", F.substring_index("phrase", " ", 2)).withColumn("tail", F.substring_index("phrase", " ", -2))
    at = lambda c, flag: frontier.filter(flag).select("lang", F.col("phrase").alias(c), F.lit(True).alias(f"is_{c}"))
    both = both.join(at("head", "onward"), ["lang", "head"], "left").join(at("tail", "asked"), ["lang", "tail"], "left")
    return both.filter("is_head OR is_tail").select("lang", "phrase", "n")


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _among(pairs: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(pairs), bool)
    return some[np.minimum(np.searchsorted(some, pairs), len(some) - 1)] == pairs


def _hashes(frontier: DataFrame) -> list[np.ndarray]:
    """Sorted hashes of the pairs that are expanded onward, and of those whose survival is asked; at most SENT."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            langs = np.array(batch.column("lang").to_pylist(), object)
            first, second = zip(*[p.split(b" ") for p in utf8(batch.column("phrase"))], strict=True) if batch.num_rows else ((), ())
            first, second = word_hashes(list(first)), word_hashes(list(second))
            for lang in set(langs.tolist()):
                mine = langs == lang
                out[mine] = pair_hashes(first[mine], second[mine], lang)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column("onward"), batch.column("asked")], ["hash", "onward", "asked"])

    found = frontier.select("lang", "phrase", "onward", "asked").mapInArrow(run, "hash long, onward boolean, asked boolean").toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    return [np.unique(hashes[found.column(c).to_numpy()]) for c in ("onward", "asked")]


def _scored(a: str, left: str, right: str) -> F.Column:
    return F.expr(f"(cast({SCALE} AS decimal(7,0)) * (cast({a} AS decimal(15,0)) * cast({a} AS decimal(15,0)))) div (cast({left} AS decimal(15,0)) * cast({right} AS decimal(15,0)))")


def _branches(grams: DataFrame) -> DataFrame:
    """Pairs with the counts of their words, their score and their bound, -1 where nothing can follow."""
    split = F.split("phrase", " ")
    pairs = grams.filter("size(split(phrase, ' ')) = 2").select("lang", "phrase", split[0].alias("x"), split[1].alias("y"), F.col("n").alias("a"))
    onward = pairs.groupBy("lang", F.col("x").alias("w")).agg(F.max("a").alias("most"))
    single = grams.filter("phrase IS NOT NULL AND instr(phrase, ' ') = 0").select("lang", F.col("phrase").alias("w"), F.col("n").alias("f"))
    single = checked(stored(single.join(onward, ["lang", "w"], "left"), "phrase-words"))
    named = lambda w, f, most: single.select("lang", F.col("w").alias(w), F.col("f").alias(f), F.col("most").alias(most))
    both = pairs.join(named("x", "fx", "__"), ["lang", "x"]).join(named("y", "fy", "most"), ["lang", "y"])
    bound = F.expr(f"coalesce((cast({SCALE} AS decimal(7,0)) * cast(least(a, most) AS decimal(15,0))) div cast(fx AS decimal(15,0)), -1)")
    return both.select("lang", "phrase", "a", "fx", "fy", _scored("a", "fx", "fy").alias("score"), bound.alias("bound"))


def _thresholds(branches: DataFrame, most: int) -> DataFrame:
    """(lang, threshold): the largest bound at which a language's best ``most`` branches are all taken, or 0."""
    sums = branches.groupBy("lang", F.greatest("score", "bound").alias("key")).agg(F.count("*").alias("n"))
    taken = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("key")))  # SCALE + 2 rows a language at most
    return sums.withColumn("taken", taken).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("taken") >= most, F.col("key"))), F.lit(0)).alias("threshold"))


def _found(branches: DataFrame, triples: DataFrame, limits: DataFrame) -> DataFrame:
    """Surviving phrases whose score reaches their language's threshold."""
    triples = triples.select("lang", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 2).alias("head"), F.substring_index("phrase", " ", -2).alias("tail"))
    head = branches.select("lang", F.col("phrase").alias("head"), F.col("a").alias("n_head"), F.col("fx").alias("n_first"))
    tail = branches.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("n_tail"), F.col("fy").alias("n_last"))
    cut = triples.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    cut = cut.withColumn("one", _scored("a", "n_first", "n_tail")).withColumn("two", _scored("a", "n_head", "n_last"))
    pick = lambda one, two: F.when(F.col("one") <= F.col("two"), F.col(one)).otherwise(F.col(two))
    longer = cut.select("lang", "phrase", "a", pick("n_first", "n_head").alias("l"), pick("n_tail", "n_last").alias("r"), F.least("one", "two").alias("score"))

    inside = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    shorter = branches.join(limits, "lang").filter("score >= threshold").join(inside, ["lang", "phrase"], "left")
    shorter = shorter.filter(f"around IS NULL OR 100 * around < {COVER} * a").select("lang", "phrase", "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    return longer.join(limits, "lang").filter("score >= threshold").select(*shorter.columns).union(shorter)


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, width: int = WIDTH) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's first ``top`` phrases."""
    docs = df.select(F.coalesce(df[lang_col], F.lit("und")).alias("lang"), df[text_col].alias("text"))
    grams = stored(_counts(docs), "phrase-counts")
    branches = stored(_branches(grams), "phrase-branches")
    limits, most = stored(_thresholds(branches, width * top), "phrase-limits"), width * top
    while True:
        own = branches.join(checked(limits), "lang")
        frontier = own.select("lang", "phrase", (F.col("bound") >= F.col("threshold")).alias("onward"), (F.col("score") >= F.col("threshold")).alias("asked"))
        frontier = frontier.withColumn("onward", F.expr("onward OR asked")).filter("onward OR asked")
        frontier = stored(frontier, "phrase-frontier")
        longer = stored(triples(docs, frontier).filter(f"n >= {LEAST}"), "phrase-triples")
        found = stored(_found(branches, longer, checked(limits)), "phrase-found")
        known = found.groupBy("lang").agg(F.count("*").alias("known"))
        state = stored(limits.join(known, "lang", "left").withColumn("open", F.expr(f"threshold > 0 AND coalesce(known, 0) < {top}")), "phrase-state")
        if state.filter("open").isEmpty():
            break
        most *= GROWTH
        lower = _thresholds(branches.join(checked(state.filter("open").select("lang")), "lang", "left_semi"), most).withColumnRenamed("threshold", "lower")
        limits = stored(state.join(lower, "lang", "left").select("lang", F.coalesce("lower", "threshold").alias("threshold")), "phrase-limits")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    total = grams.filter("phrase IS NULL").select("lang", "n")
    return first.join(checked(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir):
    """The first 2000 phrases of every language in all documents."""
    return mine(read_table(spark, sf_dir, "documents").select("lang", "text"))
