"""Phrase mining against plain Python: rounds, ties, blocks, covers, null and repeated rows, large frontiers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import entry, phrases

RNG = np.random.default_rng(11)
COMMON = "the of and to in a is it for on".split()


def prose(k):
    out = []
    for _ in range(int(RNG.integers(1, 12))):
        piece = list(RNG.choice(COMMON, int(RNG.integers(1, 9)), p=np.arange(10, 0, -1) / 55))
        if RNG.random() < 0.5:
            piece += [["new", "york", "city"], ["san", "jose"], [f"rare{k % 17}", f"pair{k % 17}"], ["Vice", "president", "of"]][int(RNG.integers(4))]
        out.append("  ".join(piece) if RNG.random() < 0.1 else " ".join(piece))
    return RNG.choice([". ", ", ", "\n", ";", "! "]).join(out)


ROWS = [(i, prose(i), ("en", "fr", None, "und")[i % 4] if i % 3 else "en") for i in range(900)]
ROWS += [(900, None, "en"), (901, "", "fr"), (902, "... ,, ;\n", None), (903, "one\x0bword", "xx"), (904, "Ünï\tÇ " * 30, "de"), (5, ROWS[5][1], ROWS[5][2]), (906, "tail of a long text " * 9000, "long")]


def expected(rows, top, least=phrases.LEAST):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items() if len(q) == 3 and b >= least):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in ("phrase", "n", "a", "score", "rank")}).repartition(5)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_op12_equals_plain_python(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(entry.queries()["op12_phrases"](spark, str(tmp_path))) == expected(ROWS, 2000)


@pytest.mark.parametrize(("top", "width"), [(3, 1), (12, 1)])
def test_frontiers_grow_until_the_last_score_is_settled(docs, top, width):
    assert got(phrases.mine(docs, top=top, width=width)) == expected(ROWS, top)


def test_a_frontier_too_large_to_send_meets_in_a_join(spark, docs):
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    asked = [("en", "new york", True, False), ("en", "york city", False, True), ("fr", "the of", True, True), ("zz", "the of", True, True)]
    frontier = spark.createDataFrame(asked, "lang string, phrase string, onward boolean, asked boolean")
    few, many = (got(phrases.triples(own, frontier, most)) for most in (1_000_000, 0))
    assert few == many and any(p == "new york city" for _, p, _ in few)


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_blocks_neither_lose_nor_repeat_phrases(spark, docs, most):
    own = docs.filter("doc_id < 60").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").coalesce(2)
    for sizes in ((1, 2), (3,)):
        added = [got(phrases.scan(own, sizes, most=m).groupBy(F.coalesce("phrase", F.lit("")), "lang").sum("n")) for m in (most, 10**6)]
        assert added[0] == added[1]


def test_texts_are_split_in_slices():
    text = ROWS[0][1].encode() * 20
    whole = [w for part in phrases.words(text) for w in part]
    assert all([w for part in phrases.words(text, most) for w in part] == whole for most in (1, 5, 64))


def test_an_empty_table_has_no_phrases(docs):
    assert phrases.mine(docs.limit(0)).collect() == []
