"""English search: stems of the published examples, and the same results as stemming by hand."""

import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions.stemming import english_stem, stem
from jobloom.operators import search

# Words and stems as published with the algorithm.
PUBLISHED = """consign consign consigned consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori console consol consolidating consolid consolingly consol
conspicuous conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knackeries knackeri knavish knavish kneeling kneel knife knife knightly knight knitted knit knitting knit knives knive knocker knocker knotted knot
sky sky skies sky dying die news news inning inning proceed proceed generate generat generously generous communism communism arsenal arsenal ties tie flies fli cries cri agreed agre feed feed happy happi by by say say relational relat conditional condit
hopping hop hoping hope falling fall luxuriating luxuri gas gas this this gaps gap kiwis kiwi""".split()


def test_stems_of_published_words(spark):
    pairs = list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    assert [(w, english_stem(w)) for w, _ in pairs] == pairs
    rows = spark.createDataFrame([*pairs, (None, None)], "w string, s string").select("s", stem(F.col("w")).alias("x")).collect()
    assert all(r["s"] == r["x"] for r in rows)
    assert len(set(search.STOP_WORDS)) == 127 and {"again", "against", "should", "now"} <= set(search.STOP_WORDS)


DOCS = [(1, "Registered nurses wanted for nursing homes"), (2, "A nurse's home"), (3, "Homes for rent"), (4, "The nursing of plants"), (5, None), (6, ""), (7, "home nurse home")]


@pytest.mark.parametrize(
    "asked, want",
    [("nurse", {1, 2, 4, 7}), ("nursing home", {1, 2, 7}), ('"nurse homes"', {1, 7}), ('"home nursing"', {7}), ("renting or registering", {1, 3}), ("nurses -homes", {4}), ("the", set()), ("plants the", {4})],
)
def test_words_match_by_stem_on_both_sides(spark, asked, want):
    index = search.build_index(spark.createDataFrame(DOCS, "id long, text string"), {"C": "text"}, stemmed=True)
    queries = spark.createDataFrame([(1, asked)], "qid int, q string")
    assert {r["id"] for r in search.web_search(index, queries, stemmed=True).collect()} == want


def test_index_terms_are_the_stems_by_hand(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    want = {(i, english_stem(w), k) for i, t in DOCS for k, w in enumerate(x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x) if w not in search.STOP_WORDS}
    assert {(r["id"], r["term"], r["pos"]) for r in search.build_index(df, {"C": "text"}, stemmed=True).select("id", "term", F.col("pos")).collect()} == want


@pytest.mark.parametrize("stemmed", [False, True])
def test_sizes_of_terms_equal_those_of_the_index(spark, stemmed):
    rows = [*DOCS, (1, "nurse nurses again nursing"), (None, "nurse home"), (None, "nurse"), (7, None), (7, "home of homes"), (8, "naïve Homes; homes!")]
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    index = search.build_index(df, {"C": "text"}, "key", stemmed)
    want = index.groupBy("term").agg(F.countDistinct("id").alias("docs"), F.count("*").alias("places"), F.sum("pos").alias("at"))
    for some in (df, df.filter("key > 1 AND key < 7"), df.limit(0)):
        given = want if some is df else search.build_index(some, {"C": "text"}, "key", stemmed).groupBy("term").agg(F.countDistinct("id").alias("docs"), F.count("*").alias("places"), F.sum("pos").alias("at"))
        assert sorted(map(tuple, search.term_sizes(some, "text", "key", stemmed).collect())) == sorted(map(tuple, given.collect()))


def test_pairs_of_terms_and_documents_stay_in_their_task(spark):
    df = spark.range(2000).selectExpr("id", "concat_ws(' ', transform(sequence(1, 20), x -> concat('w', x % 7))) AS text").repartition(2)
    plan = search.term_sizes(df, "text")
    rows = plan.collect()
    assert len(rows) == 7 and sum(r["docs"] for r in rows) == 14_000
    assert "count(distinct" not in plan._jdf.queryExecution().toString().lower()
    index = search.build_index(df, {"C": "text"})
    found = search.web_search(index, spark.createDataFrame([(1, "w1 -w9"), (2, "w3 -w2")], "qid int, q string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode(transform") == 1  # one read of the texts
    assert {r["qid"] for r in found.collect()} == {1}
