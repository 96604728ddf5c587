"""Toxicity: held-out accuracy in languages with inflected insults, gradients, slices, and awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from jobloom.llm import entry, langid, toxicity

RNG = np.random.default_rng(3)
PLAIN = {"en": "the cat and dog went over to that house with them while rain fell on a quiet road".split(), "fr": "le chat et chien sont dans cette maison avec eux pendant que nous mangeons du pain".split()}
ROOTS, ENDS = {"en": ["vilgob"], "fr": ["mordac"]}, ["", "s", "er", "ing", "ent", "aux", "ique", "eux", "ail", "ous"]


def document(i):
    lang, toxic = ("en", "fr")[i % 2], int(i % 9 in (0, 1, 5))
    w = list(RNG.choice(PLAIN[lang], int(RNG.integers(20, 90))))
    for _ in range(3 if toxic else 0):
        w.insert(int(RNG.integers(len(w))), f"{RNG.choice(ROOTS[lang])}{RNG.choice(ENDS)}{RNG.choice(['', '!', ','])}")
    return i, " ".join(w), lang, toxic


ROWS = [document(i) for i in range(1200)]
LONG = " ".join(RNG.choice(PLAIN["en"], 300_000))
MORE = [(2000, None, "en"), (2001, "", None), (2002, " ,.! ", "fr"), (2003, LONG, "en"), (2004, LONG + " vilgobs vilgober! vilgobing", "en"), (2005, ROWS[1][1], "fr"), (2005, ROWS[1][1], "fr"), (None, ROWS[0][1], "en")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("toxic")
    rows = [r[:3] for r in ROWS] + MORE
    i, text, lang = zip(*rows, strict=True)
    table = {"doc_id": pa.array(i, pa.int64()), "text": pa.array(text, pa.string()), "lang": lang, "source": ["s"] * len(i), "score": [1] * len(i), "toxic": [1] * len(i)}
    pq.write_table(pa.table(table), at / "documents.parquet")
    labels = [(r[0], r[3]) for r in ROWS if r[0] % 11] + [(None, 1), (2003, None), (5, 0), (99999, 1)]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": [1] * len(labels), "toxic": pa.array([x[1] for x in labels], pa.int32())}), at / "labels.parquet")
    return str(at)


def test_op11_tells_held_out_rows_apart(spark, folder):
    rows = [r.asDict() for r in entry.queries()["op11_toxicity"](spark, folder).collect()]
    assert len(rows) == len(ROWS) + len(MORE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    tested = [r for r in ROWS if by[r[0]]["held_out"]]
    right = [by[r[0]]["predicted"] == r[3] for r in tested]
    assert len(tested) > 300 and np.mean(right) > 0.97
    assert by[2000]["score"] == by[2001]["score"] == by[2002]["score"] and by[2000]["predicted"] == 0
    assert by[2003]["predicted"] == 0 and by[2004]["predicted"] == 1
    assert {r["score"] for r in rows if r["doc_id"] == 2005} == {by[1]["score"]} and by[None]["score"] == by[0]["score"]


def test_scores_do_not_depend_on_labels_languages_or_ids(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs.filter("doc_id < 300"), labels)
    own = docs.filter("doc_id < 40").select("doc_id", "text", "lang")
    first = {r["doc_id"]: r["score"] for r in toxicity.predict(own, model).collect()}
    moved = own.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    assert {-r["doc_id"]: r["score"] for r in toxicity.predict(moved, model).collect()} == first


def test_without_both_labels_or_rows_all_scores_are_zero(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 20")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    for some in (labels, labels.limit(0)):
        assert {r["score"] for r in toxicity.predict(docs, toxicity.fit(docs, some)).collect()} == {0.0}
    none = docs.limit(0)
    assert toxicity.predict(none, toxicity.fit(none, labels)).collect() == []


def test_slices_give_the_scores_of_whole_texts():
    net = toxicity.Network()
    texts = [" ".join(f"{a}{b}" for a, b in zip(RNG.choice(PLAIN["en"], 200), RNG.choice(ENDS, 200), strict=True)) for _ in range(5)] + [""]
    whole = toxicity.score_words(net, [toxicity.words(t) for t in texts])
    for most, hold in ((40, 30), (1, 10), (500, 1)):
        assert np.allclose(whole, toxicity.score_words(net, [toxicity.words(t, most) for t in texts], hold), atol=1e-5)
    plain = []
    for t in texts:
        unique = t.lower().split()
        v = net.vectors(*toxicity.features(unique))[1:] if unique else np.zeros((0, toxicity.SIZE))
        v = np.vstack([v, np.zeros((toxicity.GAP, toxicity.SIZE))])
        most = np.concatenate([np.max([sum(v[i + k] @ net.filters[w][k] for k in range(w)) for i in range(len(unique))] or [np.full(toxicity.FILTERS, -np.inf)], axis=0) for w in toxicity.WIDTHS])
        plain.append(np.maximum(most + net.bias, 0) @ net.last + net.constant)
    assert np.allclose(whole, plain, atol=1e-4)


def test_a_labelled_sample_stays_near_its_bound(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 AS int) AS toxic")
    rows = toxicity.sample(docs, labels, 1000).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    n = {r["toxic"]: (r["n"], r["w"]) for r in rows}
    assert 400 < n[1][0] < 600 and 400 < n[0][0] < 600 and abs(n[0][1] - 5400) < 700


def test_every_labelled_row_teaches(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 1200")
    truth = {r[0]: r[3] for r in ROWS}
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if i % 4], "doc_id long, toxic int")
    for more in ({}, {"shard": 200}):  # the first network has seen a few rows only
        model = toxicity.fit(docs, labels, rows=30, **more)
        got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(docs.filter("doc_id % 4 = 0"), model).collect()}
        assert len(got) == 300 and np.mean([truth[i] == p for i, p in got.items()]) > 0.95
    assert toxicity.fit(docs, labels, rows=30, shard=200) == model


def test_long_texts_are_trained_on_whole(monkeypatch):
    net = toxicity.Network()
    line, starts = toxicity.laid([RNG.integers(1, 50, n) for n in (300, 0, 7, 120)])
    vectors = np.vstack([np.zeros((1, toxicity.SIZE)), RNG.standard_normal((50, toxicity.SIZE))]).astype(np.float32)
    whole = toxicity.largest(net, vectors, line, starts)
    monkeypatch.setattr(toxicity, "PLACES", 13)
    for a, b in zip(whole, toxicity.largest(net, vectors, line, starts), strict=True):
        assert np.allclose(a, b, atol=1e-5)


@pytest.mark.parametrize("bounds", [{}, {"AT_ONCE": 7, "KEPT": 0}])
def test_a_language_is_told_by_dot_products_as_by_cosines(monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(langid, name, value)
    protos = RNG.standard_normal((3, langid.DIMENSIONS))
    model, teller = langid.Model(["a", "b", "c"], protos), langid.Teller(["a", "b", "c"], protos)
    for text in [r[1] for r in ROWS[:60]] + ["", "12 ?!", "x", "Ελλάδα ΣΑΣ", "日本語 テキスト", LONG[:50_000]]:
        cosines = model.cosines(text)
        assert teller.language(text) == ("und" if cosines is None else model.langs[int(np.argmax(cosines))])
    assert langid.Teller([], np.zeros((0, langid.DIMENSIONS))).language("some text") == "und"
    assert teller.dots.shape[1] == 3 and teller.size <= len(teller.dots)  # a number a gram and language, no vector a gram


@pytest.mark.parametrize("near", [1, 13, 2048])
def test_responses_added_up_in_parts_are_those_of_the_line(monkeypatch, near):
    monkeypatch.setattr(toxicity, "NEAR", near)
    net = toxicity.Network()
    line, _ = toxicity.laid([RNG.integers(1, 50, n) for n in (300, 0, 1, 120)])
    vectors = np.vstack([np.zeros((1, toxicity.SIZE)), RNG.standard_normal((50, toxicity.SIZE))]).astype(np.float32)
    ahead = np.r_[line, np.zeros(toxicity.GAP, int)]
    found = net.responses(vectors, line)
    for i, width in enumerate(toxicity.WIDTHS):
        plain = sum(vectors[ahead[k : k + len(line)]] @ net.filters[width][k] for k in range(width))
        own = found[:, i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS]
        assert np.allclose(own[line > 0], plain[line > 0], atol=1e-4) and np.isneginf(own[line == 0]).all()
