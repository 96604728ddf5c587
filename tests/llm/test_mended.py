"""Labelled pages against the prior of names, pictures of high expansion, letters of Latin, memory of language tasks, vectors without a value."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.llm import common, embed_join, htmltext, langid, media, ngram_join

NAMES = "recommendations responses search related notice alerts social-history search-results menu-plan".split()


def page(name, inside, words=90):
    section = f'<section class="{name}">' + " ".join(f"s{k}" for k in range(words)) + "</section>"
    article = "<article><h1>Title</h1><p>" + " ".join(f"w{k}" for k in range(40)) + "</p>" + (section if inside else "") + "</article>"
    return f"<html><body><nav>menu</nav>{article}{'' if inside else section}<footer>foot</footer></body></html>"


def fitted(spark, pages):
    return htmltext.fit(spark.createDataFrame([(p,) for p in pages], "html string"))


@pytest.mark.parametrize(("inside", "kept"), [(True, 131), (False, 41)])
def test_labelled_pages_say_what_a_name_holds(spark, inside, kept):
    model = fitted(spark, [page(name, inside) for name in NAMES for _ in range(6)])
    assert {name: len(htmltext.main_text(page(name, inside), model).split()) for name in NAMES} == dict.fromkeys(NAMES, kept)


def test_short_notices_and_remarks_stay_out(spark):
    short = [page(name, True, 6) for name in NAMES for _ in range(6)]
    model = fitted(spark, short)
    assert {len(htmltext.main_text(p, model).split()) for p in short} == {41}
    remarks = page("comments", True)
    assert len(htmltext.main_text(remarks, fitted(spark, [remarks] * 20)).split()) == 41


def test_forms_around_a_page_and_headings_alone():
    plain = htmltext.Model()
    body = "<div class=content><h2>Head</h2><p>" + "word " * 400 + "</p></div>"
    assert len(htmltext.main_text(f"<body><form>{body}</form></body>", plain).split()) == 401
    assert len(htmltext.main_text(f"<body>{body}<form><label>Mail</label> sign up now</form></body>", plain).split()) == 401
    found = "<body><h1>Four words are here</h1><div class='search-results'><p>" + "word " * 60 + "</p></div></body>"
    assert len(htmltext.main_text(found, plain).split()) == 64


def test_latin_letters_have_codes_of_their_own():
    codes = langid.letter_codes()
    latin = [c for c in range(0x250) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    assert len(set(codes[latin].tolist())) == len(latin) > 200 and 0 not in codes[latin] and codes[ord("а")] and not codes[ord("1")]


def test_pictures_of_high_expansion_are_inflated_a_few_at_a_time():
    text = b"a " * 10_000
    made = media.write_pngs([media.padded(text)])[0]
    assert len(made) * 40 < len(text)
    portions = list(media._portions([made] * 1500 + [None, b"short"], 4 << 20))
    sizes = [sum(20_160 for m in p if m == made) for p in portions]
    assert sum(map(len, portions)) == 1502 and max(sizes) <= 4 << 20 and len(portions) > 5
    assert len(list(media._portions([made] * 1500))) == 3
    tracemalloc.start()
    for some in media._portions([made] * 1500, 4 << 20):
        for samples in media.unfiltered([media._lines(m) for m in some]):
            media._read(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * (4 << 20)  # of 30 MB in all


class Task:
    """Stands for a frame and keeps what it is given to run in tasks."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def select(self, *columns):
        return self

    def __getitem__(self, name):
        return F.col(name)

    groupBy = agg = select


def peak_of(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_a_language_model_holds_the_grams_it_has_met():
    langid.grams("a")
    model = ["a", "b"], np.random.default_rng(0).normal(size=(2, langid.DIMENSIONS))
    assert peak_of(lambda: langid.Model(*model).cosines("some text of a few words " * 400)) < 16 << 20  # a table of all grams has 64 MB


def test_a_language_task_takes_texts_a_few_at_a_time_and_gives_memory_back(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"__text": ["word " * 4000] * 1500, "__lang": ["en"] * 1500})
    monkeypatch.setattr(langid, "HELD", 100_000)
    given = []
    monkeypatch.setattr(langid, "give_back", lambda: given.append(1), raising=False)
    langid.gram_counts(task := Task(), "text", "lang")
    rows = []
    assert peak_of(lambda: rows.extend(b.to_pydict() for b in task.run([batch]))) < 20 << 20  # of 30 MB of texts
    assert given == [1] and sum(sum(r["n"]) for r in rows) == 1500 * 19_999


def test_a_language_task_lets_go_of_its_model_before_it_gives_memory_back(spark, monkeypatch):
    held = []
    monkeypatch.setattr(common, "give_back", lambda: held.append(len(langid._MODELS)))
    monkeypatch.setattr(langid, "ddl", lambda own: "")
    langid.predict(task := Task(), (["a", "b"], np.eye(2, langid.DIMENSIONS)), keep=())
    texts = pa.RecordBatch.from_pydict({"__text": ["one text", None]})
    assert [b.num_rows for b in task.run([texts])] == [2] and held == [0]


def test_the_language_stage_sends_each_text_once(spark, monkeypatch):
    import corpus_pipeline

    sent, predict = [], langid.predict
    monkeypatch.setattr(langid, "predict", lambda df, *a, **b: sent.append(df.schema.simpleString()) or predict(df, *a, **b))
    docs = spark.createDataFrame([(1, "one text", "en", "a"), (2, "no lang", None, "b"), (3, "12", "en", "b"), (4, None, "en", "b")], "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.language(spark, docs, "")
    assert sorted(map(tuple, out.collect())) == [(1, "one text", "en", "a"), (2, "no lang", "en", "b")] and out.columns == docs.columns
    assert sent[0].count("text:") == 1


def test_near_duplicates_run_one_python_function_a_task(spark, monkeypatch):
    given, components = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: given.append(edges) or components(edges))
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(words[:39])), (4, "else " * 9), (6, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got == {5: 3, 3: 3, 4: 4, 6: 6}
    assert "InArrow" not in given[0]._jdf.queryExecution().executedPlan().toString()  # links are found before, not in the same tasks


def test_vectors_without_a_value_meet_nothing(spark):
    rows = [(i, None if i % 3 else [1.0, float(i)]) for i in range(30)] + [(40, [0.0, 0.0]), (41, [float("nan"), 1.0]), (42, None), (0, [1.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.isfinite(v).all() and np.any(v)}
    links = {i: sum(j != i and a @ b >= 0.9 for j, b in x.items()) for i, a in x.items()}
    assert [(i, n) for i, n, _ in got] == sorted((i, links.get(i, 0)) for i, _ in rows) and all(c == i for i, _, c in got if i not in x)
