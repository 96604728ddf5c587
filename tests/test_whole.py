"""Queries and operators do the whole job: no prefix, no cap, no group that must fit one value."""

import unicodedata
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobloom import plans
from jobloom.functions import text
from jobloom.operators import alerts, lifecycle, ordered, resolve, serve
from jobloom.plans import extracting

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")


def by_hand(v):
    return None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not "̀" <= c <= "ͯ")


def test_letters_of_any_script_lose_their_accents(spark):
    given = ["Việt Nam ế", "й Йод", "άλφα", "é é", "Ångström Å", "plain", "", None, "한글", "がぎ", "שְׁ́", "áְׁ", "\U0001d15e \U0001109a"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v string").orderBy("i")
    out = df.select(text.deaccent_exact(F.col("v")).alias("x"), text.deaccent(F.col("v")).alias("n"), text.normalize_title(F.col("v")).alias("t")).collect()
    assert [r["x"] for r in out] == [by_hand(v) for v in given]
    assert [r["n"] for r in out][:8] == [by_hand(v) for v in given][:8]
    assert out[0]["t"] == "viet nam e"


def test_each_character_decomposes_as_unicodedata_says(spark):
    chars = [chr(n) for n in range(1, 0x30000) if not 0xD800 <= n <= 0xDFFF]
    given = [c + "x" for c in chars] + ["".join(chars[i : i + 97]) for i in range(0, len(chars), 97)]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    wrong = [r["v"] for r in df.select("v", text.deaccent_exact(F.col("v")).alias("x")).collect() if r["x"] != by_hand(r["v"])]
    assert not wrong


@tables
def test_deaccent_takes_whole_texts_of_all_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = plans.queries()["STR-1"](spark, SF).collect()
    assert sorted(map(tuple, out)) == sorted((r["doc_id"], by_hand(r["text"])) for r in rows)


@pytest.mark.parametrize("order", [serve.newest_order, serve.salary_order])
def test_places_number_all_rows_of_many_partitions(spark, order):
    rows = [(i, i % 7 * 1000 % 3, i % 5, i % 11, None if i % 4 == 0 else float(i % 13)) for i in range(3000)]
    feed = spark.createDataFrame(rows, "id long, posted_day int, employer_day_rank int, posted_at int, salary_min double").repartition(9, "id")
    key = {serve.newest_order: lambda r: (-r[1], r[2], -r[3], r[0]), serve.salary_order: lambda r: (r[4] is None, -(r[4] or 0), r[0])}[order]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r["id"]: r["place"] for r in serve.placed(feed, order()).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == {r[0]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    assert serve.placed(feed.limit(0), order()).count() == 0


@tables
def test_orders_and_ages_keep_every_row(spark):
    q = plans.queries()
    active = q["SRC-1"](spark, SF).count()
    assert [q[n](spark, SF).count() for n in ("SRT-1", "SRT-2")] == [active, active]
    assert q["DT-1"](spark, SF).filter("posted IS NOT NULL").count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_links_are_rows_not_sets(spark):
    raw = spark.range(400).selectExpr("id", "'a:' || (id % 2) AS source_id", "'f' AS fingerprint")
    pairs = raw.selectExpr("'j' AS job_key", "id AS raw_id")
    out = resolve.new_links(pairs.union(pairs), pairs.filter("raw_id < 100"))
    assert sorted(r["raw_id"] for r in out.collect()) == list(range(100, 400))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "collect_" not in plan(out)
    assert "collect_" not in plan(plans.queries()["JN-3"](spark, SF)) if Path(SF).is_dir() else True


def test_signups_fold_over_many_batches_and_from_states(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).selectExpr("id AS request_id", "CASE WHEN id % 3 > 0 THEN 'a' ELSE 'b' || id % 4 END AS email", "CAST(NULL AS string) AS city", "CAST(NULL AS string) AS category", "timestamp_seconds(id * 97) AS ts", "'t' || id AS token")
        rows = [r.asDict() for r in df.collect()]
        want, states = {}, {}
        for r in sorted(rows, key=lambda r: (r["ts"], r["request_id"])):
            states[r["email"]], (want[r["request_id"]],) = alerts.request_steps(states.get(r["email"]), [pd.Timestamp(r["ts"])], [r["token"]])
        assert {r["request_id"]: r["outcome"] for r in alerts.apply_signups(df).collect()} == want
        first = alerts.fold_requests(df.filter("request_id < 150"))
        second = alerts.fold_requests(df.filter("request_id >= 150"), first)
        assert {r["request_id"]: r["outcome"] for r in first.union(second).filter("NOT is_state").collect()} == want
        assert {r["email"]: r["token"] for r in second.filter("is_state").collect()} == {e: s[0] for e, s in states.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sitemap_files_grow_in_number_not_in_size(spark):
    rows = spark.range(1, 1_500_001).selectExpr("id AS p_partkey", "CAST(id AS string) AS id")
    sizes = [r["n"] for r in extracting.sitemap_files(rows).select((F.size(F.split("content", "</url>")) - 1).alias("n")).collect()]
    assert max(sizes) <= 50_000 and sum(sizes) == 1_500_000 and len(sizes) == 31


@pytest.fixture
def subscriptions(spark):
    jobs = spark.range(500).selectExpr("id", "true AS is_active", "CASE WHEN id % 3 > 0 THEN 'c' || id % 2 END AS city", "CASE WHEN id % 4 > 0 THEN 'k' || id % 3 END AS category", "CASE WHEN id != 77 THEN timestamp_seconds(id div 2 * 200) END AS posted_at").repartition(5)
    rows = [(i, c, k, t) for i, (c, k, t) in enumerate((c, k, t) for c in (None, "c0", "c1", "c9") for k in (None, "k0", "k2") for t in (0, 20_000, 49_800))]
    made = spark.createDataFrame(rows, "alert_id long, city string, category string, t long").selectExpr("alert_id", "city", "category", "alert_id != 5 AS is_active", "timestamp_seconds(t) AS confirmed_at", "CAST(NULL AS timestamp) AS last_sent_at")
    have = [(r["id"], r["city"], r["category"], r["posted_at"].timestamp()) for r in jobs.collect() if r["posted_at"]]
    start = made.first()["confirmed_at"].timestamp()
    hits = [(a, -at, j) for a, c, k, t in rows if a != 5 for j, jc, jk, at in have if (c is None or c == jc) and (k is None or k == jk) and at - start > t]
    want = {}
    for a, _, j in sorted(hits):
        want.setdefault(a, []).append(j)
    return made, jobs, want


def test_places_give_every_match_in_its_order(spark, subscriptions):
    made, jobs, want = subscriptions
    assert sorted((r["alert_id"], r["job_id"]) for r in alerts.match_alerts(made, jobs).collect()) == sorted((a, j) for a, js in want.items() for j in js)
    heads, lists = alerts.places(made, jobs)
    assert {r["alert_id"]: (r["n"], r["subject"]) for r in alerts.digest_heads(heads).collect()} == {a: (len(js), f"{len(js)} new job{'s' * (len(js) != 1)}") for a, js in want.items()}
    for size in (1, 7, 1024):
        rows = {(r["alert_id"], r["rank"]): r["job_id"] for r in alerts.blocks(heads, lists, size).select("alert_id", F.inline("jobs").alias("rank", "job_id", "at")).collect()}
        assert rows == {(a, n): j for a, js in want.items() for n, j in enumerate(js, 1)}
    assert {r["alert_id"]: (r["n"], r["jobs"]) for r in alerts.digests(made, jobs).collect()} == {a: (len(js), js) for a, js in want.items()}
    assert {r["alert_id"]: (r["n"], r["jobs"]) for r in alerts.digests(made, jobs, 3).collect()} == {a: (len(js), js[:3]) for a, js in want.items()}


def test_rows_of_places_grow_with_alerts_and_jobs_not_with_pairs(spark):
    def rows(n):
        jobs = spark.range(n).selectExpr("id", "true AS is_active", "CAST(NULL AS string) AS city", "CAST(NULL AS string) AS category", "timestamp_seconds(id + 10) AS posted_at")
        made = spark.range(n).selectExpr("id AS alert_id", "CAST(NULL AS string) AS city", "CAST(NULL AS string) AS category", "true AS is_active", "timestamp_seconds(0) AS confirmed_at", "CAST(NULL AS timestamp) AS last_sent_at")
        heads, lists = alerts.places(made, jobs)
        assert heads.agg(F.sum("n")).first()[0] == n * n
        return heads.count() + lists.count()

    assert [rows(n) for n in (500, 2000)] == [1000, 4000]


def test_running_sums_and_quantiles_of_one_large_group(spark):
    rows = spark.range(40_000).selectExpr("CASE WHEN id % 3 > 0 THEN 'big' WHEN id % 2 = 0 THEN 'g' || id % 4 END AS g", "CASE WHEN id % 10 != 7 THEN double((id * 7919) % 30011) END AS x").repartition(7)
    summed = ordered.running(rows.withColumn("id", F.monotonically_increasing_id()), [F.asc_nulls_first("x"), F.asc("id")], F.lit(2)).collect()
    assert sorted(r["upto"] for r in summed) == list(range(2, 80_002, 2))
    by = {}
    for r in rows.collect():
        if r["x"] is not None:
            by.setdefault(r["g"], []).append(r["x"])
    got = {r["g"]: (r["n"], r["a"], r["b"], r["c"]) for r in ordered.quantiles(rows, ["g"], "x", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in by.items()}
    assert all(np.allclose(got[k][1:], np.quantile(v, [0, 0.37, 1])) for k, v in by.items())
    plan = ordered.quantiles(rows, ["g"], "x", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan
    assert ordered.quantiles(rows.limit(0), ["g"], "x", {"m": 0.5}).collect() == []


def test_work_between_jobs_needs_a_shared_folder_off_one_machine(spark, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(context, "master", "spark://host:7077")
    folder = spark.conf.get("spark.checkpoint.dir")
    with monkeypatch.context() as unset:
        unset.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
        unset.setattr(context, "getCheckpointDir", lambda: None)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ordered.shared_folder(spark, "x")
    assert ordered.shared_folder(spark, "x").startswith(folder)


def test_a_stream_that_starts_again_without_new_files_keeps_its_snapshot(spark, tmp_path):
    from jobloom.operators import lifecycle
    from jobloom.streaming import streams

    source, at = f"{tmp_path}/in", F.lit("2026-01-01").cast("timestamp")

    def step(batch, old):
        new = batch.groupBy("k").agg(F.max("x").alias("x"))
        before = old if old is not None else new.limit(0).withColumns({"first_seen_at": at, "last_seen_at": at})
        return lifecycle.merge_raw(before, new, at, ["k"])

    def run():
        return {r["k"]: r["x"] for r in streams.ingest_stream(streams.read_stream(spark, source, "k long, x long"), f"{tmp_path}/out", step, ["k"], ["k"], limit=10).collect()}

    spark.range(40).selectExpr("id AS k", "id AS x").coalesce(1).write.parquet(source)
    assert run() == run() == {i: i for i in range(40)}
    spark.range(35, 45).selectExpr("id AS k", "id * 2 AS x").coalesce(1).write.mode("append").parquet(source)
    assert run() == {i: i * 2 if i >= 35 else i for i in range(45)}


def test_signups_over_many_files_are_folded_as_in_one_batch(spark, tmp_path):
    from jobloom.streaming import streams

    df = spark.range(120).selectExpr("id AS request_id", "'e' || id % 5 AS email", "CASE WHEN id % 2 > 0 THEN 'c' END AS city", "CAST(NULL AS string) AS category", "timestamp_seconds(id * 40) AS ts", "'t' || id AS token")
    want = {r["request_id"]: r["outcome"] for r in alerts.apply_signups(df).collect()}
    for first in range(0, 120, 40):
        df.filter(f"request_id >= {first} AND request_id < {first + 40}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = streams.signup_stream(streams.read_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", limit=3).collect()
        assert {r["request_id"]: r["outcome"] for r in got} == {k: v for k, v in want.items() if k < first + 40}
    assert {"send", "throttled"} <= set(want.values())


def test_lists_that_alerts_share_are_made_once(spark, monkeypatch):
    """FINDINGS round 3, F1, F4, F11: what is packed and joined grows with different lists, not with alerts."""
    from datetime import datetime

    from jobloom.operators import alerts

    day = datetime(2001, 7, 1)
    made = spark.createDataFrame([(i, None, None, True, day, None) for i in range(500)] + [(900, "A", None, True, day, None)], "alert_id long, city string, category string, is_active boolean, confirmed_at timestamp, last_sent_at timestamp")
    posts = spark.createDataFrame([(i, "AB"[i % 2], "k", datetime(2001, 7 if i < 40 else 6, 2), True) for i in range(100)], "id long, city string, category string, posted_at timestamp, is_active boolean")
    monkeypatch.setattr(alerts, "SHARERS", 100)
    assert sorted(r["id"] for r in alerts.newer(made, posts).collect()) == list(range(40))
    heads, asked = alerts.shared(alerts.places(made, alerts.newer(made, posts))[0])
    assert sorted(tuple(r) for r in asked.collect() if r["city"]) == [("A", None, 20, 1)] and asked.count() == 2
    assert heads.count() == 501 and heads.select("list").distinct().count() == 6
    got = {r["alert_id"]: (r["n"], r["jobs"]) for r in alerts.digests(made, posts).collect()}
    assert got == {i: (40, list(range(40))) for i in range(500)} | {900: (20, list(range(0, 40, 2)))}
    assert alerts.match_alerts(made, posts).count() == 500 * 40 + 20


@pytest.mark.parametrize("group", [1, 7, 1024])
def test_groups_of_alerts_take_every_match_in_its_place(spark, subscriptions, monkeypatch, group):
    """FINDINGS round 4, F1, F2: alerts of one group stop at different places of a list, also inside a block."""
    made, jobs, want = subscriptions
    monkeypatch.setattr(alerts, "GROUP", group)
    monkeypatch.setattr(alerts, "PAIRS", 1000)
    got = sorted((r["alert_id"], r["rank"], r["job_id"]) for r in alerts.digest_rows(made, jobs).collect())
    assert got == sorted((a, n, j) for a, js in want.items() for n, j in enumerate(js, 1))


@pytest.mark.parametrize("columns", [["alert_id", "rank", "job_id"], ["alert_id", "job_id"]])
def test_pairs_are_written_in_a_fraction_of_a_byte(spark, tmp_path, columns):
    """FINDINGS round 4, F1 (DIG-2-rows) and F2 (JN-7): a job's rows come out together, so its columns are runs."""
    jobs = spark.range(25_000).selectExpr("id * 7919 % 25013 AS id", "true AS is_active", "CAST(NULL AS string) AS city", "CAST(NULL AS string) AS category", "timestamp_seconds(id + 100) AS posted_at")
    made = spark.range(100).selectExpr("id AS alert_id", "CAST(NULL AS string) AS city", "CAST(NULL AS string) AS category", "true AS is_active", "timestamp_seconds(id) AS confirmed_at", "CAST(NULL AS timestamp) AS last_sent_at")
    alerts.digest_rows(made, jobs).select(columns).write.parquet(f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2_500_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2_500_000


def test_deaccenting_holds_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    held = []
    monkeypatch.setattr(text, "HELD", 100)
    monkeypatch.setattr(text, "decomposed", lambda v: held.append(v) or by_hand(v))
    given = ["é" * 30, None, "", "ế" * 200, "ü"] * 20
    assert text._decomposed(pa.array(given)).to_pylist() == [by_hand(v) for v in given]
    assert text._decomposed(pa.array([], pa.string())).to_pylist() == [] and len(held) == 80


def test_no_table_that_grows_is_broadcast_between_stages(spark):
    day = "timestamp'2001-08-01'"
    raw = spark.range(300).selectExpr("id", "concat('s', id % 3) AS source_id", "cast(id AS string) AS source_job_id", "concat('Nurse ', id div 3) AS title", "'E' AS employer_name", "'Toronto' AS city", "'ON' AS province", f"{day} AS posted_at", f"{day} AS closes_at", "cast(id div 3 AS string) AS fingerprint", f"{day} AS last_seen_at", "'h' AS content_hash")
    registry = spark.createDataFrame([("E", "e", "Ottawa")], "name string, employer_id string, default_city string")
    links = raw.selectExpr("concat('f', id div 3) AS job_id", "id AS raw_id")
    jobs = links.select("job_id").distinct().selectExpr("job_id", "job_id AS slug", "true AS is_active", f"{day} AS posted_at", f"{day} AS expires_at")
    seen, now, key = raw.withColumnRenamed("id", "raw_id"), F.lit("2001-08-02").cast("timestamp"), ["source_id", "source_job_id"]
    found = resolve.resolve(raw, registry, resolve.build_job_rows(raw, registry), links.withColumnRenamed("job_id", "job_key"))
    end = lifecycle.purge(jobs, links, seen, jobs.select("slug").limit(9), now)
    tables = [found["jobs"], found["links"], resolve.classify_change(raw, raw, key), lifecycle.drop_too_old(raw, raw, now, key), *lifecycle.split_known(raw, raw, key)]
    tables += [lifecycle.expire(jobs, links, seen, now)[0], lifecycle.unseen_jobs(jobs, links, seen, now), *[end[k] for k in ("jobs", "links", "raw", "tombstones")]]
    for table in tables:
        table.collect()
        joins = [line for line in table._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert all("employer_name" in line for line in joins), joins  # the registry is small
    assert found["jobs"].count() == 100 and lifecycle.expire(jobs, links, seen, now)[0].count() == 100
