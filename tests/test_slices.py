"""Slices that split: their number grows with the table, batches rewrite what they touch, reruns and restarts agree."""

import pytest
from pyspark.sql import functions as F

from jobloom.operators import lifecycle
from jobloom.streaming import slices, streams


def merged(state, batch, number, step):
    state.merge(batch, number, [F.col("k")], [F.col("k")], step)


def put(batch, old):
    return batch if old is None else old.join(batch, "k", "left_anti").unionByName(batch)


def rows(spark, first, last, more=0):
    return spark.range(first, last).selectExpr("id AS k", f"id + {more} AS x")


def content(state):
    return {r["k"]: r["x"] for r in state.read().collect()}


def test_slices_grow_in_number_and_keep_their_size(spark, tmp_path):
    state = slices.Slices(spark, str(tmp_path), 50)
    merged(state, rows(spark, 0, 100), 0, put)
    few = len(state.directory()["slices"])
    for n in range(1, 4):
        merged(state, rows(spark, 100 * n, 100 * n + 2000 * (n == 3) + 100), n, put)
    now = state.directory()["slices"]
    assert content(state) == {k: k for k in range(2400)} and len(now) > 10 * few
    assert max(s["rows"] for s in now) <= 60 and sum(s["rows"] for s in now) == 2400
    # the slices part the hashes: every residue of the longest number of bits belongs to one
    bits = max(s["bits"] for s in now)
    assert sorted(v for s in now for v in range(s["value"], 1 << bits, 1 << s["bits"])) == list(range(1 << bits))


def test_a_batch_rewrites_the_slices_it_touches_and_old_ones_go(spark, tmp_path):
    state = slices.Slices(spark, str(tmp_path), 20)
    merged(state, rows(spark, 0, 400), 0, put)
    before = {(s["bits"], s["value"]): s["folder"] for s in state.directory()["slices"]}
    for n in range(1, 6):
        merged(state, rows(spark, 7, 8, n), n, put)
    after = {(s["bits"], s["value"]): s["folder"] for s in state.directory()["slices"]}
    assert sum(before[k] != after.get(k) for k in before) == 1 and content(state) == {k: k + 5 * (k == 7) for k in range(400)}
    assert len(list((tmp_path / "directory").glob("*.json"))) == 2 and len(list((tmp_path / "data").iterdir())) <= 3


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    state = slices.Slices(spark, str(tmp_path), 20)
    add = lambda batch, old: (batch if old is None else old.unionByName(batch)).groupBy("k").agg(F.sum("x").alias("x"))
    merged(state, rows(spark, 0, 50), 0, add)
    for _ in range(3):
        merged(state, rows(spark, 0, 60), 1, add)
    assert content(state) == {k: 2 * k if k < 50 else k for k in range(60)}
    with pytest.raises(RuntimeError, match="lost"):
        merged(state, rows(spark, 0, 60), 2, lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    assert content(state) == {k: 2 * k if k < 50 else k for k in range(60)}
    merged(state, rows(spark, 0, 0), 3, add)
    assert content(state)[59] == 59


def test_an_ingest_stream_restarts_with_its_slices(spark, tmp_path):
    at = F.lit("2024-01-01").cast("timestamp")

    def step(batch, old):
        new = batch.groupBy("k").agg(F.max("x").alias("x"))
        return lifecycle.merge_raw(new.limit(0).withColumns({"first_seen_at": at, "last_seen_at": at}) if old is None else old, new, at, ["k"])

    for n in range(3):
        rows(spark, n * 30, n * 30 + 60, n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = streams.ingest_stream(streams.read_stream(spark, f"{tmp_path}/in", "k long, x long"), f"{tmp_path}/out", step, ["k"], ["k"], limit=25)
        assert {r["k"]: r["x"] for r in out.collect()} == {k: k + min(k // 30, n) for k in range(n * 30 + 60)}
    assert len(slices.Slices(spark, f"{tmp_path}/out/state").directory()["slices"]) >= 4
