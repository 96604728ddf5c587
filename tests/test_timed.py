"""Expiry by timers: a stream that stops and starts between batches, a snapshot before it, and its state from outside."""

import datetime as dt

from jobloom.streaming import streams, timed

SCHEMA = "k string, ts timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_restarts_timers_snapshots_and_state(spark, tmp_path):
    known = spark.createDataFrame([("z", day(-3)), ("a", day(-1))], "k string, last_seen timestamp")
    before = spark.conf.get(timed.STORE)

    def run(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = timed.unseen_keys(streams.read_stream(spark, f"{tmp_path}/in", SCHEMA), "k", "ts", 2, snapshot=known)
        with timed.rocksdb(spark):
            out = streams.run_to_table(stream, f"{tmp_path}/out")
        waiting = {r["k"]: r["last_seen"] for r in timed.state(spark, f"{tmp_path}/out/progress").collect()}
        return sorted((r["k"], r["last_seen"]) for r in out.collect()), waiting

    assert run(("a", day(0)), ("b", day(0))) == ([("z", day(-3))], {"a": day(0), "b": day(0)})
    ended, waiting = run(("a", day(1)), ("c", day(2)))
    assert (ended, waiting) == ([("b", day(0)), ("z", day(-3))], {"a": day(1), "c": day(2)})
    ended, waiting = run(("b", day(9)))
    assert ended == [("a", day(1)), ("b", day(0)), ("c", day(2)), ("z", day(-3))] and waiting == {"b": day(9)}
    assert spark.conf.get(timed.STORE) == before
