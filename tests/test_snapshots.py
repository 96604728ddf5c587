"""Committed states: runs start from the last one, readers see whole versions, a failed run changes nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobloom.operators import lifecycle, resolve
from jobloom.operators.snapshots import Snapshots
from jobloom.plans import pipeline

NOON = dt.datetime(2024, 5, 1, 12)
SCHEMA = "id long, source_id string, source_job_id string, title string, employer_name string, city string, province string, posted_at timestamp, closes_at timestamp"


def landed(spark, rows):
    df = spark.createDataFrame([(i, src, job, title, "Mill", "Hope", "British Columbia", NOON - dt.timedelta(days=age), None) for i, src, job, title, age in rows], SCHEMA)
    return df.withColumn("fingerprint", resolve.fingerprint(F.col("title"), F.col("employer_name"), F.col("city"), F.col("province")))


ROWS = [(1, "direct:a", "x1", "Baker", 1), (2, "direct:b", "y1", "Baker", 2), (3, "direct:a", "x2", "Miller", 3), (4, "direct:a", "x3", "Old Miller", 45)]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([("Mill", "e1", "Hope")], "name string, employer_id string, default_city string")


def run(state, spark, registry, rows, hours=0):
    return pipeline.run_pipeline(state, landed(spark, rows), registry, F.lit(NOON + dt.timedelta(hours=hours))).first().asDict()


def test_a_second_run_over_the_same_postings_writes_nothing(spark, registry, tmp_path):
    state = Snapshots(spark, str(tmp_path / "state"))
    one = run(state, spark, registry, ROWS)
    assert (one["fetched"], one["inserted"], one["skipped_old"], one["jobs"], one["written"], one["new_links"], one["opened"]) == (4, 3, 1, 2, 2, 3, 2)
    two = run(state, spark, registry, ROWS, 6)
    assert (two["fetched"], two["inserted"], two["unchanged"], two["skipped_old"], two["written"], two["kept"], two["new_links"]) == (4, 0, 3, 1, 0, 2, 0)
    assert state.versions() == [1, 2]
    seen = {r["last_seen_at"] for r in state.read("raw").collect()}
    stamps = {(r["created_at"], r["updated_at"]) for r in state.read("jobs").collect()}
    assert seen == {NOON + dt.timedelta(hours=6)} and stamps == {(NOON, NOON)}
    runs = {(r["source_id"], r["started_at"]): r["fetched"] for r in state.read("runs").collect()}
    assert runs[("notify", NOON)] == 2 and runs[("direct:a", NOON + dt.timedelta(hours=6))] == 3


def test_changed_new_and_vanished_postings(spark, registry, tmp_path):
    state = Snapshots(spark, str(tmp_path / "state"))
    run(state, spark, registry, [*ROWS, (6, "direct:c", "w1", "Clerk", 1)])
    changed = [(9, "direct:b", "y1", "Senior Baker", 2), ROWS[2], (5, "direct:c", "z1", "Miller", 0)]
    two = run(state, spark, registry, changed, 24)
    # the baker's two sightings part, the miller's become one job of two sources; its canonical sighting stays
    assert (two["inserted"], two["updated"], two["unchanged"]) == (1, 1, 1) and two["new_links"] == 2
    raw = {r["source_job_id"]: (r["id"], r["title"], r["first_seen_at"], r["last_seen_at"]) for r in state.read("raw").collect()}
    day = NOON + dt.timedelta(hours=24)
    assert raw == {"x1": (1, "Baker", NOON, NOON), "w1": (6, "Clerk", NOON, NOON), "y1": (2, "Senior Baker", NOON, day), "x2": (3, "Miller", NOON, day), "z1": (5, "Miller", day, day)}
    late = run(state, spark, registry, changed, 24 * 9)
    jobs = {r["title"]: (r["is_active"], r["cause"]) for r in state.read("jobs").collect()}
    # the clerk ends unseen and is purged; the baker keeps its link to the posting that has moved on and is still seen
    gone = [r["slug"] for r in state.read("tombstones").collect()]
    assert (late["unseen_expired"], late["jobs_purged"]) == (1, 1) and len(gone) == 1 and gone[0].startswith("clerk-")
    assert jobs == {"Baker": (True, None), "Senior Baker": (True, None), "Miller": (True, None)}


def test_a_run_that_dies_between_stages_changes_nothing_that_readers_see(spark, registry, tmp_path, monkeypatch):
    state = Snapshots(spark, str(tmp_path / "state"))
    run(state, spark, registry, ROWS)
    before = {name: sorted(map(str, state.read(name).collect())) for name in state.tables()}
    with monkeypatch.context() as patched:
        patched.setattr(lifecycle, "purge", lambda *_: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError, match="executor lost"):
            run(state, spark, registry, ROWS[:1], 48)
    assert state.versions() == [1] and {name: sorted(map(str, state.read(name).collect())) for name in state.tables()} == before
    assert run(state, spark, registry, ROWS, 6)["written"] == 0 and state.versions() == [1, 2]
    dropped = state.vacuum()
    assert dropped == 2 and state.versions() == [2] and state.read("jobs").count() == 2


def test_of_two_runs_from_one_version_only_one_commits(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "state"))
    assert state.tables() == {} and state.read("t") is None
    one, two = state.draft(), state.draft()
    one.put("t", spark.range(3))
    two.put("t", spark.range(5))
    assert one.commit() == 1
    with pytest.raises(RuntimeError, match="another run"):
        two.commit()
    assert state.read("t").count() == 3
    three = state.draft()
    three.put("empty", spark.createDataFrame([], "a int, b struct<c: string>"))
    assert three.commit() == 2 and state.read("t").count() == 3
    assert state.read("empty").schema.simpleString() == "struct<a:int,b:struct<c:string>>" and state.read("empty").count() == 0
    assert state.read("t", 1).count() == 3 and state.read("empty", 1) is None
