"""Ordered replay, and streams whose state ends."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tintwell.operators import history as J
from tintwell.streaming import logs as ST
from tintwell.streaming.run import drain

START = datetime(2024, 1, 1)


def plain_replay(rows, limit):
    """Whole stacks as lists, one row at a time."""
    states = {}
    for project, _, action, new in sorted(rows, key=lambda r: r[1]):
        value, undo, redo = states.get(project, (None, [], []))
        if action == "set" and new != value:
            undo, redo, value = [*undo, value], [], new
        elif action == "quiet":
            value = new
        elif action == "undo" and undo:
            undo, redo, value = undo[:-1], [*redo, value], undo[-1]
        elif action == "redo" and redo:
            undo, redo, value = [*undo, value], redo[:-1], redo[-1]
        states[project] = (value, undo[-limit:] if limit else undo, redo)
    return sorted(((p, v, len(u), len(r)) for p, (v, u, r) in states.items()), key=str)


def log_rows(n, projects, seed=9):
    rng = random.Random(seed)
    return [(rng.choice(projects), i, rng.choice(["set", "set", "set", "undo", "undo", "redo", "quiet", "other"]), None if rng.random() < 0.05 else float(rng.randrange(6))) for i in range(n)]


LOG = "project long, seq long, action string, value double"


@pytest.mark.parametrize("limit", [None, 1, 5, 200])
def test_replay_of_a_log_with_one_project_of_nine_tenths(spark, limit):
    rows = log_rows(6000, [1] * 90 + [2, 3, 4, 5, None] * 2)
    shuffled = random.Random(1).sample(rows, len(rows))
    got = J.replay(spark.createDataFrame(shuffled, LOG).repartition(7), limit).collect()
    assert sorted(map(tuple, got), key=str) == plain_replay(rows, limit)


def test_replay_is_one_stage_after_one_shuffle(spark):
    plan = J.replay(spark.createDataFrame(log_rows(10, [1, 2]), LOG))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan
    assert J.replay(spark.createDataFrame([], LOG)).collect() == []


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of one file per micro-batch, in the order of the lists."""

    def make(name, schema, batches):
        folder = str(tmp_path / name)
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def at(hours):
    return START + timedelta(hours=hours)


def test_streamed_replay_folds_batch_after_batch(spark, arriving):
    rows = log_rows(900, [1, 1, 1, 2, 3], 4)
    stamped = [(p, i, at(i / 60), a, v) for p, i, a, v in rows]
    stream = arriving("log", "project long, seq long, ts timestamp, action string, value double", [stamped[a : a + 300] for a in (0, 300, 600)])
    out = drain(ST.replay(stream, 7, "1 hour", "30 days"), "update")
    last = out.groupBy("project").agg(F.max_by(F.struct("value", "undo", "redo"), "seq").alias("s")).select("project", "s.*")
    assert sorted(map(tuple, last.collect()), key=str) == plain_replay(rows, 7)
    assert out.select("batch").distinct().count() == 3


def test_the_state_of_an_idle_key_goes(spark, arriving):
    schema = "project long, seq long, ts timestamp, action string, value double"
    sets = lambda p, seqs, hour: [(p, s, at(hour), "set", float(s)) for s in seqs]
    # Project 2 moves the watermark on; project 1 comes back long after its idle time, project 3 before it.
    batches = [sets(1, [1, 2, 3], 0) + sets(3, [4, 5], 0), sets(2, [6], 20), sets(3, [7], 20), sets(2, [8], 40), sets(2, [9], 41), [(1, 10, at(42), "undo", None), (3, 11, at(42), "undo", None)]]
    out = drain(ST.replay(arriving("idle", schema, batches), 9, "1 hour", "24 hours"), "update")
    got = {r.seq: (r.value, r.undo, r.redo) for r in out.collect()}
    assert got[10] == (None, 0, 0)
    assert got[11] == (5.0, 2, 1)


def test_costs_start_anew_after_idle_time_and_rows_behind_the_watermark_are_dropped(spark, arriving):
    schema = "k string, seq long, ts timestamp, value double"
    batches = [[("a", 1, at(0), 10.0), ("a", 2, at(0), 0.0)], [("b", 3, at(50), 1.0)], [("b", 4, at(51), 1.0)], [("a", 5, at(60), 1.0), ("b", 6, at(2), 99.0)]]
    out = drain(ST.fast_rise_cost(arriving("cost", schema, batches), "k", late="1 hour", idle="10 hours"))
    got = {r.seq: r.cost for r in out.collect()}
    assert got == {1: 10.0, 2: 8.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_newest_request_across_batches(spark, arriving):
    schema = "client string, seq long, ts timestamp, kind string, request_id long"
    batches = [
        [("c", 1, at(0), "request", 1), ("c", 2, at(1), "response", 1), ("d", 3, at(1), "response", 1)],
        [("c", 4, at(2), "request", 4), ("c", 5, at(3), "response", 1)],
        [("c", 6, at(4), "response", 4), ("d", 7, at(60), "request", 7)],
        [("d", 8, at(61), "response", 7)],
        [("c", 9, at(62), "response", 4)],
    ]
    got = {r.seq: r.accepted for r in drain(ST.accept_latest(arriving("m", schema, batches), idle="20 hours")).collect()}
    assert got == {2: True, 3: False, 5: False, 6: True, 8: True, 9: False}


def test_responses_are_held_until_no_newer_request_can_come(spark, arriving):
    requests = [[("c", 1, at(0)), ("c", 2, at(5)), ("d", 3, at(5))], [("c", 4, at(30)), ("c", 5, at(30.1))], [("x", 9, at(60))]]
    answers = [[("c", 10, 1, at(6)), ("c", 11, 2, at(6)), ("d", 12, 3, at(5.5))], [("c", 13, 2, at(31)), ("c", 14, 5, at(31)), ("e", 15, 1, at(31))], [("x", 16, 9, at(61))]]
    asked = arriving("asked", "client string, request_id long, ts timestamp", requests)
    answered = arriving("answered", "client string, seq long, request_id long, ts timestamp", answers)
    rows = drain(ST.accept_in_time(asked, answered, "10 hours", "1 hour")).collect()
    assert len(rows) == len({r.seq for r in rows})
    # 16 waits for the watermark.
    assert {r.seq: r.accepted for r in rows} == {10: False, 11: True, 12: True, 13: False, 14: True, 15: True}
