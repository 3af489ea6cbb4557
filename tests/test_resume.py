"""Runs that are cut off and started again: committed batches, samples spread over
files, and judge answers that are paid for once."""

import pytest
from pyspark.sql import functions as F

from vecdrift.operators import bank, labels, trajectory
from vecdrift.sources import judge_sink, runs
from vecdrift.streaming import incremental


@pytest.fixture(scope="module")
def world(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    points = [(f"s_{i}", layer, t, rng.normal(size=5).tolist(), 3) for i in range(7) for layer in range(2) for t in range(4)]
    weights = [(layer, k, rng.normal(size=5).tolist()) for layer in range(2) for k in range(6)]
    return points, bank.build_bank(spark.createDataFrame(weights, "layer int, pattern_id long, weights array<double>"))


SCHEMA = "sample_id string, layer int, position int, r array<double>, n_tokens_generated int"


def rows_of(df):
    return sorted((r.sample_id, r.layer, r.position, round(r.entropy, 9), None if r.js is None else round(r.js, 9)) for r in df.collect())


def test_samples_over_three_files_and_two_restarts(spark, world, tmp_path):
    points, b = world
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    # s_5 never gets its last point, s_6 has one outside the layers; n_tokens_generated comes late
    own = [p for p in points if p[:3] != ("s_5", 1, 3)] + [("s_6", 9, 0, [0.0] * 5, 3)]
    thirds = [[(*p[:4], p[4] if k == 2 else None) for i, p in enumerate(own) if i % 3 == k] for k in range(3)]
    thirds[1] += thirds[0][:9]  # points that come again
    counts = []
    for part in thirds:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        incremental.run_incremental(spark, src, SCHEMA, b, 5.0, out, check)
        counts.append(incremental.read_incremental(spark, out).count())
    assert counts == [0, 0, 5 * 8]
    whole = spark.createDataFrame([p for p in points if p[0] < "s_5"], SCHEMA).drop("n_tokens_generated")
    assert rows_of(incremental.read_incremental(spark, out)) == rows_of(trajectory.trajectories(whole, b, 5.0))
    incremental.run_incremental(spark, src, SCHEMA, b, 5.0, out, check)
    # points of a sample that is done change nothing
    spark.createDataFrame([p for p in points if p[0] == "s_1"], SCHEMA).write.mode("append").parquet(src)
    incremental.run_incremental(spark, src, SCHEMA, b, 5.0, out, check)
    assert incremental.read_incremental(spark, out).count() == 40
    assert [tuple(r) for r in incremental.read_failures(spark, out).collect()] == [("s_6", "a point outside the layers and positions")]


def test_a_sample_that_stays_incomplete_fails(spark, world, tmp_path):
    import time

    points, b = world
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.createDataFrame(points[:5], SCHEMA).write.parquet(src)
    incremental.run_incremental(spark, src, SCHEMA, b, 5.0, out, check, timeout_ms=1)
    time.sleep(0.1)
    spark.createDataFrame(points[8:16], SCHEMA).write.mode("append").parquet(src)
    incremental.run_incremental(spark, src, SCHEMA, b, 5.0, out, check, timeout_ms=1)
    assert [tuple(r) for r in incremental.read_failures(spark, out).collect()] == [("s_0", "incomplete: 5 of 8 points")]
    assert {r.sample_id for r in incremental.read_incremental(spark, out).collect()} == {"s_1"}


@pytest.mark.parametrize("fails", ["scores", "meta", "manifest"])
def test_a_crash_between_two_writes_leaves_no_duplicate(spark, tmp_path, fails, monkeypatch):
    path = f"file://{tmp_path}/run"
    rows = spark.range(5).withColumn("layer", F.lit(0))
    tables = {"trajectories": rows, "scores": rows.withColumn("s", F.lit(1.0)), "meta": rows.select("id")}
    runs.commit_batch(spark, path, "a", tables)
    writer = type(rows.write)
    for kind in ("parquet", "json"):
        plain = getattr(writer, kind)
        monkeypatch.setattr(writer, kind, lambda self, at, plain=plain, **k: (_ for _ in ()).throw(RuntimeError("killed")) if f"/{fails}" in at else plain(self, at, **k))
    with pytest.raises(RuntimeError, match="killed"):
        runs.commit_batch(spark, path, "b", tables)
    monkeypatch.undo()
    assert {t: runs.read_batches(spark, path, t).count() for t in tables} == dict.fromkeys(tables, 5)
    assert runs.commit_batch(spark, path, "b", tables) and not runs.commit_batch(spark, path, "b", tables)
    assert {t: runs.read_batches(spark, path, t).count() for t in tables} == dict.fromkeys(tables, 10)
    assert runs.commit_batch(spark, path, "b", {t: r.limit(2) for t, r in tables.items()}, replace=True)
    assert {t: runs.read_batches(spark, path, t).count() for t in tables} == dict.fromkeys(tables, 7)


def test_nothing_is_listed_at_first(spark, tmp_path):
    assert runs.read_batches(spark, f"file://{tmp_path}/none", "meta") is None


def _samples(spark, n):
    rows = [(f"s{i:02d}", f"q{i}", ["sky"], "x", i % 10 == 9) for i in range(n)] + [(None, "q", ["a"], "x", False), ("s00", "q0", ["sky"], "x", False)]
    return spark.createDataFrame(rows, "sample_id string, question string, gold_answers array<string>, generated_text string, failed boolean")


def _asked(log):
    return sorted(x.name.rsplit("-", 1)[0] for x in log.iterdir())


def _judge(log, stop=None, bad=()):
    """Notes each call in a file of its own; ends the whole process at `stop`."""

    def judge(prompt):
        import os
        import re
        import uuid

        q = re.search(r"\nq(\d+)\n", prompt).group(1)
        if stop is not None and int(q) == stop and not (log.parent / "once").exists():
            (log.parent / "once").touch()
            os._exit(1)
        (log / f"q{q}-{uuid.uuid4().hex}").touch()
        if int(q) in bad:
            raise RuntimeError("down")
        return "unsupported" if int(q) % 2 else "supported"

    return judge


def test_a_rerun_asks_for_the_rest_only(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}/labels"
    log.mkdir()
    samples = _samples(spark, 40)
    # the worker of the one task dies half-way, and nobody runs it again
    with pytest.raises(Exception, match="(?i)crash|exit|EOF|abort|fail"):
        judge_sink.label_durably(samples, _judge(log, stop=25), path, tasks=1, concurrency=2, chunk=4, base_delay=0.0)
    kept = {r.sample_id for r in judge_sink.read_answers(spark, path).collect()}
    before = _asked(log)
    assert 0 < len(kept) < 36 and len(before) - len(kept) <= 4
    judge_sink.label_durably(samples, _judge(log), path, tasks=3, chunk=4, base_delay=0.0)
    got = {r.sample_id: r.is_hallucination for r in judge_sink.read_answers(spark, path).collect()}
    assert got == {f"s{i:02d}": i % 2 for i in range(40) if i % 10 != 9}
    again = _asked(log)
    assert len(again) == len(before) + 36 - len(kept)
    judge_sink.label_durably(samples, _judge(log), path, tasks=3)
    assert _asked(log) == again


def test_errors_are_kept_and_asked_again(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}/labels"
    log.mkdir()
    samples = _samples(spark, 8)
    judge_sink.label_durably(samples, _judge(log, bad=(3, 5)), path, tasks=2, retries=2, base_delay=0.0)
    rows = {r.sample_id: r for r in judge_sink.read_answers(spark, path).collect()}
    assert {k for k, r in rows.items() if r.error} == {"s03", "s05"} and len(rows) == 8
    assert labels.label_counts(samples, judge_sink.read_answers(spark, path)).first().asDict() == {"labelled": 6, "skipped_failed": 1, "unparseable": 0, "errors": 2}
    judge_sink.label_durably(samples, _judge(log), path, tasks=2, limit=1, base_delay=0.0)
    judge_sink.label_durably(samples, _judge(log), path, tasks=2, base_delay=0.0)
    assert _asked(log).count("q0") == 1 and _asked(log).count("q3") == _asked(log).count("q5") == 3
    assert not [r for r in judge_sink.read_answers(spark, path).collect() if r.error]
    runs_done = spark.read.json(f"{path}/runs").agg(F.sum("answered"), F.sum("errors")).first()
    assert tuple(runs_done) == (8, 2)


def test_an_attempt_finds_what_an_earlier_one_was_told(tmp_path, monkeypatch):
    class Task:
        def __init__(self, n):
            self.n = n

        def partitionId(self):
            return 4

        def attemptNumber(self):
            return self.n

    log = []
    writer = judge_sink.AnswerWriter(lambda p: log.append(p) or "supported", f"file://{tmp_path}/x", "m", 3, None, 2, 1, 0.0)
    rows = [{"sample_id": str(i), "prompt": f"p{i}", "hash": "h"} for i in range(7)]
    monkeypatch.setattr(judge_sink.TaskContext, "get", staticmethod(lambda: Task(0)))
    writer.write(iter(rows[:4]))
    monkeypatch.setattr(judge_sink.TaskContext, "get", staticmethod(lambda: Task(1)))
    assert writer.write(iter(rows)) == judge_sink.Asked(3, 0, 4) and sorted(log) == [f"p{i}" for i in range(7)]


def test_pace_keeps_to_the_rate():
    now, slept = [0.0], []
    pace = judge_sink.Pace(4.0, lambda: now[0], lambda s: slept.append(s) or now.__setitem__(0, now[0] + s))
    for _ in range(9):
        pace.wait()
    assert now[0] == pytest.approx(2.0)
    judge_sink.Pace(None).wait()
