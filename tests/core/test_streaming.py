"""Streams against the same over all that has arrived: progressive metrics, and the ends of jobs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievekit.streaming import progress

RESULTS = "id string, model string, value double"


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/_{name}")
    (part,) = (folder / f"_{name}").glob("*.parquet")
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"{name}.parquet")


def means(rows):
    """n and mean by model, each id once (rows with one id are alike)."""
    by = {}
    for _, m, v in {r[0]: r for r in rows}.values():
        by.setdefault(m, []).append(v)
    return {m: (len(v), pytest.approx(sum(v) / len(v))) for m, v in by.items()}


def test_progress_after_each_batch_and_over_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{k}", rng.choice(["a", "b", None]), rng.random()) for k in range(60)]
    parts = [rows[:20], rows[15:35], rows[30:45]]  # with repetitions
    for k, part in enumerate(parts):
        put(spark, tmp_path, f"f{k}", part, RESULTS)
    out, seen = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    assert progress.current(spark, out) is None

    def run():
        stream = progress.stream(spark, f"{tmp_path}/in", spark.createDataFrame([], RESULTS).schema, 1)
        progress.progressive_to_end(stream, "id", out, seen, "model")

    run()
    for k in range(3):
        got = {r.model: (r.n, r.avg_value) for r in progress.versions(spark, out).where(F.col("version") == k).collect()}
        assert got == means([r for part in parts[: k + 1] for r in part])
    run()  # nothing new: nothing changes
    put(spark, tmp_path, "f3", rows[:5] + rows[40:], RESULTS)
    run()
    assert {r.model: (r.n, r.avg_value) for r in progress.current(spark, out).collect()} == means(rows)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    sink, path = progress.merging_sink(f"{tmp_path}/t", "k"), f"{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k string, n long")
    sink(frame([("a", 1), (None, 2)]), 0)
    for _ in range(2):
        sink(frame([(None, 3), ("b", 4)]), 1)
        assert sorted(map(tuple, progress.current(spark, path).collect()), key=repr) == [("a", 1), ("b", 4), (None, 3)]


def test_outcomes_of_jobs(spark, tmp_path):
    """A stream of several files, out of order within the delay, gives what the table as a whole gives."""
    rng = random.Random(2)
    begin = datetime(2024, 1, 1)
    events = []
    for j in range(40):
        at = begin + timedelta(minutes=rng.randrange(600))
        for _ in range(rng.randint(1, 6)):
            events.append((f"j{j}", at, rng.choice(["running", "running", "running", "completed", "failed"])))
            at += timedelta(minutes=rng.randrange(1, 90))
    events.append(("late", begin + timedelta(days=2), "running"))
    order = sorted(events, key=lambda e: e[1] + timedelta(minutes=rng.randrange(8)))
    size = len(order) // 5 + 1
    for k in range(5):
        put(spark, tmp_path, f"e{k}", order[k * size : (k + 1) * size], "job string, ts timestamp, status string")
    table = spark.read.parquet(f"{tmp_path}/in")
    stream = progress.stream(spark, f"{tmp_path}/in", table.schema, 1)
    progress.run_to_end(progress.outcomes(stream, "2 hours", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, progress.outcomes_so_far(table, "2 hours", "10 minutes").collect()))
    want = {}
    for j, t, s in sorted(events):
        want.setdefault(j, []).append((t, s))
    for job, outcome, at, n in got:
        deadline = want[job][0][0] + timedelta(hours=2)
        ends = [(t, s) for t, s in want[job] if s != "running" and t <= deadline]
        assert (at, outcome) == (min(ends) if ends else (deadline, "timed_out")) and n == sum(t <= at for t, _ in want[job])
    assert {o for _, o, _, _ in got} == {"completed", "failed", "timed_out"} and len(got) == 40
