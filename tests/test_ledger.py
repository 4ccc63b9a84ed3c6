"""The commit log and the metrics ledger: windows once, late rows recorded, killed batches run again."""

import glob
import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as met
from tidemark.sources import commits
from tidemark.sources.commits import CommitLog
from tidemark.sources.sinks import write_deployment_events, write_metrics_windows
from tidemark.streaming import start_metrics_stream
from tidemark.streaming.ledger import MetricsLedger, current_windows

LOG = ("completed_at timestamp_ntz, endpoint_name string, deployment_id string, outcome string, "
       "error_type string, latency_ms double, prediction double")
T0 = datetime(2024, 1, 1, 0, 0, 0)
CONTEXT = "deployment_id string, bundle_created_at timestamp_ntz, " + ", ".join(f"{c} string" for c in met.CONTEXT_FIELDS)


def lineage(spark, deployments=("0", "1")):
    return spark.createDataFrame([(d, datetime(2023, 1, 1), *[f"{c}-{d}" for c in met.CONTEXT_FIELDS]) for d in deployments], CONTEXT)


def row(seconds, deployment="0", outcome="success", latency=5.0):
    return (None if seconds is None else T0 + timedelta(seconds=seconds), "/predict", deployment, outcome, None, latency, 0.1)


def batches(seed=1, n=6):
    """Rows in rough time order: some far too late, some without time, outcome or lineage."""
    rng = random.Random(seed)
    out = []
    for b in range(n):
        rows = [row(b * 200 + rng.randint(0, 260), rng.choice("0012"), rng.choice(["success", "failure", "rejected"]),
                    rng.choice([None, 1.0, 2.5, round(rng.uniform(0, 9), 1)])) for _ in range(60)]
        if b > 2:
            rows += [row(rng.randint(0, 200), rng.choice("01")) for _ in range(7)]
        rows += [row(None), row(b * 200, outcome="odd"), row(b * 200, outcome=None), row(b * 200, outcome="invalid")]
        out.append(rows)
    return out


def lines(folder):
    out = []
    for f in glob.glob(os.path.join(folder, "**", "*.json"), recursive=True):
        with open(f) as fh:
            out += [json.loads(x) for x in fh if x.strip()]
    return out


def stored(base, name):
    return lines(os.path.join(base, "artifacts", "serving", name))


def key(r):
    return r["window_start"], r["deployment_id"]


VALUES = ["request_count", "success_count", "failure_count", "rejected_count", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]


def batch_windows(spark, rows, deployments=("0", "1")):
    got = met.window_records(met.metrics_windows(spark.createDataFrame(rows, LOG).where("completed_at IS NOT NULL")),
                             lineage(spark, deployments)).collect()
    return {(r["window_start"].isoformat() + "Z", r["deployment_id"]): [r[v] for v in VALUES] for r in got}


def test_every_row_is_counted_once_or_rejected(spark, tmp_dir):
    parts = batches(n=5)
    ledger = MetricsLedger(spark, lineage(spark), tmp_dir, delay_seconds=30)
    for b, rows in enumerate(parts):
        assert ledger.ingest(spark.createDataFrame(rows, LOG), b)
    assert not ledger.ingest(spark.createDataFrame(parts[-1], LOG), len(parts) - 1)  # sent again
    assert ledger.flush() and not ledger.flush()

    every = [r for rows in parts for r in rows]
    written = stored(tmp_dir, "metrics")
    assert max(Counter(map(key, written)).values()) == 1  # each window once
    held = stored(tmp_dir, "metrics_withheld")
    assert {r["deployment_id"] for r in held} == {"2"} and max(Counter(map(key, held)).values()) == 1
    rejects = Counter(r["reason"] if "reason" in r else None for r in
                      (x.asDict() for x in spark.read.json(os.path.join(tmp_dir, "artifacts/serving/rejects")).collect()))
    assert rejects["no_time"] == 5 and rejects["unknown_outcome"] == 10 and rejects["invalid_request"] == 5 and rejects["late"] >= 14
    counted = sum(r["request_count"] for r in written + held)
    assert counted + sum(rejects.values()) == len(every)
    now = {(r["window_start"], r["deployment_id"]): [r[v] for v in VALUES] for r in current_windows(spark, tmp_dir).collect()}
    assert now == batch_windows(spark, every)  # corrected windows equal the batch windows
    assert any(r["version"] > 0 for r in stored(tmp_dir, "metrics_corrections"))


@pytest.mark.parametrize("where", ["before", "during", "after"])
def test_a_killed_batch_run_again_leaves_one_copy(spark, tmp_dir, monkeypatch, where):
    """The driver dies before the manifest, in the middle of the moves, or before the marker."""
    parts = batches(2, 3)
    ledger = MetricsLedger(spark, lineage(spark), tmp_dir, delay_seconds=30)
    ledger.ingest(spark.createDataFrame(parts[0], LOG), 0)
    seen = len(stored(tmp_dir, "metrics"))

    class Killed(Exception):
        pass

    calls = {"n": 0}

    def dying(self, *args):
        calls["n"] += 1
        if where != "during" or calls["n"] == 3:
            raise Killed
        return real(self, *args)

    name = {"before": "rename_new", "during": "move", "after": "write"}[where]  # the manifest, a folder, the marker
    real = getattr(commits.Files, name)
    if where == "after":
        def dying(self, path, text):  # noqa: F811
            if path.endswith(".done"):
                raise Killed
            return real(self, path, text)
    monkeypatch.setattr(commits.Files, name, dying)
    with pytest.raises(Killed):
        ledger.ingest(spark.createDataFrame(parts[1], LOG), 1)
    if where == "before":
        assert len(stored(tmp_dir, "metrics")) == seen  # nothing of it is seen
    monkeypatch.undo()

    again = MetricsLedger(spark, lineage(spark), tmp_dir, delay_seconds=30)  # a new driver
    assert again.ingest(spark.createDataFrame(parts[1], LOG), 1) == (where == "before")
    again.ingest(spark.createDataFrame(parts[2], LOG), 2)
    again.flush()
    assert max(Counter(map(key, stored(tmp_dir, "metrics"))).values()) == 1
    now = {(r["window_start"], r["deployment_id"]): [r[v] for v in VALUES] for r in current_windows(spark, tmp_dir).collect()}
    assert now == batch_windows(spark, [r for rows in parts for r in rows])
    assert os.listdir(os.path.join(tmp_dir, "_staging")) == [] or where == "before"


def test_each_window_once_over_a_stop_and_a_restart(spark, tmp_dir):
    """The stream is stopped with windows open, flushed, started again with rows for the same minute."""
    src, ckpt = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "ckpt")
    first = [row(s, "0") for s in (5, 20, 65, 70, 130)]
    second = [row(s, "0", latency=8.0) for s in (140, 150, 200, 10)]

    def run(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)
        stream = start_metrics_stream(spark.readStream.schema(LOG).parquet(src), lineage(spark), tmp_dir, output_mode="update",
                                      watermark="30 seconds", checkpoint=ckpt, available_now=True)
        stream.awaitTermination(300)

    run(first)
    assert Counter(map(key, stored(tmp_dir, "metrics"))) == {(f"2024-01-01T00:0{m}:00Z", "0"): 1 for m in range(3)}
    run(second)
    written = stored(tmp_dir, "metrics")
    assert Counter(map(key, written)) == {(f"2024-01-01T00:0{m}:00Z", "0"): 1 for m in range(4)}
    late = [r for r in spark.read.json(os.path.join(tmp_dir, "artifacts/serving/rejects")).collect()]
    assert sum(r["request_count"] for r in written) + len(late) == len(first) + len(second)
    now = {(r["window_start"], r["deployment_id"]): [r[v] for v in VALUES] for r in current_windows(spark, tmp_dir).collect()}
    assert now == batch_windows(spark, first + second)


def test_stream_rows_are_counted_or_late(spark, tmp_dir):
    """As the reference's late rows: none is lost, and the corrected window has them."""
    src = os.path.join(tmp_dir, "log")
    parts = [[row(30)], [row(600)], [row(40, latency=9.0), row(620, outcome="failure")], [row(900)]]
    for k, rows in enumerate(parts):  # one file a batch, in this order
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)
        for f in glob.glob(os.path.join(src, "part-*")):
            if os.path.getmtime(f) > 1_000_000_000 + 100:
                os.utime(f, (1_000_000_000 + k, 1_000_000_000 + k))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    start_metrics_stream(stream, lineage(spark), tmp_dir, checkpoint=os.path.join(tmp_dir, "c"), available_now=True).awaitTermination(300)
    written = stored(tmp_dir, "metrics")
    assert {key(r): r["request_count"] for r in written} == {("2024-01-01T00:00:00Z", "0"): 1, ("2024-01-01T00:10:00Z", "0"): 2}
    assert len(spark.read.json(os.path.join(tmp_dir, "artifacts/serving/rejects")).where("reason = 'late'").collect()) == 1
    (fixed,) = stored(tmp_dir, "metrics_corrections")
    assert [fixed[v] for v in VALUES] == batch_windows(spark, [r for p in parts for r in p])[key(fixed)]
    assert fixed["request_count"] == 2 and fixed["latency_p99_ms"] == 9.0 and fixed["version"] == 3


def test_batch_sinks_take_a_batch_once(spark, tmp_dir, monkeypatch):
    records = met.window_records(met.metrics_windows(spark.createDataFrame([row(s) for s in range(0, 600, 7)], LOG)), lineage(spark))
    n = records.count()
    assert write_metrics_windows(records, tmp_dir, batch_id="night-1")
    assert not write_metrics_windows(records, tmp_dir, batch_id="night-1")
    assert len(stored(tmp_dir, "metrics")) == n
    real, calls = commits.Files.move, []

    def dying(self, *args):
        calls.append(args)
        if len(calls) > 2:
            raise KeyboardInterrupt
        return real(self, *args)

    monkeypatch.setattr(commits.Files, "move", dying)
    with pytest.raises(KeyboardInterrupt):
        write_metrics_windows(records, tmp_dir, batch_id="night-2")
    monkeypatch.undo()
    assert not write_metrics_windows(records, tmp_dir, batch_id="night-2")  # finished, not written again
    assert len(stored(tmp_dir, "metrics")) == 2 * n
    assert write_metrics_windows(records.limit(0), tmp_dir, batch_id="empty") and len(stored(tmp_dir, "metrics")) == 2 * n


def test_the_first_of_two_attempts_wins(spark, tmp_dir):
    log = CommitLog(spark, tmp_dir)
    one, two = log.begin(7), log.begin(7)
    one.write(spark.range(3), "t")
    two.write(spark.range(5), "t")
    assert two.commit({"by": "two"}) and not one.commit({"by": "one"})
    assert spark.read.parquet(os.path.join(tmp_dir, "t")).count() == 5 and CommitLog(spark, tmp_dir).state() == {"by": "two"}
    assert log.begin(7) is None and os.listdir(os.path.join(tmp_dir, "_staging")) == []


def test_a_day_of_events_is_not_one_task(spark, tmp_dir):
    """A folder that is larger than a task should write is split by its measured size."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        events = spark.range(6000).select(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("event_time"),
                                          F.sha2(F.col("id").cast("string"), 512).alias("x")).repartition(8)
        write_deployment_events(events, tmp_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(os.path.join(tmp_dir, "artifacts/serving/events/date=2024-01-01/*.json"))) > 3
    assert len(stored(tmp_dir, "events")) == 6000


def test_contexts_by_interval(spark):
    """Two bundles on one deployment: each window has the one active at its start, and none is withheld."""
    times = [None, datetime(2024, 1, 1, 0, 2, 30), datetime(2024, 1, 3), datetime(2024, 1, 3, 0, 10)]
    rows = [("0", t, *[f"{c}-{k}" for c in met.CONTEXT_FIELDS]) for k, t in enumerate(times[1:], 1)]
    rows += [("1", None, *["b"] * 8), ("1", datetime(2024, 1, 1, 0, 5), *["c"] * 8), ("1", datetime(2024, 1, 1, 0, 5), *["d"] * 8)]
    ctx = spark.createDataFrame(rows, CONTEXT.replace("bundle_created_at", "activated_at"))
    seconds = (0, 120, 180, 86_400, 172_740, 172_800, 173_340, 173_400, 400_000)
    log = spark.createDataFrame([row(s, d) for s in seconds for d in "012"], LOG)
    windows = met.metrics_windows(log)
    got = {key(r): r["model_name"] for r in met.window_records(windows, ctx).collect()}

    def at(s):
        return T0 + timedelta(seconds=s - s % 60)

    want = {}
    for s in seconds:
        k = max([n for n, t in enumerate(times) if t is not None and t <= at(s)], default=1)
        want[(at(s), "0")] = f"model_name-{k}"
        want[(at(s), "1")] = "d" if at(s) >= datetime(2024, 1, 1, 0, 5) else "b"
    assert got == want
    assert {r["deployment_id"] for r in met.withheld_windows(windows, ctx).collect()} == {"2"}
    assert met.window_records(windows, lineage(spark).drop("bundle_created_at")).count() == 2 * len(seconds)


def test_contexts_are_read_once_a_batch(spark, tmp_dir):
    """Records, withheld windows and corrections share one reading of the lineage."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    contexts = lineage(spark, ("0", "1", "7")).coalesce(1).mapInArrow(counted, CONTEXT)
    led = MetricsLedger(spark, contexts, tmp_dir, delay_seconds=60)
    seen = []
    for n, rows in enumerate(([row(0), row(400, "2")], [row(5, "1"), row(500)])):
        led.ingest(spark.createDataFrame(rows, LOG), n)
        seen.append(read.value)
    assert seen == [3, 6]
    assert len(stored(tmp_dir, "metrics")) == 1 and len(stored(tmp_dir, "metrics_corrections")) == 1
    assert [r["deployment_id"] for r in stored(tmp_dir, "metrics_withheld")] == ["2"]
