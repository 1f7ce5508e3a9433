"""Rate limits against brute force and as a stream; manifests, intake, splits."""

import json
import random
import shutil
import tempfile
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from grantlens.operators.evaluation import assign_split, global_ordinal
from grantlens.sources import records as S
from grantlens.streaming import limits as L
from grantlens.streaming.expiry import closed_windows, use_timers
from grantlens.streaming.intake import stream_intake
from grantlens.streaming.sinks import read_batches, split_sink


def brute(rows, seconds, limit):
    out, state = {}, {}
    for event, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        start, n = state.get(user, (None, 0))
        if start is None or ts >= start + timedelta(seconds=seconds):
            start, n = ts, 0
        state[user] = (start, n + 1)
        out[event] = (n + 1, n + 1 > limit)
    return out


def log(n=600, hot=0.4):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    return [(i, 0 if rng.random() < hot else rng.randint(1, 9), t0 + timedelta(seconds=rng.randint(0, 40_000))) for i in range(n)]


def test_rate_limit_with_a_hot_key(spark):
    rows = log()
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp")
    got = {r.event_id: (r.hits, r.is_blocked) for r in L.rate_limit(df, seconds=900, limit=4).collect()}
    assert got == brute(rows, 900, 4)


def test_rate_limit_of_long_runs_and_ties(spark):
    """Chains of many windows without a gap, gaps of just a window, equal times, and other columns."""
    t0, rng = datetime(2024, 1, 1, 0, 0, 7), random.Random(9)
    for seed in range(3):
        rows, at, n = [], 0, 0
        for user in range(5):
            at = rng.randint(0, 3000)
            for _ in range(rng.choice([1, 3, 40, 400])):
                at += rng.choice([0, 1, 13, 59, 60, 61, 7, 119, 120, 121] if user != 2 else [13, 20])
                rows.append((n, user, t0 + timedelta(seconds=at)))
                n += 1
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp").selectExpr("*", "1 as k", "2 as t", "3 as slot", "4 as s")
        got = {r.event_id: (r.hits, r.is_blocked) for r in L.rate_limit(df, seconds=60, limit=2).collect()}
        assert got == brute(rows, 60, 2)
    assert L.rate_limit(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, t0), (2, 5, None), (3, 5, t0)], "event_id bigint, user_id bigint, ts timestamp")
    assert [tuple(r)[0] for r in L.rate_limit(odd).collect()] == [3]


def test_an_endless_key_is_spread_over_tasks(spark):
    """One key without a pause of a window: its windows and hits come from several tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t0 = datetime(2024, 1, 1)
        rows = [(i, 1, t0 + timedelta(seconds=i * 11)) for i in range(4000)]
        got = L.rate_limit(spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp"), seconds=900, limit=4)
        per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) > 1 and max(per_task) < 3500
        assert {r.event_id: (r.hits, r.is_blocked) for r in got.collect()} == brute(rows, 900, 4)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stream_equals_batch(spark):
    rows = sorted(log(200), key=lambda r: r[2])
    folder, spot = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    schema = "event_id bigint, user_id bigint, ts timestamp"
    for i in range(0, 200, 50):
        spark.createDataFrame(rows[i:i + 50], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(folder)
    q = (L.stream_rate_limit(stream, seconds=900, limit=2).writeStream.format("memory").queryName("limited").option("checkpointLocation", spot).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.event_id: (r.hits, r.is_blocked) for r in spark.table("limited").collect()}
    assert got == brute(rows, 900, 2)


def test_manifest_keeps_malformed_lines(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/m.jsonl"
    good = {"id": "a", "cohort_id": "C1", "ground_truth": {"studentName": "ARUN", "marks": None}}
    with open(path, "w") as f:
        f.write(json.dumps(good) + "\n\n{broken\n")
    ok, bad = S.quarantine(S.read_manifest(spark, path).cache())
    assert [(r.id, r.ground_truth.studentName) for r in ok.collect()] == [("a", "ARUN")] and bad.count() == 1


def test_results_round_trip_and_metadata(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/out"
    S.write_results(spark.createDataFrame([("a", "C1")], "id string, cohort_id string"), path)
    assert [r.cohort_id for r in S.read_manifest(spark, path).collect()] == ["C1"]
    folder = tempfile.mkdtemp(prefix="run-")
    for name, cohort in (("1.json", "OLD"), ("2.json", "NEW")):
        with open(f"{folder}/{name}", "w") as f:
            json.dump({"id": "a", "cohort_id": cohort}, f, indent=2)
    latest = S.dedup_latest(S.read_metadata_dir(spark, folder), ["id"], "source_file").collect()
    assert [r.cohort_id for r in latest] == ["NEW"]


INTAKE = "name string, email string, issue_type string, message string, comment string, rating double, captcha_token string"
TOKEN = "t" * 20


def test_intake_rules(spark):
    rows = [("A", "a@b.in", "bug", " hi ", "", 5.0, TOKEN), ("", "", "", "", "", 0.0, TOKEN), ("", "", "", "", "", 1.0, TOKEN), ("A", "a b@c.in", "", "", "", 0.0, TOKEN),
            ("A", "", "", "", "", 6.0, TOKEN), ("A" * 101, "", "", "", "", 0.0, TOKEN), ("A", "", "", "", "", 0.0, "x")]
    got = [r.reject_reason for r in S.judge_intake(spark.createDataFrame(rows, INTAKE)).collect()]
    assert got == [None, "empty", None, "email_invalid", "rating_out_of_range", "name_too_long", "token_invalid"]


def test_intake_stream_has_a_quarantine(spark):
    source, out, bad, spot = (tempfile.mkdtemp(prefix="run-") for _ in range(4))
    spark.createDataFrame([("A", "a@b.in", "", "x", "", 1.0, TOKEN), ("B", "", "", "", "", 9.0, TOKEN)], INTAKE).write.mode("overwrite").json(source)
    stream_intake(spark.readStream.schema(INTAKE).json(source), out + "/v", bad + "/r", spot).awaitTermination(120)
    assert spark.read.json(out + "/v").count() == 1
    assert read_batches(spark, out + "/none", INTAKE).count() == 0
    assert [r.reject_reason for r in spark.read.json(bad + "/r").collect()] == ["rating_out_of_range"]


def test_a_replayed_batch_leaves_no_duplicates(spark):
    """The log of finished batches loses its last entry, as when the driver dies after writing: the batch runs again."""
    source, out, bad, spot = (tempfile.mkdtemp(prefix="run-") for _ in range(4))
    schema = INTAKE + ", n int"
    run = lambda log: stream_intake(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source), out + "/v", bad + "/r", log)
    for n in range(2):
        rows = [("A", "", "", f"text {n}", "", float(i % 7), TOKEN, n * 100 + i) for i in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    run(spot).awaitTermination(120)
    read = lambda: sorted(r.n for p in (out + "/v", bad + "/r") for r in read_batches(spark, p, "n int").collect())
    assert read() == [*range(20), *range(100, 120)]
    lost = shutil.copytree(spot, tempfile.mkdtemp(prefix="run-") + "/log", ignore=lambda at, names: {"1", ".1.crc"} & set(names) if at.endswith("commits") else ())
    again = run(lost)
    again.awaitTermination(120)
    assert [p["batchId"] for p in again.recentProgress if p["numInputRows"]] == [1]
    assert read() == [*range(20), *range(100, 120)]


def test_expired_windows_of_unordered_batches(spark):
    """Several micro-batches, out of order within the delay: windows equal those of the batch job, a late event counts nowhere, state goes."""
    use_timers(spark)
    t0 = datetime(2024, 1, 1)
    rng = random.Random(4)
    at = sorted(rng.randint(0, 30_000) for _ in range(300))
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4]), t0 + timedelta(seconds=s)) for i, s in enumerate(at)]
    parts = [rows[a:a + 75] for a in range(0, 300, 75)]
    # Neighbouring events change places over the border of two batches.
    for a, b in zip(parts, parts[1:]):
        a[-1], b[0] = b[0], a[-1]
    late, end = (900, 1, t0 + timedelta(seconds=at[10])), (901, 99, t0 + timedelta(seconds=200_000))
    parts = [*parts, [late], [end]]
    source, out, spot = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    schema = "event_id bigint, user_id bigint, ts timestamp"
    for part in parts:
        shuffled = rng.sample(part, len(part))
        spark.createDataFrame([*shuffled, (None, None, part[0][2])], schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in order of their times
    stream = closed_windows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), seconds=900, limit=3, watermark="600 seconds")
    q = stream.writeStream.foreachBatch(split_sink({out + "/w": F.lit(True)}, kind="parquet")).option("checkpointLocation", spot).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {(r.user_id, r.window_start): (r.hits, r.n_blocked) for r in read_batches(spark, out + "/w", stream.schema, "parquet").collect()}
    want = {}
    for r in L.rate_limit(spark.createDataFrame(rows, schema), seconds=900, limit=3).collect():
        n, blocked = want.get((r.user_id, r.window_start), (0, 0))
        want[r.user_id, r.window_start] = (n + 1, blocked + r.is_blocked)
    assert got == want
    operators = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for o in operators) >= 1


def test_sessions_end_on_the_first_bad_attempt(spark):
    t0 = datetime(2024, 1, 1)
    sessions = spark.createDataFrame([("s", "ip1", t0)], "token string, ip string, issued_at timestamp")
    reqs = [(1, "s", "ip1", 1), (2, "s", "ip1", 2), (3, "s", "ip1", 3), (4, "s", "ip2", 4), (5, "s", "ip1", 5), (6, "z", "ip1", 1)]
    df = spark.createDataFrame([(i, tok, ip, t0 + timedelta(seconds=s)) for i, tok, ip, s in reqs], "request_id int, token string, ip string, ts timestamp")
    got = {r.request_id: r.verdict for r in L.session_validity(df, sessions, max_uses=2).collect()}
    assert got == {1: "ok", 2: "ok", 3: "limit", 4: "invalid", 5: "invalid", 6: "unknown"}


def test_global_ordinal_and_split(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    rows = global_ordinal(df, "k").select("k", "ordinal").collect()
    assert [k for k, _ in sorted(((r.k, r.ordinal) for r in rows), key=lambda x: x[1])] == sorted(r.k for r in rows)
    assert sorted(r.ordinal for r in rows) == list(range(1000))
    counts = {r.split: r["count"] for r in assign_split(df, "k").groupBy("split").count().collect()}
    assert counts == {"train": 700, "validation": 150, "test": 150}
