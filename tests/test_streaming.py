"""Streaming twins against their batch operators."""

from dataclasses import replace
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from portcullis.operators import budgets
from portcullis.operators import state as batch
from portcullis.plans import gateway, logs
from portcullis.sources import audit
from portcullis.streaming import budgets as timed
from portcullis.streaming import state as live

DAY = 86400


def drain(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_stateful_operators_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 60")
    for part in range(3):  # three files, in the order of time
        events.where((F.dayofmonth("ts") - 1) % 31 >= part * 10).where((F.dayofmonth("ts") - 1) < (part + 1) * 10 + (5 if part == 2 else 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    expected = batch.loop_guard(events, "user_id", ["event_type"], DAY, 1).select("event_id", "identical", "action")
    assert rows(drain(live.loop_guard(stream, DAY, 1), tmp_path, "loops")) == rows(expected)
    tainted = batch.taint(events, "user_id", F.col("event_type") == "error", DAY, False).select("event_id", "tainted")
    assert rows(drain(live.taint(stream, DAY), tmp_path, "taints")) == rows(tainted)
    admitted = batch.admissions(events, "user_id", DAY, 1).join(events, ["user_id", "ts"]).select("event_id", "admitted")
    assert rows(drain(live.admissions(stream, DAY, 1), tmp_path, "admissions")) == rows(admitted)
    used = drain(live.usage(stream, "1 hour"), tmp_path, "usage", "complete")
    assert rows(used) == rows(batch.usage(events, "user_id", F.col("value"), "day"))


@pytest.fixture()
def timers(spark):
    """The state store that keeps timers."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, timed.PROVIDER)
    yield
    spark.conf.unset(key)


def test_accounts_and_histories_with_timers_equal_batch(spark, tmp_path, timers):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    requests = gateway.budget_requests(events).withColumn("identity", F.col("identity") % 4).withColumn("tool", F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("t"), F.col("event_id") % 5)))
    for part in range(4):  # files in the order of time
        requests.where((F.dayofmonth("ts") - 1).between(part * 8, part * 8 + 7)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    limits = replace(gateway.LIMITS, tokens=3000)
    expected = rows(budgets.reservations(requests, "identity", limits))
    assert {r[1] for r in expected} == {None, "rpm", "tokens", "cost", "compute"}
    assert rows(drain(timed.reservations(stream, "identity", limits), tmp_path, "accounts")) == expected
    history = batch.call_history(requests, "identity", "tool", 30_000, 5).select("event_id", "calls", "recent")
    assert rows(drain(timed.call_history(stream, "identity", "tool", 30_000, 5), tmp_path, "histories")) == rows(history)


def test_state_ends_when_its_timer_rings(spark, tmp_path, timers):
    row = lambda i, user, t: (i, user, t, 1, 1, None, None, 5, 1, 0.0, 0.0)
    fields = "event_id long, identity long, t long, prompt_tokens int, max_tokens int, price_in double, price_out double, settles_s int, used_tokens int, used_cost double, used_compute double"
    for part in ([row(0, 1, 0), row(1, 2, 0)], [row(2, 2, 90_000)], [row(3, 2, 180_000)], [row(4, 1, 180_100)]):
        frame = spark.createDataFrame(part, fields).withColumn("ts", F.timestamp_seconds("t")).drop("t")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = timed.reservations(stream, "identity", budgets.Limits(rpm=9)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "state"))
    assert kept.count() < 2 + 2  # the first user's old state is gone, nobody has two
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert min(rows[1:]) < max(rows)


def test_log_tail_drops_repeats(spark, tmp_path):
    (tmp_path / "log").mkdir()
    line = '{"ts": "2024-01-01T00:00:0%d.000Z", "event_id": "%d", "type": "request"}\n'
    (tmp_path / "log/1.jsonl").write_text(line % (1, 1) + line % (2, 2))
    (tmp_path / "log/2.jsonl").write_text(line % (2, 2) + "broken\n" + line % (3, 3))
    query = audit.follow(audit.tail(spark, str(tmp_path / "log")).drop("at"), str(tmp_path / "copy"), str(tmp_path / "checkpoint")).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in audit.events(audit.scan(spark, str(tmp_path / "copy"))).collect()) == ["1", "2", "3"]


def test_log_lands_in_bounded_batches(spark, monkeypatch):
    assert [logs.batches(n, timedelta(days=1)) for n in (0, 10**5, 3 * 10**6, 10**9)] == [4, 4, 6, 12] and logs.batches(10**9, timedelta(0)) == 4
    landed, append = [], audit.append

    def counted(df, path, *more):
        if "landed" in path:
            landed.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        append(df, path, *more)

    monkeypatch.setattr(audit, "append", counted)
    monkeypatch.setattr(logs, "LANDING", 200)
    monkeypatch.setattr(logs, "TASK", 50)
    found = logs.followed_events(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert sum(r.events for r in found) == sum(r.ids for r in found) == rows
    assert len(landed) == -(-rows // 200) and max(max(x) for x in landed) <= 100


def test_followed_log_is_deleted_and_its_copy_compressed(spark, monkeypatch):
    paths, fresh_path = {}, logs.fresh_path
    monkeypatch.setattr(logs, "fresh_path", lambda spark, name: paths.setdefault(name, fresh_path(spark, name)))
    found = logs.followed_events(spark, "/root/testdata/sf0.001")
    files = {name: [f for f in Path(paths[name].removeprefix("file:")).rglob("*json*") if not f.name.startswith(".")] for name in ("landed", "followed")}
    assert not files["landed"]  # no file that a batch has read stays
    size = sum(f.stat().st_size for f in files["followed"])
    raw = found.sparkSession.read.text(paths["followed"]).agg(F.sum(F.octet_length("value"))).first()[0]
    assert 0 < size < raw / 4
    assert sum(r.events for r in found.collect()) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_log_tail_deletes_only_what_it_is_told_to(spark, tmp_path):
    (tmp_path / "log").mkdir()
    line = '{"ts": "2024-01-01T00:00:0%d.000Z", "event_id": "%d", "type": "request"}\n'
    for clean in (False, True):
        left = []
        for n in range(3):
            (tmp_path / f"log/{clean}{n}.jsonl").write_text(line % (n, n))
            audit.follow(audit.tail(spark, str(tmp_path / "log"), clean=clean).drop("at"), str(tmp_path / f"copy{clean}"), str(tmp_path / f"at{clean}")).start().awaitTermination()
            left.append(len(list((tmp_path / "log").glob(f"{clean}*"))))
        assert sorted(r.event_id for r in audit.events(audit.scan(spark, str(tmp_path / f"copy{clean}"))).collect()) == ["0", "1", "2"]
        assert left == [1, 2, 3] if not clean else max(left) <= 2
