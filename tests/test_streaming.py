import datetime as dt

from tidefold.operators.fold import fold
from tidefold.plans.views import commands_of, mutations_v
from tidefold.sources.tables import table_stream
from tidefold.streaming.ledger import KeyedLedger, LedgerStream, fresh_keys, lease_expiries

H = 3_600_000_000
COLUMNS = ["job_id", "state", "attempt", "token", "cancel_req", "accepted", "rejected"]


def rows(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()))


def test_stream_equals_batch_over_several_batches_and_restarts(spark, sf, tmp_path):
    source, folder = tmp_path / "events.parquet", f"file://{tmp_path}/ledger"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id")
    for k, (a, b) in enumerate(((0, 400), (400, 700), (700, 10_000))):
        events.where(f"event_id >= {a} AND event_id < {b}").coalesce(1).write.mode("append").parquet(str(source))
        state = LedgerStream(spark, folder).run(commands_of(table_stream(spark, str(tmp_path), "events", files_per_batch=1), None))
        assert rows(state) == rows(fold(commands_of(events.where(f"event_id < {b}"), None))), k
    assert rows(state) == rows(fold(mutations_v(spark, sf, None)))


def test_keyed_state_equals_batch_over_several_batches_and_restarts(spark, sf, tmp_path):
    source, folder = tmp_path / "events.parquet", f"file://{tmp_path}/keyed"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id")
    for a, b in ((0, 400), (400, 700), (700, 10_000)):
        events.where(f"event_id >= {a} AND event_id < {b}").coalesce(1).write.mode("append").parquet(str(source))
        state = KeyedLedger(spark, folder).run(commands_of(table_stream(spark, str(tmp_path), "events", files_per_batch=1), None))
        assert rows(state) == rows(fold(commands_of(events.where(f"event_id < {b}"), None)))
    changes = spark.read.parquet(f"{folder}/changes")
    assert state.count() <= changes.count() <= 3 * state.count() and changes.count() == changes.select("job_id", "lsn").distinct().count()


def test_a_batch_that_runs_again_changes_nothing(spark, sf, tmp_path):
    commands = mutations_v(spark, sf)
    stream = LedgerStream(spark, f"file://{tmp_path}/ledger")
    first, second = commands.where("lsn <= 300"), commands.where("lsn > 300")
    stream.apply(first, 0)
    stream.apply(second, 1)
    stream.apply(second, 1)
    from tidefold.sources.snapshots import newest_table

    assert rows(newest_table(spark, f"file://{tmp_path}/ledger/state")[0]) == rows(fold(commands))


def test_lease_timers(spark, tmp_path):
    start = 1_700_000_000_000_000
    data = [(1, start, "lease", 1), (2, start, "lease", 1), (1, start + H, "hb", 1), (2, start + H, "ok", 1), (3, start + 9 * H, "lease", 1), (4, start + 30 * H, "lease", 1)]
    spark.createDataFrame(data, "job_id long, us long, op string, token long").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = []
    stream = spark.readStream.schema("job_id long, us long, op string, token long").parquet(f"{tmp_path}/in")
    query = lease_expiries(stream, 12 * 3600 * 1000).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(out) == [(1, 1, start + 13 * H), (3, 1, start + 21 * H)]


def test_keys_are_fresh_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", t), ("a", t), ("b", t), (None, t), ("", t), (None, t)], "idem_key string, ts timestamp_ntz").write.parquet(f"{tmp_path}/in")
    for within in (None, "1 hour"):
        out = []
        stream = spark.readStream.schema("idem_key string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
        fresh_keys(stream, within=within).writeStream.option("checkpointLocation", f"{tmp_path}/cp{within}").foreachBatch(lambda b, _: out.extend(r.idem_key for r in b.collect())).trigger(availableNow=True).start().awaitTermination()  # noqa: B023
        assert sorted(map(str, out)) == ["", "None", "None", "a", "b"]


def test_submissions_from_files_and_streams(spark, tmp_path):
    from tidefold.sources import submissions

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type":"t"}\n{"type":"t","typo_field":1}\n{\n')
    good, bad = submissions.read(spark, str(tmp_path / "in"), 5)
    assert [(r.type, r.queue, r.run_at_us) for r in good.collect()] == [("t", "default", 5)]
    assert sorted(r.error for r in bad.collect()) == ["bad json", "unknown field typo_field"]
    out = []
    good, _ = submissions.stream(spark, str(tmp_path / "in"), 5)
    good.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(r.type for r in b.collect())).trigger(availableNow=True).start().awaitTermination()
    assert out == ["t"]
