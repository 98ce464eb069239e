import os
from functools import partial

import pytest

from rillwork.plans import load_registry
from rillwork.streaming import aggregates, lifecycle
from rillwork.streaming.aggregates import drained, table_stream

FOLDER = "/root/testdata/sf0.001"


def test_tables_as_file_and_as_folder(spark, tmp_path):
    source = spark.read.parquet(f"{FOLDER}/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    # another table whose name begins alike is not part of the stream
    source.limit(5).write.parquet(f"{tmp_path}/events_archive.parquet")
    assert os.path.isdir(f"{tmp_path}/events.parquet")
    assert drained(table_stream(spark, str(tmp_path), "events", 1)).count() == source.count()
    assert drained(table_stream(spark, FOLDER, "events")).count() == source.count()


def test_a_stream_that_puts_out_nothing(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert drained(table_stream(spark, str(tmp_path), "events")).count() == 0


STREAMS = ("order_lifecycle_stream", "catalog_lifecycle_stream", "payment_events", "audit_log", "gauge_stream",
           "delivery_expiry_stream", "live_counters")


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The tables as folders of three files each, the latest events first."""
    folder = tmp_path_factory.mktemp("scattered")
    for table, time in (("events", "ts"), ("orders", "o_orderdate")):
        rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
        rows.repartitionByRange(3, time).write.parquet(f"{folder}/{table}.parquet")
        for i, file in enumerate(sorted(f for f in os.listdir(f"{folder}/{table}.parquet") if f.startswith("part-"))):
            os.utime(f"{folder}/{table}.parquet/{file}", (1_700_000_000 - 1000 * i,) * 2)
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_streams_in_files_newest_first_give_the_batch_answer(spark, scattered, monkeypatch, name):
    query = load_registry()[name].run
    want = sorted(map(str, query(spark, FOLDER).collect()))
    one_file = aggregates.table_stream
    monkeypatch.setattr(aggregates, "table_stream", lambda s, folder, table: one_file(s, folder, table, 1))
    monkeypatch.setattr(lifecycle, "drained_in_order", partial(_patient, lifecycle.drained_in_order))
    assert sorted(map(str, query(spark, scattered).collect())) == want


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The tables as folders of more files than a trigger reads, the latest events first."""
    folder = tmp_path_factory.mktemp("many")
    for table, time in (("events", "ts"), ("orders", "o_orderdate")):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").repartitionByRange(70, time).write.parquet(f"{folder}/{table}.parquet")
        files = sorted(f for f in os.listdir(f"{folder}/{table}.parquet") if f.startswith("part-"))
        assert len(files) > 64
        for i, file in enumerate(files):
            os.utime(f"{folder}/{table}.parquet/{file}", (1_700_000_000 - 1000 * i,) * 2)
    return str(folder)


@pytest.mark.parametrize("name", (*STREAMS, "gauge_days", "event_rate"))
def test_streams_in_many_files_with_their_own_delays(spark, many_files, name):
    query = load_registry()[name].run
    assert sorted(map(str, query(spark, many_files).collect())) == sorted(map(str, query(spark, FOLDER).collect()))


def _patient(drain, stream, step, delay):
    return drain(stream, step, "5000 days")


def test_late_and_invalid_rows_keep_an_outcome(spark, tmp_path):
    moves, states = {"a": frozenset("b"), "b": frozenset("c")}, ("a", "b", "c")
    run = lifecycle.OrderedRun(spark, str(tmp_path), lifecycle.machine_step(states, moves, "a"), "1 day", gather=2)
    batches = ["('k', 1, timestamp'2024-01-10', 'b'), ('m', 2, timestamp'2024-01-02', 'b')", "('k', 3, timestamp'2024-01-01', 'b'), ('k', 4, timestamp'2024-01-12', 'c')",
               "('m', 5, timestamp'2024-01-20', 'c'), (NULL, 6, timestamp'2024-01-20', 'c'), ('k', 7, CAST(NULL AS timestamp), 'c')", "('m', 5, timestamp'2024-01-20', 'c')"]
    for i, rows in enumerate(batches):
        run(spark.sql(f"SELECT * FROM VALUES {rows} AS t(key, event_id, ts, target)"), i)
    # a batch that is replayed replaces its own rows
    run(spark.sql(f"SELECT * FROM VALUES {batches[-1]} AS t(key, event_id, ts, target)"), len(batches) - 1)
    run.close()
    got = sorted((r.event_id, r.outcome, r.state_after) for r in run.output().collect())
    assert got == [(1, "applied", "b"), (2, "applied", "b"), (3, "late", None), (4, "applied", "c"), (5, "applied", "c"), (6, "invalid", None), (7, "invalid", None)]


def test_expiry_across_batches(spark, tmp_path):
    run = lifecycle.OrderedRun(spark, str(tmp_path), lifecycle.expiry_step, "0 days", gather=2)
    day = "timestamp'2024-01-{:02d}'".format
    batches = [[("a", 1, "granted", 5), ("b", 1, "granted", 5), ("c", 1, "granted", 4)], [("b", 5, "revoked", 5), ("a", 3, "granted", 9)],
               [("d", 8, "granted", 30)], [("e", 10, "granted", 12), ("f", 2, "granted", 3)]]
    for i, rows in enumerate(batches):
        values = ", ".join(f"('{k}', {day(t)}, '{kind}', {day(e)})" for k, t, kind, e in rows)
        run(spark.sql(f"SELECT * FROM VALUES {values} AS t(key, ts, kind, expires_at)"), i)
    run.close()
    got = sorted((r.key, r.access or "", r.at.day if r.at else 0, r.outcome) for r in run.output().collect())
    assert got == [("a", "expired", 9, "applied"), ("b", "revoked", 5, "applied"), ("c", "expired", 4, "applied"), ("f", "", 0, "late")]


def _rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_daily_means_become_monthly_ones_and_late_readings_are_left_out(spark, tmp_path):
    import datetime as dt
    day = lambda m, d, h=0: dt.datetime(2023, m, d, h)
    files = [[(1, day(1, 30), 2.0), (1, day(1, 30, 6), 4.0), (1, day(1, 31), 9.0), (2, day(2, 27), 5.0)],
             [(1, day(2, 3), 8.0), (1, day(1, 31, 12), 11.0)],  # within the delay: both are counted
             [(1, day(3, 20), 1.0)],  # passes the end of both months
             [(1, day(3, 21), 3.0)],  # Spark drops what is late from the trigger after that on
             [(1, day(1, 15), 1000.0), (1, day(3, 22), 3.0), (1, None, 7.0)]]  # too late, on time, without a time
    for i, rows in enumerate(files):
        _rows(spark, rows, "site long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/readings.parquet/{i}")
        for name in os.listdir(f"{tmp_path}/readings.parquet/{i}"):
            if name.startswith("part-"):
                os.rename(f"{tmp_path}/readings.parquet/{i}/{name}", f"{tmp_path}/readings.parquet/part-{i}.parquet")
                os.utime(f"{tmp_path}/readings.parquet/part-{i}.parquet", (1_700_000_000 + 1000 * i,) * 2)
    stream = table_stream(spark, str(tmp_path), "readings", 1)
    got = sorted((r["site"], r["month"].month, r["mean"], r["days"], r["readings"]) for r in drained(aggregates.gauge_monthly(stream, 40)).collect())
    assert got == [(1, 1, (3.0 + 10.0) / 2, 2, 4)]
    got = sorted((r["site"], r["month"].month, r["mean"]) for r in drained(aggregates.gauge_monthly(stream, 2)).collect())
    assert (1, 2, 8.0) in got and (2, 2, 5.0) in got and all(m < 400 for _, _, m in got) and all(month != 3 for _, month, _ in got)


def test_spark_drops_repeated_notices_across_triggers(spark, tmp_path):
    import datetime as dt
    at = dt.datetime(2023, 5, 1)
    for i in range(3):
        _rows(spark, [("k", 7, at, "paid"), ("k", 8 + i, at, "paid")], "key string, event_id long, ts timestamp, target string").coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/notices.parquet")
    stream = table_stream(spark, str(tmp_path), "notices", 1)
    got = sorted(r["event_id"] for r in drained(lifecycle.once_each(stream, "10 days")).collect())
    assert got == [7, 8, 9, 10]
