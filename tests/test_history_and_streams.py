import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import alerts, deltas, retention
from fleetscope.plans import collectors
from fleetscope.schemas import HISTORY, TELEMETRY
from fleetscope.sinks import ddl, history, outbox, report
from fleetscope.sources import telemetry
from fleetscope.sources.cpu_records import parse_cpu_records
from fleetscope.streaming.alerts import alert_batches
from fleetscope.streaming.cpu import stream_cpu_history
from fleetscope.streaming.deltas import delta_batches, read_deltas
from fleetscope.streaming.run import write_available
from harness import streams

NOW = dt.datetime(2024, 1, 31)
EVENT = "server_id bigint, event_id bigint, severity bigint, error_number bigint, message string, event_time timestamp"


# ---- retention, history, outbox, reports ---------------------------------------------


def test_retention_boundaries(frame, rows):
    now = dt.datetime(2024, 1, 31, 10)
    times = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 10), dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 1, 1, 9, 59), None]
    df = frame("id int, t timestamp", list(enumerate(times)))
    kept = lambda grain: [i for i, in rows(retention.purge_history(df, "t", 30, grain, now), "id")]
    assert kept("date") == [0, 1, 3, 4]
    assert kept("timestamp") == [1, 4]
    once = retention.purge_history(df, "t", 30, "date", now)
    assert rows(retention.purge_history(once, "t", 30, "date", now), "id") == rows(once, "id")
    with pytest.raises(ValueError):
        retention.purge_history(df, "t", 30, "month", now)


def test_retention_reaches_the_scan(spark, frame, tmp_path):
    frame("id int, t timestamp", [(1, NOW)]).write.parquet(f"{tmp_path}/t")
    kept = retention.purge_history(spark.read.parquet(f"{tmp_path}/t"), "t", 30, "date", NOW)
    assert "GreaterThanOrEqual(t," in kept._jdf.queryExecution().executedPlan().toString()


def cpu_rows(frame, *items):
    return frame(HISTORY["cpu_usage"], [(1, r, t, 1, 2, 97) for r, t in items])


def test_day_folders(spark, frame, rows, tmp_path):
    path, schema = str(tmp_path / "cpu"), HISTORY["cpu_usage"]
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    history.append_history(cpu_rows(frame, (1, day(1)), (2, day(2, 23)), (3, day(3))), path, schema, "event_time")
    history.replace_day(cpu_rows(frame, (20, day(2)), (21, day(2, 5)), (9, day(9))), path, "event_time", dt.date(2024, 1, 2), "collection_date")
    assert rows(history.read_history(spark, path, schema), "record_id") == [(1,), (20,), (21,), (3,)]
    assert history.purge_days(spark, path, dt.datetime(2024, 2, 2, 5), 31) == [dt.date(2024, 1, 1)]
    assert rows(history.read_history(spark, path, schema), "record_id") == [(20,), (21,), (3,)]


def test_append_by_name(spark, frame, rows, tmp_path):
    spark.sql(f"create table by_name (a int, b string) using parquet location '{tmp_path}/t'")
    history.append_by_name(frame("b string, extra int, a int", [("x", 0, 1)]), "by_name")
    assert rows(spark.table("by_name"), "a", "b") == [(1, "x")]
    spark.sql("drop table by_name")


def test_ddl_and_small_sources(spark, frame):
    text = ddl.schema_ddl(frame("a int, b decimal(5,2)", []), "t", "d")
    assert text == "CREATE TABLE t (\n  `a` INT,\n  `b` DECIMAL(5,2)\n)\nUSING PARQUET\nPARTITIONED BY (`d`)"
    assert [r.number for r in telemetry.number_series(spark, 3).collect()] == [1, 2, 3]
    stacked = telemetry.union_databases({"x": frame("a int", [(1,)]), "y": frame("a int", [(2,)])})
    assert sorted(map(tuple, stacked.collect())) == [(1, "x"), (2, "y")]
    assert alerts.alert_rules(spark).count() == 13


def test_outbox_counts_successes_only(frame, rows):
    notices = outbox.outbox_enqueue(frame("server_id int, mail_subject string, mail_body string", [(1, "a", "x"), (1, "b", "y"), (2, "a", "x")]), NOW)
    ids = {(r.server_id, r.mail_subject): r.notification_id for r in notices.collect()}
    assert len(set(ids.values())) == 3
    tries = frame("notification_id string, mail_state int, attempted_at timestamp", [
        (ids[(1, "a")], 0, NOW), (ids[(1, "a")], 0, NOW + dt.timedelta(1)), (ids[(1, "b")], 1, NOW),
    ])
    doubled = notices.union(notices)
    assert rows(outbox.outbox_pending(doubled, tries), "server_id", "mail_subject") == [(1, "b"), (2, "a")]
    assert rows(outbox.outbox_state(doubled, tries), "mail_subject", "server_id", "delivered", "mail_delivered") == sorted([
        ("a", 1, True, NOW), ("a", 2, False, None), ("b", 1, False, None)], key=repr)


def test_report_pages_keep_all_rows_and_banding(frame):
    df = frame("server_id int, id int, name string", [(1, i, None if i == 2 else f"<{i}>") for i in range(1, 8)])
    pages = {r.page_no: r.body for r in report.report_document(df, ["server_id"], {"name": "Name"}, [F.col("id")], page_rows=3).collect()}
    assert sorted(pages) == [0, 1, 2]
    text = "".join(pages[p] for p in sorted(pages))
    assert text.count("<td ") == 7 and text.count('<tr bgcolor="#FFFFFF">') == 4 and text.count("color:#FF00FF;") == 1
    assert "&lt;7&gt;" in pages[2] and ">NULL<" in pages[0]


def test_space_texts(frame):
    from fleetscope.operators import space
    columns = "server_id int, collection_time timestamp, database_name string, logical_name string, file_type string, filegroup_name string, physical_name string, size_pages bigint, used_pages bigint, max_size_pages bigint, growth bigint, file_flags bigint, database_status string, updateability string, recovery_mode string"
    df = frame(columns, [(1, NOW, "d", "f", "ROWS", "P", "x", 1000, 13, -1, 10, 0x100002, "ONLINE", "READ_WRITE", "SIMPLE"), (1, NOW, "d", "g", "LOG", None, "y", 128, 128, 1280, 256, 2, "ONLINE", "READ_WRITE", "SIMPLE")])
    a, b = sorted(space.temp_space(df).collect(), key=lambda r: r.logical_file_name)
    assert (a.free_space_pct, a.max_size, a.growth, a.file_size_mb, a.free_space_mb) == ("98.700%", "Unlimited", "10%", 7, 7)
    assert (b.free_space_pct, b.max_size, b.growth) == ("0.000%", "10 MB", "2 MB")
    low = space.min_free_space(space.temp_space(df)).first()
    assert (low.min_free_percent, low.needs_drilldown) == (0, True)
    c, d = sorted(space.database_space(df).collect(), key=lambda r: r.logical_name)
    assert (str(c.space_mb), c.used_space_mb, str(c.free_space_mb), c.file_type) == ("7.81", 0, "7.71", "DATA")


# ---- alerts --------------------------------------------------------------------------


def brute(events):
    """Fired (server, rule, time in seconds), one event after the other."""
    last, fired = {}, set()
    for server, _, severity, error, _, at in sorted(events, key=lambda e: (e[5], e[1])):
        found = [f"Severity {severity:03d}"] if 16 <= severity <= 25 else []
        found += [f"Error Number {error}"] if error in (823, 824, 825) else []
        for rule in found:
            key = (server, rule)
            if key not in last or (at - last[key]).total_seconds() >= 60:
                last[key] = at
                fired.add((server, rule, at))
    return fired


def storm(seed, count=400):
    rnd = random.Random(seed)
    at, events = dt.datetime(2024, 1, 1), []
    for i in range(count):
        at += dt.timedelta(seconds=rnd.choice([0, 1, 7, 20, 30, 59.5, 60, 61, 300]), microseconds=rnd.choice([0, 1]))
        events.append((rnd.choice([1, 1, 1, 2]), i, rnd.choice([15, 16, 16, 25, 26]), rnd.choice([0, 823, 826]), "m", at))
    return events


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cooldown_matches_one_by_one_walk(frame, seed):
    events = storm(seed)
    fired = alerts.cooldown_alerts(frame(EVENT, events))
    assert sorted((r.server_id, r.rule, r.event_time) for r in fired.collect()) == sorted(brute(events))


def test_no_events_no_alerts(frame):
    assert alerts.cooldown_alerts(frame(EVENT, [])).count() == 0


def write_parts(spark, frame, schema, data, path, parts):
    size = -(-len(data) // parts)
    for i in range(parts):
        frame(schema, data[i * size:(i + 1) * size]).coalesce(1).write.mode("append").parquet(path)


def test_streamed_alerts_equal_batch_over_micro_batches(spark, frame, tmp_path):
    events = storm(5, 120)
    source = f"{tmp_path}/events"
    write_parts(spark, frame, EVENT, events, source, 3)
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    alert_batches(stream(), f"{tmp_path}/b", f"{tmp_path}/state", f"{tmp_path}/cb")
    got = spark.read.parquet(f"{tmp_path}/b").collect()
    assert sorted((r.server_id, r.rule, r.event_time) for r in got) == sorted(brute(events))


def test_alerts_go_on_from_an_earlier_checkpoint(spark, frame, tmp_path):
    events = storm(6, 120)
    for part, rows_ in enumerate((events[:60], events[60:])):
        frame(EVENT, rows_).coalesce(1).write.parquet(f"{tmp_path}/in{part}")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in{part}")
        alert_batches(stream, f"{tmp_path}/out{part}", f"{tmp_path}/state", f"{tmp_path}/c{part}")
    got = spark.read.parquet(f"{tmp_path}/out0").unionByName(spark.read.parquet(f"{tmp_path}/out1")).collect()
    assert sorted((r.server_id, r.rule, r.event_time) for r in got) == sorted(brute(events))


def test_sessions_are_cut_at_an_instant(spark, frame, rows, tmp_path):
    columns = [f.name for f in HISTORY["command_log"].fields]
    times = [NOW - dt.timedelta(days=30, hours=h) for h in (-1, 0, 1, 30)]
    df = frame("server_id bigint, start_time timestamp", list(enumerate(times))).select(
        *[F.col(c) if c in ("server_id", "start_time") else F.lit(None).cast(HISTORY["command_log"][c].dataType).alias(c) for c in columns]
    )
    collectors.store(spark, df, f"{tmp_path}/log", "command_log", "start_time", NOW)
    assert rows(history.read_history(spark, f"{tmp_path}/log", HISTORY["command_log"]), "server_id") == [(0,), (1,)]


def test_replacing_a_day_without_rows_empties_it(spark, frame, rows, tmp_path):
    day = dt.datetime(2024, 1, 2)
    df = frame("id int, at timestamp", [(1, day), (2, day - dt.timedelta(days=1))])
    for when in (day, day - dt.timedelta(days=1)):
        history.replace_day(df, f"{tmp_path}/h", "at", when.date())
    history.replace_day(df.filter("id > 5"), f"{tmp_path}/h", "at", day.date())
    assert rows(spark.read.parquet(f"{tmp_path}/h"), "id") == [(2,)]


# ---- CPU records and samples ---------------------------------------------------------


def record(i, idle=90, used=5, health=True):
    tag = "SystemHealth" if health else "Other"
    return f'<Record id = "{i}" type ="x"><{tag}><ProcessUtilization>{used}</ProcessUtilization><SystemIdle>{idle}</SystemIdle></{tag}></Record>'


def cpu_inputs(frame):
    rows = [(1, NOW, 10_000_000 - age * 1000, text) for age, text in (
        (1, record(9)), (1, record(9)), (100, record(8, 50, 30)), (899, record(7)), (900, record(6)), (50, record(5, health=False)), (60, "<Record id='4'><SystemHealth><SystemIdle>x"))]
    return frame(TELEMETRY["cpu_records"], rows), frame(TELEMETRY["clock"], [(1, NOW, 10_000_000)])


def test_cpu_records(frame, rows):
    records, clock = cpu_inputs(frame)
    parsed = parse_cpu_records(records, clock)
    assert rows(parsed.filter("record_id in (4, 8)"), "record_id", "system_idle", "sql_process", "other_process") == [(4, None, None, None), (8, 50, 30, 20)]
    stored = frame("server_id bigint, record_id bigint", [(1, 9)])
    new = collectors.cpu_history(records, clock, stored, count=2)
    assert rows(new, "record_id") == [(7,), (8,)]
    assert new.filter("record_id = 8").first().event_time == NOW - dt.timedelta(seconds=100)


def test_cpu_stream_keeps_each_fresh_record_once(spark, frame, rows, tmp_path):
    records, clock = cpu_inputs(frame)
    history.append_history(records, f"{tmp_path}/cpu_records", TELEMETRY["cpu_records"], "collection_time")
    stream = stream_cpu_history(telemetry.stream_telemetry(spark, str(tmp_path), "cpu_records"), clock)
    write_available(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "record_id") == [(4,), (7,), (8,), (9,)]


def test_streamed_deltas_equal_batch(spark, frame, rows, tmp_path):
    schema = TELEMETRY["snapshots"]
    rnd = random.Random(3)
    data = []
    for minute in range(4):
        for session in range(6):
            if rnd.random() < 0.8:
                start = NOW if session != 2 or minute < 2 else NOW + dt.timedelta(minutes=2)
                values = [rnd.randrange(50) + 20 * minute for _ in range(11)]
                data.append((1, NOW + dt.timedelta(minutes=minute, milliseconds=minute * minute), session, 0, start, *values))
    write_parts(spark, frame, schema, data, f"{tmp_path}/in", 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    delta_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/c")
    names = [f"{m}_delta" for m in deltas.METRICS]
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "collection_time", "session_id", *names)
    assert got == rows(deltas.session_deltas(frame(schema, data)), "collection_time", "session_id", *names)


def test_samples_are_not_dealt_by_collection(spark):
    """A fleet has few collections at a time: dealt by them, all samples would share a few tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        id_ = F.col("id")
        samples = spark.range(100_000).select(
            (id_ % 2).alias("server_id"), F.timestamp_seconds(1_700_000_000 + id_ % 3 * 60).alias("collection_time"), id_.alias("session_id"), F.lit(0).alias("request_id"),
            F.lit(NOW).alias("last_request_start_time"), *[id_.alias(m) for m in deltas.METRICS],
        )
        plan = deltas.session_deltas(samples)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_poll_of_many_files_is_one_batch(frame, rows, spark, tmp_path):
    schema = TELEMETRY["snapshots"]
    late = dt.timedelta(minutes=5)
    data = [(1, NOW + dt.timedelta(minutes=m), s, 0, NOW, *[10 * m + s] * 11) for m in range(3) for s in range(20)]
    for m in (2, 0, 1):
        part = frame(schema, [d for d in data if d[1] == NOW + dt.timedelta(minutes=m)]).repartition(3, "session_id")
        streams._arrive(part, f"{tmp_path}/in", lambda s: delta_batches(s, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/c", lateness=late))
    names = [f"{m}_delta" for m in deltas.METRICS]
    assert spark.read.parquet(f"{tmp_path}/out").select("batch_id").distinct().count() == 3
    got = rows(read_deltas(spark, f"{tmp_path}/out"), "collection_time", "session_id", *names)
    assert got == rows(deltas.session_deltas(frame(schema, data)), "collection_time", "session_id", *names)
