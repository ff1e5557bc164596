"""Imports, idempotent writes, cursors and stream guards."""

import pytest
from pyspark.sql import functions as F

from helpers import at, bars, ticks
from tickloom.operators import paging as P
from tickloom.session import scratch_path
from tickloom.sources import delimited, tables
from tickloom.streaming import bars as SB
from tickloom.streaming.support import ConfigMismatch, guard_checkpoint, run_available


@pytest.fixture
def csv(spark):
    path = scratch_path(spark, "csv")
    lines = ["when,sym,px", "2024-01-01T00:00:00Z,A,1.5", "2024-01-01T00:00:01,A,2.5", "2024-01-01T00:00:02Z,A,abc", "2024-01-01T00:00:03Z,,4", "2024-01-01T00:00:00Z,A,1.5"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


MAPPING = {"event_time": "when", "instrument": "sym", "price": "px"}


def test_import_quarantines_with_reasons(spark, csv):
    policy = delimited.ImportPolicy(MAPPING, identity=("instrument", "event_time"))
    got = delimited.import_csv(spark, csv, policy)
    assert [(r["instrument"], r["price"]) for r in got.rows.collect()] == [("A", 1.5)]
    codes = sorted(r["code"] for r in got.issues.collect())
    assert codes == ["duplicate", "missing:instrument", "parse_error:event_time", "parse_error:price"]
    assert tuple(got.provenance.first()) == (5, 2, 3)


def test_naive_time_needs_a_zone(spark, csv):
    policy = delimited.ImportPolicy(MAPPING, identity=("instrument", "event_time"), assume_timezone="America/New_York")
    times = {r["event_time"] for r in delimited.import_csv(spark, csv, policy).rows.collect()}
    assert at(1 + 5 * 3600) in times


def test_strict_import_refuses(spark, csv):
    with pytest.raises(delimited.ImportRejected):
        delimited.import_csv(spark, csv, delimited.ImportPolicy(MAPPING, identity=("instrument", "event_time"), strict=True))


def test_disorder_and_copies_are_judged_by_policy(spark):
    path = scratch_path(spark, "csv")
    lines = ["when,sym,px,n", "2024-01-01T00:00:05Z,A,1,1", "2024-01-01T00:00:01Z,A,2,2", "2024-01-01T00:00:01Z,A,2,2"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    base = dict(mapping={**MAPPING, "seq": "n"}, identity=("instrument", "event_time"), sequence="seq")
    lenient = delimited.import_csv(spark, path, delimited.ImportPolicy(**base, strict=True))
    assert lenient.rows.count() == 2
    assert sorted((r["code"], r["severity"]) for r in lenient.issues.collect()) == [("duplicate", "WARNING"), ("out_of_order", "WARNING")]
    for change in ({"reorder": False}, {"drop_duplicates": False}):
        with pytest.raises(delimited.ImportRejected):
            delimited.import_csv(spark, path, delimited.ImportPolicy(**base, strict=True, **change))


def test_consumers_see_every_batch(spark):
    from tickloom.plugins import fan_out

    class Counter:
        def __init__(self):
            self.seen = []

        def consume(self, signals, batch_id):
            self.seen.append((batch_id, signals.count()))

    path, both = scratch_path(spark, "in"), [Counter(), Counter()]
    spark.range(5).write.parquet(path)
    run_available(spark.readStream.schema("id bigint").parquet(path), path + "-cp", each=fan_out(both))
    assert both[0].seen == both[1].seen == [(0, 5)]


def test_warm_up_batches_emit_no_signals(spark):
    from tickloom.streaming.jobs import SignalJob

    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    parts = [bars(spark, [10] * 25 + [50]), bars(spark, [60], start=26 * 60)]
    job = SignalJob(spark, out, parts[0].schema, emit_from=1)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
        run_available(spark.readStream.schema(p.schema).parquet(path), out + "-cp", each=job)
    assert [(r["direction"], r["detected_at"]) for r in job.signals.read().collect()] == [("UP", at(27 * 60))]


def test_append_is_idempotent_and_detects_conflicts(spark):
    path = scratch_path(spark, "table")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        tables.append_new(spark, path, df, ["k"], ["v"])
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(tables.WriteConflict):
        tables.append_new(spark, path, df.withColumn("v", F.lit("z")), ["k"], ["v"])


def test_range_scan_prunes_months(spark):
    path = scratch_path(spark, "months")
    tables.write_by_month(ticks(spark, [("A", 86400 * 20 * i, 1.0) for i in range(6)]).drop("quality_flags"), path)
    scan = tables.range_scan(spark.read.parquet(path), "2024-01-15", "2024-02-20")
    assert scan.count() == 2
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(event_time)" in plan


def test_pages_walk_the_whole_table(spark):
    df = ticks(spark, [("A", i // 3, float(i)) for i in range(20)])
    spec = P.PageSpec("ticks", "event_time", "seq", 6, descending=True)
    seen, cursor = [], None
    while True:
        got = P.fetch(df, spec, cursor)
        seen += [r["seq"] for r in got.rows]
        cursor = got.next_cursor
        if cursor is None:
            break
    assert seen == list(range(19, -1, -1)) and got.total == 20
    back = P.encode_cursor(spec, int(df.where("seq = 10").select(F.unix_micros("event_time")).first()[0]), 10, "before")
    assert [r["seq"] for r in P.page(df, spec, back).collect()] == [11, 12, 13, 14, 15, 16, 17]
    with pytest.raises(P.CursorMismatch):
        P.fetch(df, P.PageSpec("bars", "event_time", "seq", 6), back)


def test_checkpoint_refuses_another_configuration(spark):
    root = scratch_path(spark, "guard")
    assert guard_checkpoint(spark, root, {"n": 1}) == guard_checkpoint(spark, root, {"n": 1})
    with pytest.raises(ConfigMismatch):
        guard_checkpoint(spark, root, {"n": 2})


def test_stream_bars_equal_batch_and_keep_late_rows_out(spark):
    from tickloom.operators.bars import tick_bars

    path = scratch_path(spark, "in")
    first = ticks(spark, [("A", s, float(s)) for s in (0, 30, 70, 4000, 9000)])
    late = ticks(spark, [("A", 40, 99.0), ("A", 9100, 1.0), ("A", 20000, 1.0)]).withColumn("event_id", F.concat(F.lit("x"), "event_id"))
    sink = scratch_path(spark, "sink")
    for part in (first, late):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = SB.stream_bars(spark.readStream.schema(first.schema).parquet(path), 60, "1 minute")
        run_available(stream, sink + "-cp", sink=sink)
    got = {r["start"]: (r["open"], r["close"]) for r in spark.read.parquet(sink).collect()}
    want = {r["start"]: (r["open"], r["close"]) for r in tick_bars(first, 60).collect()}
    for start in (at(0), at(60), at(3960), at(9000)):
        assert got[start] == want[start]
    assert 99.0 not in {v for pair in got.values() for v in pair}


def test_late_rows_are_recorded(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    parts = [ticks(spark, [("A", 0, 1.0), ("A", 200, 1.0)]), ticks(spark, [("A", 10, 5.0), ("A", 201, 6.0)])]
    recorder = SB.LateRecorder(spark, out, 60, parts[0].schema, ["available_at", "event_id"])
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
        run_available(spark.readStream.schema(p.schema).parquet(path), out + "-cp", each=recorder)
    assert [(r["price"], r["issue"]) for r in recorder.late.read().collect()] == [(5.0, "late_closed_interval")]
    assert recorder.on_time.read().count() == 3


def test_calendar_closure_joins_bars_over_a_weekend(spark):
    from tickloom.operators.indicators import warmup_segments

    friday = bars(spark, [1], tf=3600, start=4 * 86400 + 21 * 3600)
    sunday = bars(spark, [2], tf=3600, start=6 * 86400 + 22 * 3600)
    df = friday.unionByName(sunday)
    assert [r["eligible"] for r in warmup_segments(df).orderBy("start").collect()] == [True, False]
    assert [r["eligible"] for r in warmup_segments(df, use_calendar=True).orderBy("start").collect()] == [True, True]


def test_line_numbers_of_splittable_text(spark, tmp_path):
    lines = {f"f{k}.txt": [f"20240102 0304050{i % 10:02},1.1,1.2,{'-1' if i == 5 else 0}" for i in range(n)] for k, n in enumerate((400, 1, 57))}
    lines["f1.txt"] = ["20240102 030405000,1.1,1.2"]
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = delimited.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        want = [(f, i + 1, v) for f in sorted(lines) for i, v in enumerate(lines[f])]
        assert [(r.file, r.line, r.value) for r in got.orderBy("sequence").collect()] == want
        assert [r.sequence for r in got.orderBy("file", "line").collect()] == list(range(1, len(want) + 1))
        read = delimited.read_fixed_ticks(spark, str(tmp_path), "X")
        ids = [r.source_event_id for r in read.rows.collect()]
        assert len(ids) == len(set(ids)) == len(want) - 3
        assert {(r.code, r._file, r.line) for r in read.issues.collect()} >= {("volume_invalid", "f0.txt", 6), ("volume_invalid", "f2.txt", 6), ("fields_invalid", "f1.txt", 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_price_of_zero_is_refused_unless_it_is_a_quote(spark, tmp_path):
    (tmp_path / "f.txt").write_text("20240102 030405000,0.00,0.01,0\n20240102 030405001,-0.01,0.01,0\n20240102 030405002,1.1,1.2,0\n")
    plain = delimited.read_fixed_ticks(spark, str(tmp_path), "X")
    assert sorted(float(r.bid) for r in plain.rows.collect()) == [1.1]
    kept = delimited.read_fixed_ticks(spark, str(tmp_path), "X", zero_prices=True)
    assert sorted((float(r.bid), r.sequence) for r in kept.rows.collect()) == [(0.0, 1), (1.1, 3)]
    assert [(r.code, r.line) for r in kept.issues.collect()] == [("price_invalid", 2)]
