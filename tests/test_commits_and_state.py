"""Commit logs, snapshot tables, consumers, and keyed stream state against batch results."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import EPOCH, at
from tickloom.operators import outcomes
from tickloom.session import scratch_path
from tickloom.sources.commits import AppendTable, CommitLog, SnapshotTable
from tickloom.sources.tables import WriteConflict
from tickloom.streaming import bars as SB
from tickloom.streaming.pending import pending_outcomes
from tickloom.streaming.support import run_available


def test_a_number_is_committed_once(spark):
    log, other = (CommitLog(spark, path) for path in [scratch_path(spark, "log")] * 2)
    assert log.latest() == -1
    assert log.commit(0, {"x": "é"}) and not other.commit(0, {"x": 2})
    assert other.latest() == 0 and other.read(0) == {"x": "é"}
    assert other.commit(1, {}) and log.latest() == 1


def test_two_writers_append_a_key_once(spark):
    path, schema = scratch_path(spark, "append"), "k long, v string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)

    class Overtaken(CommitLog):
        rival = [(2, "b"), (3, "c")]

        def commit(self, number, content):
            if self.rival:
                rows, self.rival = self.rival, None
                assert AppendTable(spark, path, frame((0, "")).schema, ["k"]).append(frame(*rows)) == 2
            return super().commit(number, content)

    table = AppendTable(spark, path, frame((0, "")).schema, ["k"])
    assert table.append(frame((1, "a"), (1, "a"))) == 1 and table.append(frame((1, "a"))) == 0
    slow = AppendTable(spark, path, table.schema, ["k"], Overtaken(spark, path))
    assert slow.append(frame((1, "a"), (2, "b"), (4, "d"))) == 1
    assert sorted(map(tuple, table.rows().collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    slow.log.rival = [(5, "e")]
    Overtaken.rival = None
    with pytest.raises(WriteConflict):
        table.append(frame((6, "x"), (1, "changed")))
    with pytest.raises(WriteConflict):
        table.append(frame((7, "x"), (7, "y")))
    assert table.rows().count() == 4


def test_a_rival_with_another_payload_is_a_conflict(spark):
    path = scratch_path(spark, "append")
    schema = spark.createDataFrame([(0, "")], "k long, v string").schema

    class Overtaken(CommitLog):
        def commit(self, number, content):
            if number == 0 and self.latest() < 0:
                AppendTable(spark, path, schema, ["k"]).append(spark.createDataFrame([(1, "theirs")], schema))
            return super().commit(number, content)

    with pytest.raises(WriteConflict):
        AppendTable(spark, path, schema, ["k"], Overtaken(spark, path)).append(spark.createDataFrame([(1, "ours")], schema))


def test_snapshots_replace_touched_partitions_only(spark):
    path, schema = scratch_path(spark, "snap"), spark.createDataFrame([(0, "", 0)], "k long, p string, v int").schema
    table = SnapshotTable(spark, path, schema, ["k"], F.col("p"), F.col("v"))
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert table.read().count() == 0
    assert table.merge(frame((1, "a b", 1), (2, "c/d", 1), (3, None, 1)), 0)
    kept = dict(table.log.read(0)["parts"])
    assert table.merge(frame((1, "a b", 5), (1, "a b", 3), (4, "a b", 1)), 1)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, 5), (2, 1), (3, 1), (4, 1)]
    now = table.log.read(1)["parts"]
    assert now["c/d"] == kept["c/d"] and now[""] == kept[""] and now["a b"] != kept["a b"]
    assert not table.merge(frame((1, "a b", 9)), 1)  # the same delivery again
    assert table.log.latest() == 1 and table.merge(frame((2, "c/d", 0)), 2)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, 5), (2, 1), (3, 1), (4, 1)]


RULE = outcomes.Contract(latency_seconds=2, max_age_seconds=300, stake=10.0, payout=0.8, cost=0.1)


def market(seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(500):
        t += rng.choice([0.0, 1, 20, 200, 700])
        rows.append(("point", at(t + 3), rng.choice("AAAB"), None, None, None, at(t), at(t + 3), i, 100 + round(rng.uniform(-2, 2), 2)))
        if i % 9 == 0:
            rows.append(("signal", at(t), rng.choice("AABC"), f"s{i}", rng.choice(["UP", "DOWN"]), at(t), None, None, None, None))
    return rows


CAPTURE = "kind string, at timestamp, instrument string, signal_id string, direction string, detected_at timestamp, event_time timestamp, available_at timestamp, ordinal long, price double"


@pytest.mark.parametrize(("batches", "exit_rule", "horizon_from"), [
    (1, outcomes.BACKWARD, "entry"), (4, outcomes.BACKWARD, "entry"), (16, outcomes.BACKWARD, "detected"), (4, outcomes.FORWARD, "entry"),
])
def test_pending_outcomes_equal_batch(spark, batches, exit_rule, horizon_from):
    """Every run is a restart over the same checkpoint."""
    rule = outcomes.Contract(**{**RULE.__dict__, "exit_rule": exit_rule, "horizon_from": horizon_from})
    rows = sorted(market(batches), key=lambda r: r[1])
    path, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[("close", rows[-1][1] + timedelta(days=2), "", *[None] * 7)]]
    for own in parts:
        random.Random(1).shuffle(own)
        spark.createDataFrame(own, CAPTURE).write.mode("append").parquet(path)
        stream = pending_outcomes(spark.readStream.schema(CAPTURE).parquet(path), [600.0, 3600.0], rule)
        run_available(stream, sink + "-cp", sink=sink)
    names = ["simulation_id", "entry_price", "final_price", "outcome", "net", "entry_use_time", "expiry"]
    got = sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(sink).select(*names).collect()), key=repr)
    all_ = spark.createDataFrame(rows, CAPTURE)
    points = all_.where("kind = 'point'").select("instrument", "event_time", "available_at", "price", "ordinal", F.col("ordinal").cast("string").alias("point_id"))
    want = outcomes.label(all_.where("kind = 'signal'").select("signal_id", "instrument", "direction", "detected_at"), points, [600.0, 3600.0], rule)
    want = sorted((tuple(r) for r in want.select(*names).collect()), key=repr)
    assert got == want and {"WIN", "LOSS", "INDETERMINATE"} <= {r[3] for r in got}


def test_late_rows_do_not_depend_on_micro_batches(spark):
    rng = random.Random(8)
    rows = [(i, "A" if i % 3 else "B", at(60 * (i // 4) - rng.choice([0, 0, 0, 30, 500]))) for i in range(200)]
    newest, want = {}, set()
    for i, k, t in rows:
        start = (t - EPOCH).total_seconds() // 60
        if start < newest.get(k, start):
            want.add(i)
        newest[k] = max(newest.get(k, start), start)
    for batches in (1, 4, 16):
        path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
        size = -(-len(rows) // batches)
        recorder = None
        for lo in range(0, len(rows), size):
            part = spark.createDataFrame(rows[lo : lo + size], "arrival long, instrument string, event_time timestamp")
            recorder = recorder or SB.LateRecorder(spark, out, 60, part.schema)
            part.write.mode("append").parquet(path)
            run_available(spark.readStream.schema(part.schema).parquet(path), out + "-cp", each=recorder)
        assert {r.arrival for r in recorder.late.read().collect()} == want and want
        assert recorder.on_time.read().count() == len(rows) - len(want)
