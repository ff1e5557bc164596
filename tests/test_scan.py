"""Ordered scans against plain loops, with one key that holds most of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import scan as S
from tickloom.operators.book import _apply, quote_book


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        # a third of all rows share one instant; the id alone separates them
        t = 500 if rng.random() < 0.33 else rng.randrange(1000)
        v = None if rng.random() < 0.1 else rng.randrange(-50, 50)
        data.append((key, t, i, v))
    return data, spark.createDataFrame(data, "k string, t int, id int, v int")


def test_ranges_stay_even_under_skew(skewed):
    _, df = skewed
    sizes = [r["count"] for r in S.range_chunks(df, ["k"], ["t", "id"], 8).groupBy("_chunk").count().collect()]
    assert max(sizes) < 1500 / 3


def test_running_aggregates_match_a_loop(skewed):
    data, df = skewed
    keys, order = ["k"], ["t", "id"]
    out = S.running(S.range_chunks(df, keys, order, 8), keys, order, {
        "s": S.run_sum("v"), "n": S.run_count("v"), "hi": S.run_max("v"), "lo": S.run_min("v"), "last": S.run_last("v"),
    })
    got = {r["id"]: (r["s"], r["n"], r["hi"], r["lo"], r["last"]) for r in out.collect()}
    state: dict = {}
    for k, _, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        s, n, hi, lo, last = state.get(k, (None, 0, None, None, None))
        if v is not None:
            s, n = (s or 0) + v, n + 1
            hi, lo, last = v if hi is None else max(hi, v), v if lo is None else min(lo, v), v
        state[k] = (s, n, hi, lo, last)
        assert got[i] == state[k]


def test_neighbours_cross_range_edges(skewed):
    data, df = skewed
    keys, order = ["k"], ["t", "id"]
    chunked = S.range_chunks(df, keys, order, 8)
    prev = {r["id"]: r["p"] for r in S.neighbour(chunked, keys, order, {"p": "id"}).collect()}
    nxt = {r["id"]: r["p"] for r in S.neighbour(chunked, keys, order, {"p": "id"}, following=True).collect()}
    ordered = sorted(data, key=lambda r: (r[0], r[1], r[2]))
    for a, b in zip(ordered, ordered[1:]):
        same = a[0] == b[0]
        assert prev[b[2]] == (a[2] if same else None)
        assert nxt[a[2]] == (b[2] if same else None)


@pytest.mark.parametrize("interpolate", [True, False])
def test_exact_quantiles(skewed, interpolate):
    data, df = skewed
    out = S.exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, interpolate=interpolate)
    method = "linear" if interpolate else "inverted_cdf"
    for r in out.collect():
        values = [d[3] for d in data if d[0] == r["k"] and d[3] is not None]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.quantile(values, [0.05, 0.5, 0.95], method=method)))


def test_quote_book_folded_in_parallel_is_exact(spark):
    rng = random.Random(3)
    updates = [("x" if rng.random() < 0.8 else "y", i, rng.choice(["bid", "ask"]), float(rng.randrange(90, 110)), 1000 + i + rng.randrange(-5, 5)) for i in range(800)]
    df = spark.createDataFrame(updates, "k string, arrival int, side string, price double, us bigint")
    got = {r["arrival"]: (r["bid"], r["ask"], r["status"]) for r in quote_book(df, ["k"], "arrival").collect()}
    held: dict = {}
    for k, n, side, price, us in updates:
        held[k], status = _apply(held.get(k, (None,) * 4), side, price, us)
        assert got[n] == (held[k][0], held[k][1], status)
    assert {s for _, _, s in got.values()} == {"APPLIED", "OUT_OF_ORDER", "CROSSED"}


def test_fold_sorted_keeps_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")

    def step(state, batch):
        total = state or 0
        out = []
        for v in batch["id"]:
            total += v
            out.append(total)
        return total, batch.assign(total=out)

    try:
        rows = S.fold_sorted(df, ["k"], ["id"], step, "k bigint, id bigint, total bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r["total"] for r in rows if r["k"] == 0) == sum(range(0, 100, 2))


def test_pinned_rows_live_in_the_configured_folder(spark):
    from tickloom import session

    root = session.checkpoint_root(spark)
    assert spark.conf.get("spark.checkpoint.dir") == root
    pinned = session.pin(spark.range(10))
    assert all(f.split("://")[-1].lstrip("/").startswith(root.split("://")[-1].lstrip("/")) or root in f for f in pinned.inputFiles())
    assert pinned.count() == 10


def test_shuffles_widen_with_the_stored_input_and_come_back(spark, tmp_path, monkeypatch):
    from tickloom import session

    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session, "BYTES_PER_TASK", max(1, session.stored_bytes(spark, path) // 40))
    try:
        session.fit_input(spark)
        session.fit_input(spark, path)
        session.fit_input(spark, path)  # read twice, counted once
        assert 40 <= session.shuffle_width(spark) <= 42
        session.fit_input(spark)
        assert spark.conf.get("spark.sql.shuffle.partitions") == own
        spark.conf.set("spark.sql.shuffle.partitions", "90")  # a wider setting of the user stays
        session.fit_input(spark, path)
        assert session.shuffle_width(spark) == 90
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
        session.fit_input(spark)
