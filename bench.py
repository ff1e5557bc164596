"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is run to the end
(every row is produced) with the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tickloom.plans import all_queries
from tickloom.session import local_session

HEADLINE = [
    "a1_ohlc_bars", "a2_quote_bars_continuity", "a3_bar_resample", "a5_quote_structure", "a5_spread_by_hour_and_block", "a6_return_structure",
    "w4_atr", "w6_donchian_breakout", "j1_latest_known_quote", "j9_quote_book", "j10_open_quantity", "x4_forward_outcomes", "a9_outcome_aggregate",
    "x10_first_touch_exit", "x15_mark_to_market", "a7_summary_with_unknowns", "a12_daily_net", "a14_cost_bridge", "w10_drawdown", "a36_window_statistics",
    "x11_trade_pnl", "a27_daily_bootstrap", "a29_ratio_bootstrap", "d1_first_copy_wins", "s1_csv_import", "t1_stream_bars",
    "j2_price_selection", "w11_dependency_groups", "x1_trend_pullback", "x13_position_book",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tickloom-bench")
    available = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
