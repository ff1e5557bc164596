"""Block bootstrap in tiles, its status, and comparable experiments."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import comparisons, inference


@pytest.mark.parametrize("tile", [50_000, 3])
def test_ratio_bootstrap_status_and_tiles(spark, monkeypatch, tile):
    """Bounds do not depend on how keys are tiled; keys with one block or without episodes are not assessed."""
    monkeypatch.setattr(inference, "TILE_VALUES", tile)
    rows = [(f"k{k}", b, float((b * 7 + k) % 5), 1 + (b + k) % 3) for k in range(6) for b in range(8)]
    rows += [("lone", 0, 1.0, 1)] + [("none", b, 0.0, 0) for b in range(8)] + [("same", b, 2.0, 1) for b in range(4)]
    blocks = spark.createDataFrame(rows, "key string, block long, total double, episodes long")
    got = {r.key: r for r in inference.ratio_bootstrap(blocks, ["key"], iterations=200, seed=7, alpha=0.05).collect()}
    assert {k for k, r in got.items() if r.status == "NOT_ASSESSED"} == {"lone", "none"}
    assert got["none"].resamples == 0 and got["lone"].blocks == 1 and got["none"].zero_blocks == 8
    assert got["same"].lower_bound == got["same"].mean == 2.0
    for k in range(6):
        own = [r for r in rows if r[0] == f"k{k}"]
        assert got[f"k{k}"].mean == pytest.approx(sum(r[2] for r in own) / sum(r[3] for r in own))
        assert min(r[2] / r[3] for r in own) <= got[f"k{k}"].lower_bound <= got[f"k{k}"].mean and got[f"k{k}"].resamples == 200
    seen = test_ratio_bootstrap_status_and_tiles.__dict__.setdefault("seen", {})
    assert seen.setdefault("bounds", {k: r.lower_bound for k, r in got.items()}) == {k: r.lower_bound for k, r in got.items()}


def test_comparisons_need_one_identity(spark):
    rows = [("a", "v1", "X", "h", 1), ("a", "v2", "X", "h", 2), ("b", "v1", "X", "h", 3), ("b", "v2", "Y", "h", 4), ("c", "v1", "X", None, 5), ("c", "v2", "X", "h", 6), ("d", "v1", None, "h", 7)]
    runs = spark.createDataFrame(rows, "comparison string, variant string, instrument string, hash string, net long")
    for strict in (True, False):
        got = {r.comparison: r for r in comparisons.compare(runs, ["comparison"], ["instrument", "hash"], "variant", ["net"], strict=strict).collect()}
        assert {k: (r.state, list(r.mismatches)) for k, r in got.items()} == {
            "a": ("COMPARED", []), "b": ("INCOMPATIBLE", ["instrument"]), "c": ("INCOMPATIBLE", ["hash"]), "d": ("COMPARED", []),
        }
        assert [tuple(x) for x in got["a"].side_by_side] == [("v1", 1), ("v2", 2)] and (got["a"].instrument, got["b"].instrument) == ("X", None)
        assert (got["b"].side_by_side is None) == strict
    assert comparisons.compare(runs.where(F.lit(False)), ["comparison"], ["hash"], "variant", ["net"]).count() == 0
