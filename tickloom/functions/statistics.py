"""Normal distribution, sharp ratios and a reproducible hash-based sampler."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import C, col

EULER_GAMMA = 0.5772156649015329
_UNIT = NormalDist()


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else 0.5 * (1.0 + math.erf(v / math.sqrt(2.0))))


def expected_max_normal(count: int) -> float:
    """Expected maximum of ``count`` standard normals (the usual two-quantile mix)."""
    if count <= 1:
        return 0.0
    a, b = _UNIT.inv_cdf(1.0 - 1.0 / count), _UNIT.inv_cdf(1.0 - 1.0 / (count * math.e))
    return (1.0 - EULER_GAMMA) * a + EULER_GAMMA * b


def psr_statistic(sharpe: C, benchmark: C, n: C, skew: C, kurtosis: C) -> Column:
    """Argument of the normal distribution in the probabilistic Sharpe ratio."""
    s, b = col(sharpe), col(benchmark)
    spread = F.lit(1.0) - col(skew) * s + (col(kurtosis) - 1.0) / 4.0 * s * s
    return F.when((col(n) >= 3) & (spread > 0), (s - b) * F.sqrt(col(n) - 1) / F.sqrt(spread))


def draw(seed: int, *parts: Column, below: Column) -> Column:
    """Uniform index in [0, below) from a hash of the seed and the given numbers.

    A pure function of its inputs: a retried task draws the same sample.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint"), below.cast("bigint"))
