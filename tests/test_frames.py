"""Frames by running sums against frames summed directly."""

import math
import random

import pytest
from pyspark.sql import functions as F

from drillframe.operators import windows



def day():
    return F.floor(F.col("t") / 500)


def direct(values, n):
    """Mean and sample deviation of the n values before each, in whole precision."""
    out = []
    for i in range(len(values)):
        frame = [v for v in values[max(0, i - n) : i] if v is not None]
        mean = math.fsum(frame) / len(frame) if frame and all(map(math.isfinite, frame)) else sum(frame) / len(frame) if frame else None
        spread = None
        if len(frame) > 1:
            spread = math.sqrt(math.fsum((v - mean) ** 2 for v in frame) / (len(frame) - 1)) if math.isfinite(mean) else math.nan
        out.append((mean, spread))
    return out


def made(spark, series, n, block, seed=0):
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    out = windows.prior_rows(df, ["k"], ["t"], {"m": ("v", n)}, {"s": ("v", n)}, {"lag": ("v", n)}, "rn", block)
    assert out.columns == ["k", "t", "v", "m", "s", "lag", "rn"]
    return {(r.k, r.t): r for r in out.collect()}


def compare(got, series, n, scale=1e-12):
    assert len(got) == sum(map(len, series.values()))
    for k, values in series.items():
        for i, (mean, spread) in enumerate(direct(values, n)):
            r = got[k, i]
            assert r.rn == i + 1 and r.lag == (values[i - n] if i >= n else None) or r.lag != r.lag
            for mine, want in ((r.m, mean), (r.s, spread)):
                assert (mine is None) == (want is None)
                if want is not None and not (math.isnan(want) and math.isnan(mine)):
                    assert mine == want or abs(mine - want) <= scale * max(1.0, abs(want)), (k, i, mine, want)


@pytest.fixture
def chunks(monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 256)


@pytest.mark.parametrize("n", [1, 7, 60, 300])
@pytest.mark.parametrize("blocks", [False, True])
def test_random_values_with_nulls(spark, chunks, n, blocks):
    rng = random.Random(n)
    series = {k: [None if rng.random() < 0.2 else rng.gauss(5, 3) for _ in range(size)] for k, size in (("a", 1700), ("b", 40), ("c", 1))}
    compare(made(spark, series, n, day() if blocks else None), series, n)


def test_values_that_are_not_finite(spark, chunks):
    rng = random.Random(3)
    odd = [math.nan, math.inf, -math.inf]
    series = {"a": [rng.choice(odd) if rng.random() < 0.02 else rng.gauss(0, 1) for _ in range(1500)], "b": [math.inf, math.inf, 1.0, math.nan, 2.0, None, -math.inf, 3.0, 4.0, 5.0]}
    compare(made(spark, series, 5, day()), series, 5)


def test_a_spike_spoils_no_later_frame(spark, chunks):
    rng = random.Random(4)
    series = {"a": [1e18 if i % 401 == 17 else -999.25 if i % 97 == 3 else rng.gauss(0, 1) for i in range(2000)]}
    got = made(spark, series, 20, day())
    for i, (mean, spread) in enumerate(direct(series["a"], 20)):
        if i > 1 and 1e18 not in series["a"][max(0, i - 20) : i]:
            assert abs(got["a", i].m - mean) < 1e-9 * max(1, abs(mean)) and abs(got["a", i].s - spread) < 1e-3 * spread


def test_equal_values_have_no_deviation_and_drift_is_kept(spark, chunks):
    series = {"a": [0.1 if i < 900 else 1234.5678 for i in range(1500)], "b": [900 + i * 0.37 + (i % 3) * 0.01 for i in range(1500)]}
    got = made(spark, series, 10, day())
    compare(got, series, 10, 1e-8)
    assert all(got["a", i].s == 0.0 for i in range(2, 1500) if not 900 < i < 910 + 1)


def test_no_plan_sums_a_frame_anew(spark):
    df = spark.range(10).selectExpr("'a' AS k", "id AS t", "id * 0.5D AS v")
    plan = windows.rolling(df, ["k"], ["t"], ["v"], block=day())._jdf.queryExecution().executedPlan().toString()
    assert "-60, -1" not in plan and "-10, -1" not in plan and "unboundedpreceding" in plan.lower()


def test_frames_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 16)
    series = {"a": [float(i % 13) for i in range(400)]}
    compare(made(spark, series, 100, day()), series, 100)
