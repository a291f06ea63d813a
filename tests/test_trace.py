"""Traces and features against a NumPy restatement, and the edge rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytrace.operators import features as FT
from skytrace.operators import trace as TR


def fill(x):
    i = np.flatnonzero(~np.isnan(x))
    return x if not len(i) else np.interp(np.arange(len(x)), i, x[i])


def smooth(x, kernel=7):
    y, h = fill(x), kernel // 2
    if np.isnan(y).all():
        return y
    p = np.concatenate([[y[0]] * h, y, [y[-1]] * h])
    m = np.array([np.median(p[i : i + kernel]) for i in range(len(y))])
    return np.where(np.isnan(x), np.nan, m)


def traces(rng):
    rows, want = [], {}
    for c in range(25):
        n = int(rng.integers(1, 60))
        x = rng.normal(size=n) * 100
        x[rng.random(n) < rng.choice([0, 0.3, 0.9, 1.0])] = np.nan
        name = None if c == 24 else str(c)
        rows += [(name, t, None if np.isnan(v) else float(v)) for t, v in enumerate(x.tolist())]
        want[name] = smooth(x)
    return rows, want


@pytest.mark.parametrize("size", [{}, {"cell": 3, "cells": 1}, {"cell": 3, "cells": 2}, {"cell": 5, "cells": 4, "length": "n_slices"}, {"length": "n_slices", "longest": 60}])
def test_smoothing_equals_numpy(spark, size):
    rows, want = traces(np.random.default_rng(3))
    df = spark.createDataFrame([(*r, len(want[r[0]])) for r in rows], "capture_id string, t_idx long, trace_hz double, n_slices long")
    got = TR.smooth(df, **size).orderBy("capture_id", "t_idx").collect()
    assert len(got) == len(rows)
    for c, w in want.items():
        mine = [r for r in got if r["capture_id"] == c]
        assert np.allclose([math.nan if r["smoothed"] is None else r["smoothed"] for r in mine], w, equal_nan=True)
        finite = w[~np.isnan(w)]
        assert np.allclose([r["jump"] for r in mine if r["jump"] is not None], np.diff(finite))


def test_blocks_of_a_long_capture_fill_gaps_longer_than_a_block(spark):
    points = {7: 1.0, 8: 5.0, 90: 46.0, 91: 40.0}
    rows = [("a", t, points.get(t)) for t in range(120)]
    got = TR.smooth(spark.createDataFrame(rows, "capture_id string, t_idx long, trace_hz double"), cell=3, cells=2).orderBy("t_idx").collect()
    x = np.array([math.nan if v is None else v for _, _, v in rows])
    assert np.allclose([r["filled"] for r in got], fill(x))
    assert np.allclose([r["smoothed"] for r in got if r["smoothed"] is not None], smooth(x)[sorted(points)])
    assert np.allclose([r["jump"] for r in got if r["jump"] is not None], np.diff(smooth(x)[sorted(points)]))


def slices(spark, rows):
    return spark.createDataFrame([(c, t, float(t), p) for c, t, p in rows], "capture_id string, t_idx long, time_s double, power_db array<double>")


def test_first_of_equal_bins_and_nan(spark):
    got = TR.strongest(slices(spark, [("a", 0, [1.0, 9.0, 9.0, 2.0]), ("a", 1, [1.0, math.nan, 3.0, 2.0]), ("a", 2, [0.0, 0.0, 6.0, 0.0])]), 6.0, 100.0, 10.0).orderBy("t_idx").collect()
    assert got[0]["bin"] == 1 and not got[1]["valid"]
    assert got[2]["valid"] and got[2]["trace_hz"] == 120.0 and got[2]["width_hz"] == 0.0  # inclusive; one bin is 0 wide


def test_capture_without_signal(spark):
    f = FT.detect(FT.slice_features(slices(spark, [("a", t, [1.0, 1.0, 1.0]) for t in range(4)]), 6.0, 0.0, 1.0)).first()
    assert f["frequency_drift_hz"] == 0 and f["smoothness_score"] == math.inf and f["signal_duration_seconds"] == 0 and f["occupied_bandwidth_hz"] == 0
    assert not f["detected"] and f["notes"].endswith("trace too noisy") and f["confidence"] == 0


def test_drifting_ridge_is_detected(spark):
    rng = np.random.default_rng(123)
    m = rng.normal(-80, 2, (80, 128))
    m[np.arange(80), np.linspace(30, 90, 80).astype(int)] = -45
    f = FT.detect(FT.slice_features(slices(spark, [("a", t, r.tolist()) for t, r in enumerate(m)]), 8.0, 136.7e6, 200_000 / 127), 0.5, 10_000, 5_000).first()
    assert f["detected"] and f["valid_signal_ratio"] > 0.9 and f["snr_db"] > 0
    assert math.isclose(f["drift_rate_hz_per_second"], f["frequency_drift_hz"] / f["signal_duration_seconds"])
    assert math.isclose(f["peak_power"], m.max()) and math.isclose(f["mean_power"], m.mean())


def test_sanitising_and_unknown_feature(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (2.0,)], "snr_db double")
    assert [r[0] for r in FT.project_features(df, ("snr_db",)).collect()] == [-1e6, 1e6, -1e6, 2.0]
    with pytest.raises(ValueError):
        FT.project_features(df, ("nothing",))


@pytest.mark.parametrize("long_", [1 << 16, 20])
def test_long_form_of_any_slice(spark, monkeypatch, long_):
    """Medians of short slices by a percentile, of long ones by ranks, and where the longest is known."""
    monkeypatch.setattr(TR, "LONG", long_)
    rng = np.random.default_rng(4)
    rows = [(s, b, float(v)) for s, n in (("hot", 3001), ("even", 40), ("few", 4), ("one", 1)) for b, v in enumerate(np.round(rng.normal(size=n), 2))]
    rows += [("ends", b, v) for b, v in enumerate([float("inf"), float("-inf")] * 15 + [1.0])]
    df = spark.createDataFrame(rows, "s string, b int, p double")
    want = {s: ([r[2] for r in rows if r[0] == s]) for s in ("hot", "even", "few", "one", "ends")}
    for longest in (None, 3001):
        got = {r["s"]: (r["bin"], r["strongest_db"], r["noise_db"]) for r in TR.strongest_long(df, "s", "b", "p", longest).collect()}
        assert got == {s: (int(np.argmax(v)), max(v), float(np.median(v))) for s, v in want.items()}
