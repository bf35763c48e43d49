"""Evaluation in physical units."""

import numpy as np
import pytest

from fieldspark.operators import stats


def test_physical_and_improvements(spark):
    r = np.random.default_rng(1)
    ref, rec = r.random((2, 30)), r.random((2, 30))
    rows = [(k, c, float(rec[k, i] * (1 if c == "plain" else 0.5) + (0 if c == "plain" else ref[k, i] * 0.5)), float(ref[k, i])) for k in range(2) for i in range(30) for c in ("plain", "half")]
    params = spark.createDataFrame([(0, 10.0, 30.0, 0.0, 1.0, 30.0), (1, -5.0, 5.0, 0.0, 1.0, 5.0)], "k int, lo double, hi double, mean double, std double, most double")
    pairs = spark.createDataFrame(rows, "k int, name string, rec double, ref double")
    got = {x["name"]: x for x in stats.improvements(stats.physical(pairs, params, "minmax", ["k"], ["name"]), "name", "plain").collect()}
    gap = np.concatenate([(rec[0] - ref[0]) * 20, (rec[1] - ref[1]) * 10])
    assert got["plain"]["rmse"] == pytest.approx(np.sqrt((gap**2).mean())) and got["plain"]["mae"] == pytest.approx(np.abs(gap).mean())
    assert got["half"]["improvement"] == pytest.approx(50) and got["plain"]["improvement"] == 0
    with pytest.raises(ValueError):
        stats.physical(pairs.limit(0), params, "minmax", ["k"], ["name"])
