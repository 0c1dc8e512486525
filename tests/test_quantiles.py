"""Exact quantiles and tests of significance."""

import math

import numpy as np
import pytest
from maskframe.operators import metrics
from pyspark.sql import functions as F


@pytest.mark.parametrize("kind", ["normal", "ties", "outlier", "infinite", "huge", "few"])
def test_quantiles_equal_linear_interpolation(spark, kind):
    rng = np.random.default_rng(7)
    values = {"normal": rng.normal(size=4001), "ties": rng.integers(0, 3, 2000).astype(float), "outlier": np.append(rng.random(3000), 1e300),
              "infinite": np.concatenate([rng.random(50), [-np.inf] * 5, [np.inf] * 9]), "huge": (rng.random(500) - 0.5) * 1.6e308 * 2, "few": np.array([2.0, 5.0])}[kind]
    groups = [None if i % 3 == 0 else f"g{i % 3}" for i in range(len(values))]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values, strict=True)] + [("g1", None), ("none", None), ("g1", math.nan)], "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.value for r in metrics.quantiles(df, "v", probs, ["g"]).collect()}
    assert len(got) == len(probs) * len(set(groups))
    for g in set(groups):
        own = np.sort([v for h, v in zip(groups, values, strict=True) if h == g])
        for p in probs:
            at = p * (len(own) - 1)
            lo, hi, part = own[int(at)], own[min(int(at) + 1, len(own) - 1)], at - int(at)
            want = lo if part == 0 or lo == hi else lo * (1 - part) + hi * part
            assert got[g, p] == pytest.approx(want, rel=1e-12)
    whole = {r.prob: r.value for r in metrics.quantiles(df, "v", [0.0, 1.0]).collect()}
    assert whole == {0.0: values.min(), 1.0: values.max()}


def test_quantiles_of_nothing(spark):
    assert metrics.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).count() == 0


def test_p_value_follows_erfc(spark):
    z = [0.0, 0.1, -1.0, 1.959963984540054, 3.0, 6.7837, -10.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(metrics.p_value(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([metrics.two_sided_p(x) for x in z], rel=2e-7)
