"""Quantiles by narrowing ranges equal those of a full sort, whatever the values look like."""

import numpy as np
import pytest

from lodestar.operators import index as I

SHARES = [i / 16 for i in range(1, 16)] + [(i + 0.5) / 16 for i in range(16)] + [0.0, 1.0]


def _values(kind):
    rng = np.random.default_rng(7)
    n = 40_000
    return {
        "normal": rng.normal(size=n) * 0.1,
        "heavy": rng.standard_cauchy(n) * 10.0 ** rng.integers(-30, 30, n),
        "ties": rng.integers(0, 5, n).astype(float),
        "one": np.full(n, 0.25),
        "hot": np.r_[np.full(n // 3, 0.5), rng.normal(size=n - n // 3)],
        "few": np.array([3.0, -1.0, 2.0, 2.0]),
        "single": np.array([1.5]),
    }[kind]


@pytest.mark.parametrize("gathered", [1 << 16, 0])
@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "one", "hot", "few", "single"])
def test_quantiles_equal_a_sort(spark, monkeypatch, kind, gathered):
    monkeypatch.setattr(I, "RANGE_VALUES", gathered)      # 0: counting passes alone
    if gathered == 0 and kind == "heavy":
        monkeypatch.setattr(I, "RANGE_VALUES", 64)
    x = _values(kind)
    rows = spark.createDataFrame([([float(v) for v in part],) for part in np.array_split(x, min(len(x), 50))] + [([],)], "r array<double>")
    got = I._quantiles(rows.repartition(5), SHARES)
    assert np.allclose(got, np.quantile(x, SHARES), rtol=1e-12, atol=0)


def test_no_sort_of_values(spark, monkeypatch):
    """What is shuffled and gathered are counts of bins, not values."""
    seen = []
    real = I._count_bins
    monkeypatch.setattr(I, "_count_bins", lambda *a: seen.append(real(*a)) or seen[-1])
    x = np.random.default_rng(1).normal(size=60_000)
    rows = spark.createDataFrame([([float(v) for v in part],) for part in np.array_split(x, 60)], "r array<double>")
    assert np.allclose(I._quantiles(rows, SHARES), np.quantile(x, SHARES))
    assert 1 <= len(seen) <= 3 and all(len(b) <= len(SHARES) * 2 * I.RANGE_BINS for b in seen)


def test_no_values(spark):
    with pytest.raises(ValueError):
        I._quantiles(spark.createDataFrame([], "r array<double>"), [0.5])
