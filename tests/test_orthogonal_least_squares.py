from decimal import Decimal, getcontext

import numpy as np
import pytest

from fieldspark.models.least_squares import ols
from fieldspark.models.qr import merged_factor, ols_qr

SCHEMA = "g string, Year int, Year2 double, y double"


def exact(rows):
    """Normal equations in 50 digits, by elimination."""
    getcontext().prec = 50
    x = [[Decimal(1), Decimal(a), Decimal(a) * Decimal(a)] for _, a, _, _ in rows]
    y = [Decimal(v) for *_, v in rows]
    m = [[sum(r[i] * r[j] for r in x) for j in range(3)] + [sum(r[i] * v for r, v in zip(x, y))] for i in range(3)]
    for i in range(3):
        for k in range(i + 1, 3):
            f = m[k][i] / m[i][i]
            m[k] = [a - f * b for a, b in zip(m[k], m[i])]
    beta = [Decimal(0)] * 3
    for i in (2, 1, 0):
        beta[i] = (m[i][3] - sum(m[i][j] * beta[j] for j in range(i + 1, 3))) / m[i][i]
    rss = sum((v - sum(b * c for b, c in zip(beta, r))) ** 2 for r, v in zip(x, y))
    return [float(b) for b in beta], float(rss)


def raw_years(seed, n=400):
    rng = np.random.Generator(np.random.PCG64(seed))
    return [("a" if i % 3 else "b", int(t), float(t) * int(t), float(5 + 0.3 * (t - 2015) - 0.02 * (t - 2015) ** 2 + rng.normal())) for i, t in enumerate(rng.integers(2009, 2022, n))]


def test_raw_years_keep_their_digits(spark):
    rows = raw_years(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r["g"], r["term"]): r for r in ols_qr(df, "y", ["Year", "Year2"], by=["g"]).collect()}
    moments = {(r["g"], r["term"]): r["estimate"] for r in ols(df, "y", ["Year", "Year2"], by=["g"]).collect()}
    lost = 0.0
    for g in ("a", "b"):
        beta, rss = exact([r for r in rows if r[0] == g])
        for term, b in zip(("Intercept", "Year", "Year2"), beta):
            assert got[g, term]["estimate"] == pytest.approx(b, rel=1e-8)
            lost = max(lost, abs(moments[g, term] / b - 1))
        assert got[g, "Year"]["rss"] == pytest.approx(rss, rel=1e-9) and got[g, "Year"]["n"] == sum(r[0] == g for r in rows)
    assert lost > 1e-8


def test_equals_moments_where_those_are_good(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(("a", "b", None)[i % 3], int(rng.integers(-3, 4)), float(rng.normal()), float(rng.normal())) for i in range(300)] + [("a", None, 1.0, 2.0), ("c", 1, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for by in ([], ["g"]):
        key = lambda r: (str(r["g"]) if by else "", r["term"])
        got = {key(r): r for r in ols_qr(df, "y", ["Year", "Year2"], by=by).collect()}
        want = {key(r): r for r in ols(df, "y", ["Year", "Year2"], by=by).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            for c in ("estimate", "std_error", "statistic", "n", "df_residual", "sigma2", "rss"):
                assert r[c] == pytest.approx(want[k][c], rel=1e-9)


def test_columns_that_depend_on_others_and_few_rows(spark):
    rows = [("a", 1, 2.0, 1.0), ("a", 2, 4.0, 2.0), ("a", 3, 6.0, 2.5), ("a", 4, 8.0, 4.5), ("one", 1, 5.0, 3.0)]
    got = {(r["g"], r["term"]): r for r in ols_qr(spark.createDataFrame(rows, SCHEMA), "y", ["Year", "Year2"], by=["g"]).collect()}
    assert got["a", "Year"]["df_residual"] == 2 and got["a", "Year"]["estimate"] + 2 * got["a", "Year2"]["estimate"] == pytest.approx(1.1)
    assert got["one", "Year"]["df_residual"] == 0 and got["one", "Year"]["rss"] == pytest.approx(0, abs=1e-20)
    assert ols_qr(spark.createDataFrame([], SCHEMA), "y", ["Year"], by=["g"]).count() == 0


def test_factors_merge_in_any_order():
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(50, 4))
    whole = merged_factor(x)
    parts = merged_factor(np.vstack([merged_factor(x[20:]), merged_factor(x[:2]), merged_factor(x[2:20])]))
    assert np.allclose(whole, parts, atol=1e-12) and np.allclose(whole.T @ whole, x.T @ x)
