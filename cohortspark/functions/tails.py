"""Tail probabilities.

``norm_sf2`` is a Column expression (two-sided normal p-value, double precision). The t and chi-square tails are
small pandas UDFs meant for result rows: a handful of rows per report, never the raw data.
"""

import math

import pandas as pd
from pyspark.sql import functions as F, types as T

# W. J. Cody's rational approximations of erf / erfc (Math. Comp. 23, 1969).
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03,
      1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02,
      8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03,
      2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
      3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
      6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2,
      2.33520497626869185e-3)
_SQRPI = 5.6418958354775628695e-1


def _poly(x, coefs):
    text = f"{coefs[0]!r}D"
    for c in coefs[1:]:
        text = f"(({text}) * {x} + {c!r}D)"
    return text


def norm_sf2_sql(z):
    """SQL text of the two-sided normal p-value erfc(|z| / sqrt 2); runs on Spark."""
    x = f"(abs({z}) / {math.sqrt(2)!r}D)"
    y = f"({x} * {x})"
    inv = f"(1D / {y})"
    low = f"(1D - {x} * ({_poly(y, (_A[4],) + _A[:4])}) / ({_poly(y, (1.0,) + _B)}))"
    mid = f"(exp(-{y}) * ({_poly(x, (_C[8],) + _C[:8])}) / ({_poly(x, (1.0,) + _D)}))"
    tail = f"({inv} * ({_poly(inv, (_P[5],) + _P[:5])}) / ({_poly(inv, (1.0,) + _Q)}))"
    high = f"(exp(-{y}) * ({_SQRPI!r}D - {tail}) / {x})"
    return f"(CASE WHEN {x} <= 0.46875D THEN {low} WHEN {x} <= 4D THEN {mid} ELSE {high} END)"


def norm_sf2(z):
    """Two-sided normal p-value of the column named ``z``."""
    return F.expr(norm_sf2_sql(f"`{z}`"))


def norm_sf2_oracle(z):
    """The same formula for an engine without the D suffix on literals."""
    import re

    return re.sub(r"(?<=\d)D\b", "", norm_sf2_sql(z))


def _betacf(a, b, x):
    tiny, qab, qap, qam = 1e-300, a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for aa in (m * (b - m) * x / ((qam + 2 * m) * (a + 2 * m)),
                   -(a + m) * (qab + m) * x / ((a + 2 * m) * (qap + 2 * m))):
            d = 1.0 + aa * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + aa / c
            c = c if abs(c) > tiny else tiny
            delta = d * c
            h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_sf2_value(t, dof):
    if t is None or dof is None or math.isnan(t) or math.isnan(dof) or dof <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_sf_value(x, dof):
    """Upper regularised incomplete gamma Q(dof/2, x/2)."""
    if x is None or dof is None or math.isnan(x) or math.isnan(dof) or dof <= 0:
        return None
    a, x = dof / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * lead
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return lead * h


@F.pandas_udf(T.DoubleType())
def t_sf2(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_sf2_value(a, b) for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_value(a, b) for a, b in zip(x, dof)], dtype="float64")


def norm_ppf(p):
    """Inverse normal CDF of a plain number (planning parameters only)."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)
