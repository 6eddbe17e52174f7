"""p-values as columns: the regularised incomplete beta function by a continued fraction, folded in the JVM.

Meant for rows of summaries (a row a group). The fraction stops moving when it has converged, so a fixed number of terms is safe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the fraction: it converges in about the square root of the larger parameter, so these serve a few 10**5 degrees of freedom.
TERMS = 600
#: Coefficients of Stirling's series for the logarithm of the gamma function, and the shift that makes it exact to 1e-15. Fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 12
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + SHIFT, less the factors in between."""
    x = z + SHIFT
    series = F.lit(0.0)
    for k, b in enumerate(STIRLING):
        series = series + F.lit(b) / F.pow(x, F.lit(2.0 * k + 1))
    product = F.log(z)
    for k in range(1, SHIFT):
        product = product + F.log(z + k)
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + series - product


def _guarded(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's recurrence, two steps a term."""
    start = _guarded(1.0 - (a + b) * x / (a + 1.0))
    first = F.struct(F.lit(1.0).alias("c"), (1.0 / start).alias("d"), (1.0 / start).alias("h"), F.lit(False).alias("done"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d1, c1 = 1.0 / _guarded(1.0 + even * state["d"]), _guarded(1.0 + even / state["c"])
        d2, c2 = 1.0 / _guarded(1.0 + odd * d1), _guarded(1.0 + odd / c1)
        moved = state["h"] * d1 * c1 * d2 * c2
        new = F.struct(c2.alias("c"), d2.alias("d"), moved.alias("h"), (F.abs(d2 * c2 - 1.0) < 1e-16).alias("done"))
        return F.when(state["done"], state).otherwise(new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step)["h"]


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """I_x(a, b) for a, b > 0 and x in [0, 1]; null outside or for nulls. `rest` is 1 - x where it is known more exactly."""
    rest = 1.0 - x if rest is None else rest
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, rest).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    part = front * _fraction(p, q, y) / p
    inside = F.when(swap, 1.0 - part).otherwise(part)
    return F.when((a > 0) & (b > 0) & (x > 0) & (rest > 0), inside).when((a > 0) & (b > 0) & (x == 0), 0.0).when((a > 0) & (b > 0) & (rest == 0), 1.0)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with df degrees of freedom (any positive number); 1 at t = 0."""
    t, df = t.cast("double"), df.cast("double")
    return F.when(t == 0, F.when(df > 0, 1.0)).otherwise(incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)))


def r_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; 0 at |r| = 1, null for fewer than three pairs."""
    r, df = r.cast("double"), n.cast("double") - 2.0
    return F.when(n >= 3, F.when(F.abs(r) >= 1, 0.0).otherwise(t_p_value(r * F.sqrt(df / (1.0 - r * r)), df)))
