"""Normal and chi-square tails as Column expressions (published approximations)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from freshet.functions.basics import c

# fixed values: published coefficients of a rational normal-quantile approximation (|error| < 1.2e-9)
PROBIT_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
PROBIT_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
PROBIT_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
PROBIT_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
PROBIT_TAIL = 0.02425
# fixed values: published coefficients of the complementary error function (relative error < 1.2e-7)
ERFC = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def horner(coef: list[float], x: Column) -> Column:
    """Polynomial with the highest power first."""
    out = F.lit(coef[0])
    for k in coef[1:]:
        out = out * x + F.lit(k)
    return out


def probit(p: str | Column) -> Column:
    """Standard normal quantile."""
    p = c(p)
    q = p - 0.5
    t = q * q
    mid = horner(PROBIT_A, t) * q / horner(PROBIT_B, t)

    def tail(s: Column) -> Column:
        z = F.sqrt(-2 * F.ln(s))
        return horner(PROBIT_C, z) / horner(PROBIT_D, z)

    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < PROBIT_TAIL, tail(p))
        .when(p > 1 - PROBIT_TAIL, -tail(1 - p))
        .otherwise(mid)
    )


def erfc(x: str | Column) -> Column:
    x = c(x)
    t = 1 / (1 + 0.5 * F.abs(x))
    y = t * F.exp(-x * x + horner(ERFC[::-1], t))
    return F.when(x >= 0, y).otherwise(2 - y)


def normal_two_sided(z: str | Column) -> Column:
    return erfc(F.abs(c(z)) / F.sqrt(F.lit(2.0)))


def chi2_upper(x: str | Column, df: str | Column) -> Column:
    """Upper tail of chi-square by the cube-root normal approximation."""
    x, k = c(x), c(df)
    h = 2 / (9 * k)
    z = (F.cbrt(x / k) - (1 - h)) / F.sqrt(h)
    return 0.5 * erfc(z / F.sqrt(F.lit(2.0)))
