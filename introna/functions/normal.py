"""Normal survival function and its inverse as column expressions.

The survival function uses Hart's rational approximation with a continued fraction in the
tail; the inverse uses Acklam's rational approximation (relative error below 1.2e-9), taken
from p itself and not from 1 - p, so tiny p-values keep their precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from introna.functions.columns import horner, horner_sql

# Published coefficients of the two approximations.
HART_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
HART_SPLIT = 7.07106781186547
SQRT_TWO_PI = 2.5066282746310002
ACKLAM_A = [
    -3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
    1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00,
]
ACKLAM_B = [
    -5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
    6.680131188771972e+01, -1.328068155288572e+01, 1.0,
]
ACKLAM_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
    -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00,
]
ACKLAM_D = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
    3.754408661907416e+00, 1.0,
]
ACKLAM_LOW = 0.02425
SMALLEST_P = 2.2250738585072014e-308


def _upper_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0."""
    density = F.exp(-x * x / 2)
    body = density * horner(x, HART_NUMERATOR) / horner(x, HART_DENOMINATOR)
    build = x + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        build = x + F.lit(step) / build
    tail = density / build / SQRT_TWO_PI
    return F.when(x < HART_SPLIT, body).otherwise(tail)


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    upper = _upper_tail(F.abs(z))
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z >= 0, upper).otherwise(1 - upper)


def normal_isf(p: Column) -> Column:
    """The z with P(Z > z) = p. p = 0 is read as the smallest normal double, p = 1 gives -inf."""
    capped = F.greatest(p.cast("double"), F.lit(SMALLEST_P))
    tail = F.sqrt(-2 * F.ln(F.least(capped, 1 - capped)))
    far = horner(tail, ACKLAM_C) / horner(tail, ACKLAM_D)
    centre = capped - 0.5
    square = centre * centre
    near = -horner(square, ACKLAM_A) * centre / horner(square, ACKLAM_B)
    return (
        F.when(p.isNull(), F.lit(None).cast("double"))
        .when(p >= 1, F.lit(float("-inf")))
        .when(capped < ACKLAM_LOW, -far)
        .when(capped > 1 - ACKLAM_LOW, far)
        .otherwise(near)
    )


def normal_sf_sql(z: str) -> str:
    x = f"abs({z})"
    density = f"exp(-{x} * {x} / 2)"
    body = f"{density} * {horner_sql(x, HART_NUMERATOR)} / {horner_sql(x, HART_DENOMINATOR)}"
    build = f"({x} + 0.65::DOUBLE)"
    for step in ("4.0", "3.0", "2.0", "1.0"):
        build = f"({x} + {step}::DOUBLE / {build})"
    tail = f"{density} / {build} / {SQRT_TWO_PI!r}::DOUBLE"
    upper = f"(CASE WHEN {x} < {HART_SPLIT!r} THEN {body} ELSE {tail} END)"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END)"


def normal_isf_sql(p: str) -> str:
    capped = f"greatest({p}::DOUBLE, {SMALLEST_P!r}::DOUBLE)"
    tail = f"sqrt(-2 * ln(least({capped}, 1 - {capped})))"
    far = f"({horner_sql(tail, ACKLAM_C)} / {horner_sql(tail, ACKLAM_D)})"
    centre = f"({capped} - 0.5::DOUBLE)"
    square = f"({centre} * {centre})"
    near = f"(-{horner_sql(square, ACKLAM_A)} * {centre} / {horner_sql(square, ACKLAM_B)})"
    return (
        f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} >= 1 THEN '-inf'::DOUBLE "
        f"WHEN {capped} < {ACKLAM_LOW} THEN -{far} "
        f"WHEN {capped} > 1 - {ACKLAM_LOW} THEN {far} ELSE {near} END)"
    )
