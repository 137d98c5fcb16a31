"""Scalar column expressions (SC1-SC10).

Everything here is a plain ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen. Missing values are NULL, never NaN: a NaN would
poison ``avg`` and sort above every number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POS_INF = float("inf")
NEG_INF = float("-inf")

ColumnOrName = Column | str


def _c(x: ColumnOrName | float | int) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def nan_to_null(x: ColumnOrName) -> Column:
    """NaN (from inf-inf or inf/inf) becomes NULL, the engine's missing value."""
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def ieee_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """x/0 = +-inf, 0/0 = missing, anything with a missing side is missing (SC1).

    Plain ``/`` raises under ANSI and ``try_divide`` returns NULL for x/0, so
    neither matches array semantics. The zero branch never evaluates the
    division, and NaN from infinite operands is mapped to NULL.
    """
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return (
        F.when(d != 0, nan_to_null(n / d))
        .when(d == 0, F.when(n > 0, F.lit(POS_INF)).when(n < 0, F.lit(NEG_INF)))
    )


def ln_ieee(x: ColumnOrName) -> Column:
    """Natural log with ln(0) = -inf and ln(<0) = missing (SC2)."""
    c = _c(x).cast("double")
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(NEG_INF))


def sub(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Difference with inf-inf = missing."""
    return nan_to_null(_c(a).cast("double") - _c(b).cast("double"))


def sigmoid(x: ColumnOrName) -> Column:
    """Logistic function (SC6)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def within_year_after(start: ColumnOrName, event: ColumnOrName) -> Column:
    """Strict window ``start < event < start + 1 calendar year`` (SC7).

    ``add_months(d, 12)`` maps Feb-29 to Feb-28 like a calendar-year offset.
    """
    s, e = _c(start), _c(event)
    return (s < e) & (F.add_months(s, 12) > e)


def least_skip_null(*cols: ColumnOrName) -> Column:
    """Row-wise minimum that skips missing values (SC8)."""
    return F.least(*[_c(c) for c in cols])


def percent_text(x: ColumnOrName, digits: int = 2) -> Column:
    """Number, rounded, rendered as ``'<n>%'`` (SC10)."""
    return F.concat(fround(x, digits).cast("string"), F.lit("%"))


# ---------------------------------------------------------------------------
# Standard normal distribution (SC4, SC5) without a UDF.
#
# Published coefficients.
#   CDF: Hart's rational approximation in the double-precision form given by
#   G. West, "Better approximations to cumulative normal functions" (2005).
#   Quantile: P. J. Acklam's rational approximation (2003), refined with one
#   Halley step using the CDF above.
# Coefficients are listed highest power first.
# ---------------------------------------------------------------------------
WEST_NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165,
            33.912866078383, 112.079291497871, 221.213596169931,
            220.206867912376]
WEST_DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207,
            86.7807322029461, 296.564248779674, 637.333633378831,
            793.826512519948, 440.413735824752]
WEST_SPLIT = 7.07106781186547
WEST_TAIL_DIV = 2.506628274631
WEST_ZERO_BEYOND = 37.0

ACKLAM_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687,
            138.3577518672690, -30.66479806614716, 2.506628277459239]
ACKLAM_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866,
            66.80131188771972, -13.28068155288572, 1.0]
ACKLAM_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
            -2.549732539343734, 4.374664141464968, 2.938163982698783]
ACKLAM_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996,
            3.754408661907416, 1.0]
ACKLAM_LOW = 0.02425

SQRT_2PI = math.sqrt(2.0 * math.pi)
# Standard normal quantile at 0.999, a published constant.
PPF_0999 = 3.090232306167813


def _poly(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_cdf(x: ColumnOrName, z: Column | None = None) -> Column:
    """Standard normal CDF, max abs error ~1e-16 on [-9, 9] (SC4).

    ``z`` may name a column that holds ``|x|``: it is read some twenty times. The tail
    is written once and taken from 0 or 1, so that the generated code stays small.
    """
    c = _c(x).cast("double")
    z = F.abs(c) if z is None else z
    e = F.exp(-z * z / 2.0)
    frac = z + F.lit(1.0) / (z + F.lit(2.0) / (z + F.lit(3.0) / (z + F.lit(4.0) / (z + F.lit(0.65)))))
    tail = (
        F.when(z > WEST_ZERO_BEYOND, F.lit(0.0))
        .when(z < WEST_SPLIT, e * _poly(WEST_NUM, z) / _poly(WEST_DEN, z))
        .otherwise(e / frac / WEST_TAIL_DIV)
    )
    return F.abs(F.when(c < 0, F.lit(0.0)).otherwise(F.lit(1.0)) - tail)


def _acklam(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    t_lo = F.sqrt(F.lit(-2.0) * F.ln(p))
    t_hi = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    lower = _poly(ACKLAM_C, t_lo) / _poly(ACKLAM_D, t_lo)
    upper = -_poly(ACKLAM_C, t_hi) / _poly(ACKLAM_D, t_hi)
    middle = q * _poly(ACKLAM_A, r) / _poly(ACKLAM_B, r)
    return (
        F.when(p < ACKLAM_LOW, lower)
        .when(p > 1.0 - ACKLAM_LOW, upper)
        .otherwise(middle)
    )


def halley_step(x0: Column, p: Column) -> Column:
    """One Halley refinement of ``x0 ~ Phi^-1(p)``; pass column references."""
    u = (normal_cdf(x0) - p) * F.lit(SQRT_2PI) * F.exp(x0 * x0 / 2.0)
    return x0 - u / (F.lit(1.0) + x0 * u / 2.0)


def _ppf_edges(p: Column, x: Column) -> Column:
    return (F.when((p > 0) & (p < 1), x)
            .when(p == 0, F.lit(NEG_INF))
            .when(p == 1, F.lit(POS_INF)))


def normal_ppf(p: ColumnOrName, refine: bool = True) -> Column:
    """Standard normal quantile; NULL outside [0, 1], +-inf at the ends (SC5).

    The refined form binds the first guess to a lambda variable so the
    expression tree stays small; for whole-stage codegen on a hot path use
    :func:`with_normal_ppf`, which stages the same steps as projections.
    """
    c = _c(p).cast("double")
    if not refine:
        return _ppf_edges(c, _acklam(c))
    refined = F.transform(F.array(_acklam(c)), lambda x0: halley_step(x0, c))[0]
    return _ppf_edges(c, refined)


def with_normal_ppf(df, p: str, out: str):
    """Add ``out = Phi^-1(p)`` in staged projections (all in codegen).

    The steps of :func:`normal_ppf`, with everything that is read more than once in a
    column of its own. Between the ends the columns are never NULL (outside (0, 1) they
    hold 0.5 until the last step): null checks at every operation would take the
    generated method past the 8,000 bytes up to which the JVM compiles it.
    """
    names = {k: f"_{out}_{k}" for k in ("p", "q", "r", "t", "x0", "z", "u")}
    c = F.col(p).cast("double")
    g, q, r, t, x0, z, u = (F.col(n) for n in names.values())
    upper = g > 1.0 - ACKLAM_LOW
    tails = F.when(upper, F.lit(-1.0)).otherwise(F.lit(1.0)) * _poly(ACKLAM_C, t) / _poly(ACKLAM_D, t)
    middle = q * _poly(ACKLAM_A, r) / _poly(ACKLAM_B, r)
    root = F.coalesce(F.ln(F.when(upper, F.lit(1.0) - g).otherwise(g)), F.lit(0.0))
    staged = (df.withColumn(names["p"], F.coalesce(F.when((c > 0) & (c < 1), c), F.lit(0.5)))
              .withColumns({names["q"]: g - 0.5, names["t"]: F.sqrt(F.lit(-2.0) * root)})
              .withColumn(names["r"], q * q)
              .withColumn(names["x0"], F.coalesce(F.when((g < ACKLAM_LOW) | upper, tails).otherwise(middle), F.lit(0.0)))
              .withColumn(names["z"], F.abs(x0)))
    error = F.coalesce(normal_cdf(x0, z), F.lit(0.0)) - g
    staged = staged.withColumn(names["u"], error * F.lit(SQRT_2PI) * F.exp(x0 * x0 / 2.0))
    return staged.withColumn(out, _ppf_edges(c, x0 - u / (F.lit(1.0) + x0 * u / 2.0))).drop(*names.values())


def fround(x: ColumnOrName, digits: int) -> Column:
    """Round half away from zero as ``sign(x) floor(|x| 10^d + 1/2) / 10^d``.

    Spark's ``round`` rounds the decimal text of a double, other engines round
    the binary value; this form is the same sequence of IEEE operations in any
    engine, so reported tables agree bit for bit. A value whose scaled size
    reaches 2^53 holds no finer digits and passes through, as do infinities.
    """
    c = _c(x).cast("double")
    m = float(10 ** digits)
    scaled = F.abs(c) * m
    # below 2^53 the floor fits a BIGINT, which is what Spark's floor returns
    r = F.floor(F.when(scaled < float(2 ** 53), scaled) + 0.5).cast("double") / m
    return F.when(scaled < float(2 ** 53), F.when(c < 0, -r).otherwise(r)).otherwise(c)
