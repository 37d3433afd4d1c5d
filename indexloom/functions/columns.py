"""Column expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 252
TOLERANCE = 1e-8
UNCLASSIFIED = "Unclassified"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def compound(c: Column | str) -> Column:
    """Aggregate: the return of all returns after each other."""
    return F.product(1 + col(c)) - 1


def annualised_return(total: Column | str, n: Column | str, year: int = YEAR_DAYS) -> Column:
    """A total return of ``n`` observations, a year; a total loss stays -1."""
    t = col(total)
    return F.when(t <= -1, F.lit(-1.0)).otherwise(F.pow(1 + t, F.lit(float(year)) / col(n)) - 1)


def annualised_volatility(c: Column | str, year: int = YEAR_DAYS) -> Column:
    """Aggregate: sample deviation, a year; null for fewer than two."""
    return F.stddev_samp(col(c)) * math.sqrt(year)


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``, null where b is not positive."""
    return F.when(col(b) > 0, col(a) / col(b))


def classified(c: Column | str, blank_too: bool = True) -> Column:
    """A class, or ``Unclassified`` for null (and blank)."""
    x = F.when(F.trim(col(c)) == "", None).otherwise(col(c)) if blank_too else col(c)
    return F.coalesce(x, F.lit(UNCLASSIFIED))


def change_status(before: Column | str, after: Column | str, tolerance: float = TOLERANCE, by_difference: bool = True) -> Column:
    """entrant, exit, weight_increase, weight_decrease or unchanged.

    ``by_difference``: a move counts if the difference exceeds the tolerance;
    else if ``after`` exceeds ``before`` plus it. The two differ at the edge.
    """
    a, b = col(before), col(after)
    up, down = (b - a > tolerance, b - a < -tolerance) if by_difference else (b > a + tolerance, b < a - tolerance)
    return (
        F.when((a <= tolerance) & (b > tolerance), "entrant")
        .when((a > tolerance) & (b <= tolerance), "exit")
        .when(up, "weight_increase")
        .when(down, "weight_decrease")
        .otherwise("unchanged")
    )


def normal_cdf(c: Column | str) -> Column:
    """Standard normal distribution function, to some fifteen digits, its tails too; Spark has no ``erf``.

    Near 0 the series of x over odd factorials, beyond 3 the continued
    fraction of the tail (Abramowitz and Stegun 26.2.11, 26.2.14).
    """
    x = col(c).cast("double")
    z = F.abs(x)
    series, fraction = F.lit(1.0), z
    for k in range(48, 0, -1):  # doubles throughout, so that nothing needs a cast
        series = F.lit(1.0) + series * (z * z / F.lit(2.0 * k + 1))
        fraction = z + F.lit(float(k)) / fraction
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    tail = F.when(z < 3, 0.5 - density * z * series).otherwise(density / fraction)
    return F.when(x < 0, tail).otherwise(1 - tail)


def chi_square_tail(statistic: Column | str, df: Column | str) -> Column:
    """Upper tail of the chi-square distribution with a whole number of degrees of freedom, by its finite sums."""
    x, n = F.greatest(col(statistic).cast("double"), F.lit(0.0)), col(df).cast("int")
    steps = F.when(n >= 3, F.sequence(F.lit(1), F.floor((n - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    odd = n % 2 == 1
    first = F.when(odd, F.sqrt(x)).otherwise(F.lit(1.0))
    begin = F.struct(first.alias("term"), F.when(odd & (n == 1), F.lit(0.0)).otherwise(first).alias("total"))
    # x^(j - 1/2) / (1 3 .. 2j - 1) for odd, (x/2)^j / j! for even
    grow = lambda t, j: t["term"] * F.when(odd, x / (2 * j + 1)).otherwise(x / (2 * j))
    last = F.floor((n - 1) / 2)
    add = lambda t, j: F.struct(grow(t, j).alias("term"), (t["total"] + F.when(odd & (j >= last), 0.0).otherwise(grow(t, j))).alias("total"))
    total = F.aggregate(steps, begin, add)["total"]
    return F.when(odd, 2 * normal_cdf(-F.sqrt(x)) + F.sqrt(F.lit(2 / math.pi)) * F.exp(-x / 2) * total).otherwise(F.exp(-x / 2) * total)


def business_days(start: Column | str, end: Column | str) -> Column:
    """Mondays to Fridays from ``start`` on and before ``end``, plus one."""
    a, b = col(start), col(end)
    return 1 + F.when(b > a, F.size(F.filter(F.sequence(a, F.date_sub(F.greatest(b, F.date_add(a, 1)), 1)), lambda d: F.weekday(d) < 5))).otherwise(0)


def exact_sum(value: Column) -> Column:
    """Sum of a column, rounded at the end only, so that it does not depend on the order of rows.

    Values are cut into two whole numbers, of 2^-20 and of 2^-62, whose sums
    are exact. Where these do not do (2^32 and beyond, not finite, or so many
    rows that whole numbers overflow) it is the plain sum.
    """
    x = value.cast("double")
    fits = F.abs(x) < 2.0**32
    high = F.when(fits, F.floor(x * 2.0**20))
    low = F.when(fits, ((x - high / 2.0**20) * 2.0**62).cast("long"))
    exact = F.try_sum(high) / 2.0**20 + F.try_sum(low) / 2.0**62
    return F.coalesce(F.when(F.max(F.abs(x)) < 2.0**32, exact), F.sum(x))
