"""Statistics as Column expressions: chi-square tails, log-factorials, Fisher's exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def chi_square_p(x: Column) -> Column:
    """Upper tail of the chi-square distribution of one degree of freedom; 1 for negative x. Apply after aggregation: the call isn't folded."""
    half = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    return F.call_function("reflect", F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), half).cast("double")


def log_factorials(n: int) -> list[float]:
    return [math.lgamma(k + 1) for k in range(n + 1)]


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column, most: int) -> Column:
    """Two-sided p of the table a b / c d: the probabilities of all tables with its margins that are no likelier. most: a bound of the total."""
    table = F.array(*[F.lit(x) for x in log_factorials(most)])
    lf = lambda x: F.element_at(table, (x + 1).cast("int"))
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    fixed = lf(r1) + lf(r2) + lf(c1) + lf(b + d) - lf(n)
    log_p = lambda x: fixed - lf(x) - lf(r1 - x) - lf(c1 - x) - lf(r2 - c1 + x)
    low, high = F.greatest(F.lit(0).cast("long"), c1 - r2).cast("long"), F.least(r1, c1).cast("long")
    limit = log_p(a) + 1e-7
    total = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, x: s + F.when(log_p(x) <= limit, F.exp(log_p(x))).otherwise(0.0))
    return F.when(n > 0, F.least(total, F.lit(1.0)))
