"""Functions of numbers for which Spark has no built-in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts whose factorial is taken whole; terms of a binomial tail: this many square roots of n, and some.
EXACT, REACH, LEAST = 15, 5, 40


def stirling_error(n: Column) -> Column:
    """ln(n!) less its approximation (n + 1/2) ln n - n + ln(2 pi) / 2, for n from 1 on."""
    x = n.cast("double")
    small = F.log(F.factorial(F.least(n, F.lit(EXACT)).cast("int")).cast("double")) - (x + 0.5) * F.log(x) + x - 0.5 * math.log(2 * math.pi)
    square = x * x
    return F.when(n <= EXACT, small).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / square) / square) / square) / x)


def sign_test(wins: Column, losses: Column) -> Column:
    """The two-sided p of the sign test: twice the binomial tail up to the smaller count, 1 at most; 1 where both are 0, null where one is null.

    The tail's last term comes from the saddle-point form, which loses no digits however large the counts are; the others
    follow from it downward, and those further below it than some five square roots of n, which add less than the 10^-20th part,
    are not walked through. So a row costs O(sqrt(n)).
    """
    n, k = (wins + losses).cast("long"), F.least(wins, losses).cast("long")
    x, m = k.cast("double"), n.cast("double")
    lean = (m - 2 * x) / m  # by how much the two shares differ
    deviance = x * F.log1p(-lean) + (m - x) * F.log1p(lean)
    log = stirling_error(n) - stirling_error(k) - stirling_error(n - k) - deviance + 0.5 * F.log(m / (2 * math.pi * x * (m - x)))
    last = F.when(k == 0, F.exp(-m * math.log(2))).otherwise(F.exp(log))
    first = F.greatest(F.lit(1).cast("long"), k - F.ceil(REACH * F.sqrt(m)) - LEAST)
    below = F.when(k > 0, F.sequence(k, first, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.when(n == 0, 1.0).when(n > 0, F.least(F.lit(1.0), 2 * last * F.aggregate(below, zero, step)["sum"]))
