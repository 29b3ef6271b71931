"""Double arithmetic as IEEE 754 has it, where Spark raises errors, gives null or orders NaN otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def div(a: Column, b: Column) -> Column:
    """a / b, where a zero divisor gives an infinity, or NaN for 0/0."""
    negative = F.lit(1.0) * F.when(F.signum(a) * F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0) < 0, -INF).otherwise(INF)
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), NAN).otherwise(negative)).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def mod(a: Column, b: Column) -> Column:
    """Truncated remainder with the dividend's sign; NaN for a zero divisor."""
    return F.when(b == 0, NAN).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def comparison(op: str, a: Column, b: Column) -> Column:
    """A comparison in which NaN equals nothing and is neither smaller nor greater."""
    number = ~F.isnan(a) & ~F.isnan(b)
    found = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return ~number | found if op == "!=" else number & found


def ln(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.ln(F.when(x <= 0, 1.0).otherwise(x)))


def log2(x: Column) -> Column:
    return ln(x) / math.log(2)


def log10(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.log10(F.when(x <= 0, 1.0).otherwise(x)))


def _whole(x: Column, f) -> Column:
    """floor or ceil as a double; values without a fraction stay as they are."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), 0.0).otherwise(x)).cast("double"))


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(F.greatest(a, b))


def min_number(x: Column) -> Column:
    """Aggregate: the least that is no NaN; NaN if there are only NaN; null without values."""
    return F.coalesce(F.min(F.when(~F.isnan(x), x)), F.max(F.when(F.isnan(x), x)))


def max_number(x: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(F.when(F.isnan(x), x)))


def fold(op: str, a: float, b: float) -> float:
    """The arithmetic operators on two numbers."""
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        if b == 0:
            return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1.0, b)
        return a / b
    if op == "%":
        return NAN if b == 0 or math.isinf(a) else math.fmod(a, b)
    try:
        return math.pow(a, b)
    except OverflowError:
        return INF
    except ValueError:
        return INF if a == 0 else NAN
