"""Vector arithmetic on array columns, as Column expressions that stay in the JVM.

Null vectors give nulls; vectors of different lengths give null, as zip_with pads with nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once: an expression that stands inside a lambda is otherwise repeated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(v: Column) -> Column:
    return let(v, lambda u: F.sqrt(dot(u, u)))


def l2_normalize(v: Column, eps: float = EPSILON) -> Column:
    """v / (|v| + eps); a zero vector stays zero."""
    return let(v, lambda u: let(F.sqrt(dot(u, u)) + F.lit(eps), lambda n: F.transform(u, lambda x: x / n)))


def softmax(v: Column) -> Column:
    """Stable softmax with 1e-8 in the denominator."""
    exps = lambda u: let(F.array_max(u), lambda high: F.transform(u, lambda x: F.exp(x - high)))
    return let(v, lambda u: let(exps(u), lambda e: let(total(e) + F.lit(EPSILON), lambda t: F.transform(e, lambda x: x / t))))


def log_softmax(v: Column) -> Column:
    def shifted(u: Column) -> Column:
        return let(F.array_max(u), lambda high: F.transform(u, lambda x: x - high))

    return let(v, lambda u: let(shifted(u), lambda d: let(F.ln(total(F.transform(d, lambda x: F.exp(x)))), lambda t: F.transform(d, lambda x: x - t))))


def argmax(v: Column) -> Column:
    """Index from 0 of the largest value, the first on a tie."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def variance(v: Column) -> Column:
    """Population variance of the non-null values."""
    known = F.filter(v, lambda x: x.isNotNull())
    return let(known, lambda u: let(total(u) / F.size(u), lambda m: total(F.transform(u, lambda x: (x - m) * (x - m))) / F.size(u)))


def one_hot(c: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == c, F.lit(1.0)).otherwise(F.lit(0.0)))


def blend(a: Column, b: Column, share: float) -> Column:
    """share * a + (1 - share) * b, as mixup blends labels."""
    return F.zip_with(a, b, lambda x, y: F.lit(share) * x + F.lit(1 - share) * y)


def smooth_labels(y: Column, eps: float, classes: int) -> Column:
    return F.transform(y, lambda x: x * F.lit(1 - eps) + F.lit(eps / classes))
