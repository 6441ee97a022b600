"""Array expressions over class scores (ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double"))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """log softmax(logits / T), shifted by the maximum, in float64."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))

    def normalised(shifted: Column) -> Column:
        total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + F.exp(x))
        return let(F.ln(total), lambda norm: F.transform(shifted, lambda x: x - norm))

    return let(F.transform(logits, lambda x: x.cast("double") / t),
               lambda z: let(F.array_max(z),
                             lambda top: let(F.transform(z, lambda x: x - top), normalised)))


def exp_array(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.exp(x))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    return exp_array(log_softmax(logits, temperature))


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def at(arr: Column, index0: Column) -> Column:
    return F.element_at(arr, (index0 + 1).cast("int"))


def all_finite(arr: Column) -> Column:
    infinity = float("inf")
    return F.coalesce(
        F.forall(arr, lambda x: x.isNotNull() & ~F.isnan(x) & (x < infinity) & (x > -infinity)),
        F.lit(False))


def brier(probabilities: Column, label: Column) -> Column:
    squares = F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + p * p)
    return F.greatest(F.lit(0.0), squares - 2.0 * at(probabilities, label) + 1.0)


def log_add(left: Column, right: Column) -> Column:
    """Element-wise log(exp(a) + exp(b)) without overflow."""
    def one(a: Column, b: Column) -> Column:
        high, low = F.greatest(a, b), F.least(a, b)
        return high + F.log1p(F.exp(low - high))
    return F.zip_with(left, right, one)


def add_scalar(arr: Column, value: Column) -> Column:
    return F.transform(arr, lambda x: x + value)


def exact_text(values: Column) -> Column:
    """An array of doubles as text that has all their bits: whole numbers of 2^-20, 2^-52, 2^-84.

    Scaling by powers of two and taking floors is exact, so any engine writes the same text;
    for numbers below 2^42 in size.
    """
    def digits(x: Column) -> Column:
        high = x * float(1 << 20)
        middle = (high - F.floor(high)) * float(1 << 32)
        low = (middle - F.floor(middle)) * float(1 << 32)
        return F.concat_ws(":", *(F.floor(part).cast("string") for part in (high, middle, low)))
    return F.concat_ws(",", F.transform(values, digits))
