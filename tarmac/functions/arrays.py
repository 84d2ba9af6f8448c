"""Column functions on arrays of class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Probabilities of logits in double precision, shifted by the largest; null for null or empty arrays."""
    top = F.array_max(logits).cast("double")
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(logits) > 0, F.transform(shifted, lambda x: x / total))


def argmax(scores: Column) -> Column:
    """Index of the first largest value, from 0; null (an invalid row) for null arrays."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(index: Column, size: int) -> Column:
    """A distribution with all weight on one class; null for a null index."""
    return F.when(index.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double")))


def is_distribution(probs: Column, size: int, tolerance: float = 1e-4) -> Column:
    """Whether an array has ``size`` values from 0 to 1 that sum to 1 within the tolerance."""
    total = F.aggregate(probs, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return (F.size(probs) == size) & F.forall(probs, lambda x: (x >= 0) & (x <= 1 + tolerance)) & (F.abs(total - 1) <= tolerance)


def reorder(values: Column, old_codes: Column, new_codes: Column) -> Column:
    """Values of the classes ``old_codes`` in the order of ``new_codes`` (a class without a value: null)."""
    return F.transform(new_codes, lambda c: F.get(values, F.array_position(old_codes, c).cast("int") - 1))


def entropy_classes(shares: Column) -> Column:
    """Effective number of classes, exp of the entropy of an array of shares."""
    return F.exp(-F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p)).otherwise(0.0)))
