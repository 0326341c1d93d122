"""Column functions over probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlsieve import constants as K


def risk_level(probability: Column) -> Column:
    """Four tiers by percent, upper bounds inclusive."""
    percent = probability * 100
    *bounded, (_, highest) = K.RISK_TIERS
    tiers = F
    for bound, name in bounded:
        tiers = tiers.when(percent <= bound, name)
    return tiers.otherwise(highest)


def verdict(
    probability: Column, threshold: float | Column = 0.5, names: tuple[str, str] = ("MAL", "BEN")
) -> Column:
    return F.when(probability >= threshold, names[0]).otherwise(names[1])


def ensemble(first: Column, second: Column) -> Column:
    """Mean of the two URL models; the page model is reported apart and never averaged in."""
    return (first + second) / 2


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def smooth(label: Column, epsilon: float = K.LABEL_SMOOTHING) -> Column:
    return label * (1.0 - 2.0 * epsilon) + epsilon
