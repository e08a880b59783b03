"""Link, clipping, threshold and label re-coding expressions of the FM model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGRESSION = 0
CLASSIFICATION = 1


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clip(z: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(z, lo), hi)


def link(z: Column, task: int, lo=None, hi=None) -> Column:
    """Regression: clip to the training label range; classification: probability."""
    if task == REGRESSION:
        return clip(z, lo, hi)
    if task == CLASSIFICATION:
        return sigmoid(z)
    raise ValueError(f"task must be 0 or 1, got {task}")


def threshold(p: Column, t: float = 0.5) -> Column:
    """0/1 decision, inclusive at the threshold."""
    return F.when(p >= F.lit(t), F.lit(1.0)).otherwise(F.lit(0.0))


def recode_label(label: Column) -> Column:
    """Classification labels: positive -> +1, anything else -> -1."""
    return F.when(label > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
