"""Rules as data: additive scores and decision lists, compiled to one expression without joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def additive(rules: list[tuple[Column, int | Column, str]], least: int | None = None, most: int | None = None) -> tuple[Column, Column]:
    """(score, reasons): the sum of the points of all conditions that hold, and their labels in order. Null conditions don't hold."""
    score, labels = F.lit(0), []
    for cond, points, label in rules:
        p = F.lit(points) if isinstance(points, int) else points
        score = score + F.when(F.coalesce(cond, F.lit(False)), p).otherwise(0)
        labels.append(F.when(F.coalesce(cond, F.lit(False)), F.lit(label)))
    if least is not None:
        score = F.greatest(score, F.lit(least))
    if most is not None:
        score = F.least(score, F.lit(most))
    return score, F.array_compact(F.array(*labels))


def decide(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default) if out is not None else F.lit(default)
