"""Class labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label that stands for "no class".
NO_CLASS = "-"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binarise(col: Column | str) -> Column:
    """0 for the no-class label, 1 for any other label."""
    return F.when(_c(col) == NO_CLASS, 0).otherwise(1)


def decode_scores(scores: Column | str, classes: list[str]) -> Column:
    """Label from an array of class scores.

    One score and two classes: above one half means the second class (one half itself is the
    first). Several scores: the class with the largest, first on ties.
    """
    scores = _c(scores)
    labels = F.array(*[F.lit(c) for c in classes])
    if len(classes) == 2:
        return F.when(scores[0] > 0.5, labels[1]).otherwise(labels[0])
    return F.element_at(labels, F.array_position(scores, F.array_max(scores)).cast("int"))


def encode_label(col: Column | str, classes: list[str]) -> Column:
    """Index of the label among the sorted classes; NULL when it is unseen."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), _c(col))
    return F.when(place > 0, (place - 1).cast("int"))
