"""Class ladders, one helper for each convention of its borders. Null and NaN give a null class unless a base is named."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.sources.tables import nan_to_null


def _chain(steps: list[tuple[Column, str]], base: str) -> Column:
    first, *rest = steps
    return reduce(lambda c, s: c.when(s[0], F.lit(s[1])), rest, F.when(first[0], F.lit(first[1]))).otherwise(F.lit(base))


def _known(v: Column, ladder: Column) -> Column:
    return F.when(v.isNotNull(), ladder)


def at_most(c: Column, cuts: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """labels[i] for the first cut that is not exceeded (right-closed intervals), the last label above all."""
    v = nan_to_null(c)
    return _known(v, _chain([(v <= q, n) for q, n in zip(cuts, labels)], labels[-1]))


def below(c: Column, cuts: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """labels[i] for the first cut that lies above (left-closed intervals), the last label from the last cut on."""
    v = nan_to_null(c)
    return _known(v, _chain([(v < q, n) for q, n in zip(cuts, labels)], labels[-1]))


def above(c: Column, cuts: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """labels[i + 1] for the largest cut strictly exceeded, labels[0] (also for missing values) if none is."""
    v = nan_to_null(c)
    steps = [(v > q, n) for q, n in zip(reversed(list(cuts)), reversed(labels[1:]))]
    return _chain(steps, labels[0])
