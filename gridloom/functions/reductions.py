"""Reductions: how the observations of a cell become one value.

A reduction is a style and a function from the columns of an assigned observation to an aggregate Column.  ``register_reduction`` adds more,
built from any Spark aggregate, Python grouped-aggregate functions included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Observed:
    """Columns of an observation assigned to a cell: value (double or bytes), t, record_index, squared distance and distance."""

    value: Column
    t: Column
    record_index: Column
    d2: Column
    d: Column


@dataclass(frozen=True)
class Reduction:
    name: str
    style: str
    build: Callable[[Observed], Column]


def _mean(o: Observed) -> Column:
    return F.avg(o.value)


def _weighted_mean(o: Observed) -> Column:
    """Each value weighs as much as its distance to the centre; null where all distances are 0."""
    return F.try_divide(F.sum(o.value * o.d), F.nullif(F.sum(o.d), F.lit(0.0)))


def _inverse_distance_mean(o: Observed) -> Column:
    """Near values weigh more; one at the centre itself decides (not one of the classic six)."""
    at = F.when(o.d == 0, o.value)
    return F.coalesce(F.avg(at), F.try_divide(F.sum(F.try_divide(o.value, o.d)), F.sum(F.try_divide(F.lit(1.0), o.d))))


def _median(o: Observed) -> Column:
    return F.median(o.value)


def _nearest(o: Observed) -> Column:
    """The smallest record index wins ties."""
    return F.min_by(o.value, F.struct(o.d2, o.record_index))


def _newest(o: Observed) -> Column:
    """The smallest record index wins ties."""
    return F.max_by(o.value, F.struct(o.t, -o.record_index))


_REGISTRY: dict[str, Reduction] = {}


def register_reduction(name: str, style: str, build: Callable[[Observed], Column]) -> Reduction:
    """Make a reduction known by its name; ``style`` is ``numeric`` or ``coded``."""
    if style not in ("numeric", "coded"):
        raise ValueError(f"unknown style {style!r}")
    _REGISTRY[name] = r = Reduction(name, style, build)
    return r


for _name, _style, _build in (
    ("mean", "numeric", _mean),
    ("weighted_mean", "numeric", _weighted_mean),
    ("median", "numeric", _median),
    ("coded_nearest_neighbour", "coded", _nearest),
    ("numeric_nearest_neighbour", "numeric", _nearest),
    ("newest", "numeric", _newest),
    ("inverse_distance_mean", "numeric", _inverse_distance_mean),
):
    register_reduction(_name, _style, _build)


def reduction(name: str) -> Reduction:
    if name not in _REGISTRY:
        raise ValueError(f"unknown reduction {name!r}; one of {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def reductions() -> list[str]:
    return sorted(_REGISTRY)
