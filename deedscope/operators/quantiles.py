"""Exact quantiles without gathering a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. Here an
approximate quantile with a known rank error brackets each wanted rank, a counting pass tells
how many rows lie below, on and between the bracket's edges, and the search goes on strictly
between the edges. A round leaves a few thousandths of the rows, however often a value is
repeated, so the rows fit the driver after two or three rounds even for a huge column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ACCURACY = 2_000
# The sketch's rank error is at most 1 / accuracy; neighbouring ranks add at most as much again.
_SLACK = 3 / _ACCURACY


@dataclass
class _Search:
    """The wanted value has zero-based rank ``rank`` among ``n`` values within the open bounds."""

    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def holds(self) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (F.col("v") > self.low)
        if self.high is not None:
            inside = inside & (F.col("v") < self.high)
        return inside


def _ends(at: float) -> list[float]:
    """Probabilities whose approximate quantiles enclose the value at ``at`` for certain."""
    return [max(at - _SLACK, 0.0), min(at + _SLACK, 1.0)]


def _brackets(values: DataFrame, searches: list[_Search]) -> list[list[float]]:
    def bracket(s: _Search) -> Column:
        known = F.when(s.holds(), F.col("v"))
        return F.percentile_approx(known, _ends((s.rank + 1) / s.n), _ACCURACY)

    return list(values.agg(*[bracket(s).alias(str(i)) for i, s in enumerate(searches)]).first())


def _narrow(values: DataFrame, searches: list[_Search], edges: list[list[float]]) -> None:
    """Count below, on and between the edges of all searches in one pass, and move on.

    The counts decide, not the sketch: a rank outside its bracket is looked for outside.
    """
    counters = []
    for i, s in enumerate(searches):
        v, (lo, hi) = F.col("v"), edges[i]
        parts = [v < lo, v == lo, (v > lo) & (v < hi), (v == hi) & F.lit(hi > lo)]
        counters += [F.count_if(s.holds() & part).alias(f"{i}_{j}") for j, part in enumerate(parts)]
    counts = values.agg(*counters).first()
    for i, s in enumerate(searches):
        lo, hi = edges[i]
        below, on_low, inside, on_high = (counts[f"{i}_{j}"] for j in range(4))
        rank = s.rank - below
        if rank < 0:
            s.high, s.n = lo, below
        elif rank < on_low:
            s.value = lo
        elif rank < on_low + inside:
            s.low, s.high, s.rank, s.n = lo, hi, rank - on_low, inside
        elif rank < on_low + inside + on_high:
            s.value = hi
        else:
            upto = on_low + inside + on_high
            s.low, s.rank, s.n = hi, rank - upto, s.n - below - upto


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], *, leaf_rows: int = 20_000
) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values; NULLs are left out."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    # The first brackets need no row count, so both come from one pass and one sketch.
    ends = [end for p in probabilities for end in _ends(p)]
    row = values.agg(F.count("*").alias("n"), F.percentile_approx("v", ends, _ACCURACY).alias("q")).first()
    n = row["n"]
    if n == 0:
        return [None] * len(probabilities)
    positions = [p * (n - 1) for p in probabilities]
    searches: dict[int, _Search] = {}
    first_edges: dict[int, list[float]] = {}
    for i, position in enumerate(positions):
        for rank in (math.floor(position), math.ceil(position)):
            searches[rank] = _Search(rank, n)
            first_edges[rank] = row["q"][2 * i : 2 * i + 2]
    if n > leaf_rows and n > _ACCURACY:
        _narrow(values, list(searches.values()), [first_edges[r] for r in searches])
    while True:
        open_ones = [s for s in searches.values() if s.value is None]
        wide = [s for s in open_ones if s.n > leaf_rows]
        if not wide:
            break
        _narrow(values, wide, _brackets(values, wide))
    if open_ones:
        wanted = F.lit(False)
        for s in open_ones:
            wanted = wanted | s.holds()
        rows = sorted(r["v"] for r in values.filter(wanted).collect())
        for s in open_ones:
            inside = [
                v for v in rows if (s.low is None or v > s.low) and (s.high is None or v < s.high)
            ]
            s.value = inside[s.rank]
    return [
        searches[math.floor(p)].value
        + (searches[math.ceil(p)].value - searches[math.floor(p)].value) * (p - math.floor(p))
        for p in positions
    ]
