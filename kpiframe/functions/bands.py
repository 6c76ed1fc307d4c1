"""The ladder of band widths and the suggested width of a column (SCH-7, SCH-8)."""

from __future__ import annotations

from bisect import bisect_right

from kpiframe.functions.arguments import Argument

# Mantissas 1, 2, 5 over the decades 10^-8 .. 10^12, ascending.
LADDER = [float(f"{mantissa}e{decade}") for decade in range(-8, 13) for mantissa in (1, 2, 5)]


def width_for_spread(stddev: float | None) -> float | None:
    """The rung before the last one that a standard deviation reaches (the first rung at least)."""
    spread = Argument(stddev).amount()
    return None if spread is None else LADDER[max(0, bisect_right(LADDER, spread) - 2)]
