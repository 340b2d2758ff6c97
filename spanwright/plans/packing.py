"""Greedy plans over small, aggregated costs: frames into blocks and years into chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame


def near_equal_blocks(costs: Sequence[float], blocks: int, cap: int = 40, slack: float = 0.05) -> list[int]:
    """The block of each cost: contiguous blocks of about the same total, of at most `cap` members."""
    goal, out, block, total, n = sum(costs) / max(1, blocks), [], 0, 0.0, 0
    for c in costs:
        if n and (n >= cap or total + c > goal * (1 + slack)):
            block, total, n = block + 1, 0.0, 0
        out.append(block)
        total, n = total + c, n + 1
    return out


def furthest_within(costs: Sequence[float], budget: float, longest: int, breaks: Sequence[int] = (), measure: Callable[[int, int], float] | None = None) -> list[tuple[int, int]]:
    """Ranges (first, last) that each reach as far as the budget allows; one item over the budget stands alone.

    `measure(first, last)` tells a range's true cost where the sum of costs is only an estimate; what it says
    is learned as a ratio for the ranges to come. No range crosses a break, the first index of a new one.
    """
    out, first, ratio, stops = [], 0, 1.0, set(breaks)
    while first < len(costs):
        last, total = first, costs[first]
        while last + 1 < len(costs) and last + 1 - first < longest and last + 1 not in stops and (total + costs[last + 1]) * ratio <= budget:
            last += 1
            total += costs[last]
        if measure:
            while last > first and (real := measure(first, last)) > budget:
                ratio = max(ratio, real / max(total, 1e-9))
                total -= costs[last]
                last -= 1
        out.append((first, last))
        first = last + 1
    return out


def collected_costs(df: DataFrame, order: str, cost: str) -> tuple[list, list[float]]:
    """An aggregated cost table, a row for each frame, month or the like, in order."""
    rows = df.select(order, cost).orderBy(order).collect()
    return [r[0] for r in rows], [float(r[1]) for r in rows]
