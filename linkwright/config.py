"""Settings of a comparison."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of comparison, estimation and linkage.
PREFIX_WEIGHT, LOWER, UPPER = 0.1, 0.88, 0.94
TOLERANCE, MAX_ITERATIONS, FIRST_LAMBDA = 1e-4, 5000, 0.1
THRESHOLD, GRID = 0.85, 1000
FUZZY_LEVELS, EXACT_LEVELS = 3, 2


@dataclass(frozen=True)
class CompareConfig:
    """``compat`` keeps the numbers of the original method where they are odd: strings of one character never match between tables, and a table's pairs include those of a record with itself."""

    p: float = PREFIX_WEIGHT
    lower: float = LOWER
    upper: float = UPPER
    compat: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.p <= 0.25:
            raise ValueError("p must lie between 0 and 0.25")
        if not 0 < self.lower <= self.upper:
            raise ValueError("thresholds must be positive, the lower one first")
