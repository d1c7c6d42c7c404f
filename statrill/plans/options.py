"""Settings of a chart."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..operators.rules import ALL


@dataclass(frozen=True)
class Options:
    sigmas: float = 3.0
    floor: bool = True
    detect: bool = True
    threshold: float = 3.0
    least: int = 10
    manual: float | None = None
    rules: frozenset[int] = field(default=ALL)
    ewma_lambda: float = 0.2
    ma_window: float = 5
    cusum_k: float = 0.5
    cusum_h: float = 5.0

    def __post_init__(self) -> None:
        if not self.sigmas > 0:
            object.__setattr__(self, "sigmas", 3.0)

    @property
    def window(self) -> int:
        return max(2, math.floor(self.ma_window + 0.5)) if math.isfinite(self.ma_window) else 5


def panel_ratio(x: float, least: float = 0.1, most: float = 0.5) -> float:
    return min(most, max(least, x))
