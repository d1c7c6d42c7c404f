"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of control charting.
D2, MR_UCL, SIGMAS, LEAST_PHASE = 1.128, 3.267, 3.0, 10
#: Control chart constants A2, A3, D3, D4, B3, B4 by subgroup size.
CONSTANTS = {
    2: (1.880, 2.659, 0.0, 3.267, 0.0, 3.267),
    3: (1.023, 1.954, 0.0, 2.574, 0.0, 2.568),
    4: (0.729, 1.628, 0.0, 2.282, 0.0, 2.266),
    5: (0.577, 1.427, 0.0, 2.114, 0.0, 2.089),
    6: (0.483, 1.287, 0.0, 2.004, 0.030, 1.970),
    7: (0.419, 1.182, 0.076, 1.924, 0.118, 1.882),
    8: (0.373, 1.099, 0.136, 1.864, 0.185, 1.815),
    9: (0.337, 1.032, 0.184, 1.816, 0.239, 1.761),
    10: (0.308, 0.975, 0.223, 1.777, 0.284, 1.716),
    11: (0.285, 0.927, 0.256, 1.744, 0.321, 1.679),
    12: (0.266, 0.886, 0.283, 1.717, 0.354, 1.646),
    13: (0.249, 0.850, 0.307, 1.693, 0.382, 1.618),
    14: (0.235, 0.817, 0.328, 1.672, 0.406, 1.594),
    15: (0.223, 0.789, 0.347, 1.653, 0.428, 1.572),
    16: (0.212, 0.763, 0.363, 1.637, 0.448, 1.552),
    17: (0.203, 0.739, 0.378, 1.622, 0.466, 1.534),
    18: (0.194, 0.718, 0.391, 1.608, 0.482, 1.518),
    19: (0.187, 0.698, 0.403, 1.597, 0.497, 1.503),
    20: (0.180, 0.680, 0.415, 1.585, 0.510, 1.490),
    21: (0.173, 0.663, 0.425, 1.575, 0.523, 1.477),
    22: (0.167, 0.647, 0.434, 1.566, 0.534, 1.466),
    23: (0.162, 0.633, 0.443, 1.557, 0.545, 1.455),
    24: (0.157, 0.619, 0.451, 1.548, 0.555, 1.445),
    25: (0.153, 0.606, 0.459, 1.541, 0.565, 1.435),
}
CONSTANT_NAMES = ("A2", "A3", "D3", "D4", "B3", "B4")
LIMITS = ("center", "mr_bar", "sigma", "ucl", "lcl", "zone_a_upper", "zone_a_lower", "zone_b_upper", "zone_b_lower")


def number(df: DataFrame, name: str | None) -> Column:
    """A finite number as double; nulls, non-finite numbers and anything that is not of a numeric type are gaps."""
    if name is None or not isinstance(df.schema[name].dataType, T.NumericType):
        return F.lit(None).cast("double")
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """A join by columns of the same names in which a null equals a null; left, semi or anti, with the left side's columns."""
    own = {c: f"of_right_{i}_" for i, c in enumerate(on)}
    other = right.withColumnsRenamed(own)
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in own.items()])
    return left.join(other, same, how).drop(*own.values())


def rounded(x: Column) -> Column:
    """Halves round up, also below zero."""
    return F.floor(x + 0.5)


def constant(name: str, size: Column) -> Column:
    """A control chart constant by subgroup size; null for sizes that are not whole or not in the table."""
    i = CONSTANT_NAMES.index(name)
    pairs = [F.lit(x) for m, row in CONSTANTS.items() for x in (m, row[i])]
    return F.when(size == F.floor(size), F.element_at(F.create_map(*pairs), size.cast("int")))


def limits(center: Column, mr_bar: Column, sigma: Column, sigmas: float, floor: bool) -> dict[str, Column]:
    """The nine limit columns. With floor, the three lower bounds do not go below zero."""
    low = (lambda x: F.greatest(x, F.lit(0.0))) if floor else (lambda x: x)
    third = sigmas / 3
    values = (center, mr_bar, sigma, center + sigmas * sigma, low(center - sigmas * sigma), center + 2 * third * sigma, low(center - 2 * third * sigma), center + third * sigma, low(center - third * sigma))
    return {name: value.cast("double") for name, value in zip(LIMITS, values, strict=True)}
