"""Operations of aggregation recipes: names to aggregate Columns over a class-filtered field."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from topolidar.functions.rules import ids

OBSERVED, INTENDED = "observed", "intended"
#: Percentiles of relative height: 10, 15, ..., 95.
RELATIVE_HEIGHTS = [p / 100 for p in range(10, 100, 5)]

_OPERATIONS: dict[str, Callable[[Column, Column, str], Column]] = {}


def register_operation(name: str, fn: Callable[[Column, Column, str], Column]) -> None:
    """``fn(value, row, compat)``: the aggregate of ``value``, which is NULL outside the recipe's classes; ``row`` is a
    literal that is NULL there, for counts of rows."""
    _OPERATIONS[name] = fn


def unbiased_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _rows(c: Column, row: Column, compat: str) -> Column:
    return F.count(row)


def _shots(c: Column, row: Column, compat: str) -> Column:
    """Rows as observed; distinct values as intended."""
    return F.count(row) if compat == OBSERVED else F.count_distinct(c)


for _name, _fn in {
    "get_len": _rows,
    "get_len_unique": _shots,
    "get_max98": lambda c, row, compat: F.percentile(c, 0.98),
    "get_mode": lambda c, row, compat: F.mode(c, True),
    "get_skew": lambda c, row, compat: unbiased_skewness(c),
    "percentile_rh": lambda c, row, compat: F.percentile(c, F.array(*map(F.lit, RELATIVE_HEIGHTS))),
    "mean": lambda c, row, compat: F.avg(c),
    "median": lambda c, row, compat: F.median(c),
    "min": lambda c, row, compat: F.min(c),
    "max": lambda c, row, compat: F.max(c),
    "sum": lambda c, row, compat: F.sum(c),
    "std": lambda c, row, compat: F.stddev_samp(c),
    "var": lambda c, row, compat: F.var_samp(c),
    "count": lambda c, row, compat: F.count(c),
    "nunique": lambda c, row, compat: F.count_distinct(c),
}.items():
    register_operation(_name, _fn)
register_operation("max98", _OPERATIONS["get_max98"])


@dataclass(frozen=True)
class Recipe:
    """One column of a segment table: ``operation`` over ``field`` of the rows whose ``class_field`` is in ``class_id``."""

    field: str
    operation: str
    class_field: str | None = None
    class_id: int | str | tuple = ()
    outfield: str | None = None

    @property
    def name(self) -> str:
        return self.outfield or f"{self.field}_{self.operation}"

    def column(self, order: str | None = None, compat: str = OBSERVED) -> Column:
        keep = F.col(self.class_field).isin(ids(self.class_id)) if self.class_field else F.lit(True)
        value, row = F.when(keep, F.col(self.field)), F.when(keep, F.lit(1))
        if self.operation in ("first", "last"):
            if order is None:
                raise ValueError(f"{self.operation} needs a column that says what the order is")
            return (F.min_by if self.operation == "first" else F.max_by)(value, F.when(value.isNotNull(), F.col(order))).alias(self.name)
        if self.operation not in _OPERATIONS:
            raise ValueError(f"no operation {self.operation!r}")
        made = _OPERATIONS[self.operation](value, row, compat)
        if self.operation in ("get_len", "get_len_unique", "count", "nunique") and compat == OBSERVED:
            # The surveyed code joins each metric to the segments, so that a count without rows is missing, not 0.
            made = F.when(F.count(row) > 0, made)
        return made.alias(self.name)
