"""Aggregates for ``summarise`` and, as values of a row's whole group, for ``mutate``. Each takes a column name, a term or a Spark column; conditions count as 0 and 1."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import EngineError
from plumbline.functions.terms import Later, Term, quoted


@dataclass(frozen=True, eq=False)
class Aggregate(Later):
    function: str
    argument: Any = None

    def column(self, df: DataFrame) -> Column:
        """The Spark aggregate over this frame's columns."""
        if self.function == "n":
            return F.count(F.lit(1))
        if isinstance(self.argument, str):
            if self.argument not in df.columns:
                raise EngineError("summarise", f"column '{self.argument}' not found; there are {', '.join(df.columns)}")
            x = quoted(self.argument)
        else:
            x = Term.of(self.argument)
        if self.function == "count":  # counts rows, NULLs as well
            return F.count(F.lit(1))
        if df.select(x.alias("x")).schema[0].dataType.simpleString() == "boolean" and self.function not in ("min", "max"):
            x = x.cast("int")
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "sd": F.stddev_samp, "var": F.var_samp}[self.function](x)


def sum_(x: Any) -> Aggregate:
    return Aggregate("sum", x)


def mean(x: Any) -> Aggregate:
    return Aggregate("mean", x)


def min_(x: Any) -> Aggregate:
    return Aggregate("min", x)


def max_(x: Any) -> Aggregate:
    return Aggregate("max", x)


def sd(x: Any) -> Aggregate:
    """The sample standard deviation; NULL for fewer than two values."""
    return Aggregate("sd", x)


def var(x: Any) -> Aggregate:
    return Aggregate("var", x)


def n() -> Aggregate:
    return Aggregate("n")


def count(x: Any) -> Aggregate:
    """The number of rows, whether the value is NULL or not (as ``n()``)."""
    return Aggregate("count", x)


class RowNumber(Later):
    """A row's place within its group."""


def row_number() -> RowNumber:
    """1, 2, .. in the order of the rows, within each group."""
    return RowNumber()
