"""Column expressions with data-frame semantics.

Arithmetic is double arithmetic (no integer overflow, no decimals), division follows IEEE 754 (x/0 is infinite, 0/0 is NaN,
NULL stays NULL), and comparisons are three-valued as in SQL. Everything is a built-in Spark expression, so that it stays within
whole-stage code generation and can be pushed down.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class Term:
    """An expression; ``numeric`` marks results of arithmetic, which are doubles already."""

    __slots__ = ("column", "descending", "name")
    __hash__ = None

    def __init__(self, column: Column, name: str | None = None, descending: bool = False):
        self.column, self.name, self.descending = column, name, descending

    @staticmethod
    def of(value: Any) -> Column:
        """The Spark column of a term, a column or a literal."""
        return value.column if isinstance(value, Term) else value if isinstance(value, Column) else F.lit(value)

    @staticmethod
    def number(value: Any) -> Column:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return F.lit(float(value))
        return Term.of(value).cast("double")

    def __add__(self, other: Any) -> Term:
        return Term(self.number(self) + self.number(other))

    def __radd__(self, other: Any) -> Term:
        return Term(self.number(other) + self.number(self))

    def __sub__(self, other: Any) -> Term:
        return Term(self.number(self) - self.number(other))

    def __rsub__(self, other: Any) -> Term:
        return Term(self.number(other) - self.number(self))

    def __mul__(self, other: Any) -> Term:
        return Term(self.number(self) * self.number(other))

    def __rmul__(self, other: Any) -> Term:
        return Term(self.number(other) * self.number(self))

    def __truediv__(self, other: Any) -> Term:
        return Term(divide(self.number(self), other))

    def __rtruediv__(self, other: Any) -> Term:
        return Term(divide(self.number(other), self))

    def __pow__(self, other: Any) -> Term:
        return Term(F.pow(self.number(self), self.number(other)))

    def __rpow__(self, other: Any) -> Term:
        return Term(F.pow(self.number(other), self.number(self)))

    def __floordiv__(self, other: Any) -> Term:
        return Term(_floor(divide(self.number(self), other)))

    def __mod__(self, other: Any) -> Term:
        """The remainder with the sign of the divisor."""
        return Term(self.number(self) - _floor(divide(self.number(self), other)) * self.number(other))

    def __neg__(self) -> Term:
        return Term(-self.number(self), self.name, not self.descending) if self.name else Term(-self.number(self))

    def __eq__(self, other: Any) -> Term:  # type: ignore[override]
        return Term(self.column == self.of(other))

    def __ne__(self, other: Any) -> Term:  # type: ignore[override]
        return Term(self.column != self.of(other))

    def __gt__(self, other: Any) -> Term:
        return Term(self.column > self.of(other))

    def __ge__(self, other: Any) -> Term:
        return Term(self.column >= self.of(other))

    def __lt__(self, other: Any) -> Term:
        return Term(self.column < self.of(other))

    def __le__(self, other: Any) -> Term:
        return Term(self.column <= self.of(other))

    def __and__(self, other: Any) -> Term:
        return Term(self.column & self.of(other))

    def __rand__(self, other: Any) -> Term:
        return Term(self.of(other) & self.column)

    def __or__(self, other: Any) -> Term:
        return Term(self.column | self.of(other))

    def __ror__(self, other: Any) -> Term:
        return Term(self.of(other) | self.column)

    def __invert__(self) -> Term:
        return Term(~self.column)

    def isin(self, *values: Any) -> Term:
        return Term(self.column.isin(*values))

    def is_null(self) -> Term:
        return Term(self.column.isNull())

    def not_null(self) -> Term:
        return Term(self.column.isNotNull())

    def cast(self, kind: str) -> Term:
        return Term(self.column.cast(kind))

    def __bool__(self) -> bool:
        raise TypeError("a term has no truth value; combine conditions with &, | and ~")


class Later:
    """A value that needs other rows: an aggregate of the group or a place in it, or arithmetic with such. ``mutate`` evaluates it.

    ``parts`` are the aggregates and places, ``make`` gives the column when their columns are known.
    """

    @property
    def parts(self) -> tuple[Later, ...]:
        return (self,)

    def make(self, columns: list[Column]) -> Column:
        return columns[0]


class _Mixed(Later):
    def __init__(self, parts: tuple[Later, ...], make):
        self._parts, self._make = parts, make

    @property
    def parts(self) -> tuple[Later, ...]:
        return self._parts

    def make(self, columns: list[Column]) -> Column:
        return self._make(columns)


def _operation(name: str):
    """The operator of ``Term``, to be carried out when both sides are known."""
    own = getattr(Term, name)

    def later(self: Later, other: Any) -> Later:
        right = other if isinstance(other, Later) else None
        n = len(self.parts)
        return _Mixed(self.parts + (right.parts if right else ()), lambda columns: own(Term(self.make(columns[:n])), Term(right.make(columns[n:])) if right else other).column)

    def now(self: Term, other: Any) -> Term:
        return NotImplemented if isinstance(other, Later) else own(self, other)

    now.__doc__ = own.__doc__
    return later, now


for _name in ("add", "radd", "sub", "rsub", "mul", "rmul", "truediv", "rtruediv", "pow", "rpow", "floordiv", "mod", "eq", "ne", "gt", "ge", "lt", "le"):
    _later, _now = _operation(f"__{_name}__")
    setattr(Later, f"__{_name}__", _later)
    setattr(Term, f"__{_name}__", _now)


def _floor(x: Column) -> Column:
    """The floor as a double; infinite and NaN values stay (a cast to integers would lose them)."""
    whole = F.abs(x) < F.lit(2.0**53)
    return F.when(whole, F.floor(F.when(whole, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)


def divide(a: Column, b: Any) -> Column:
    """IEEE division of doubles. ``pow(b, -1)`` keeps the sign of a zero divisor."""
    if isinstance(b, (int, float)) and not isinstance(b, bool) and b != 0:
        return a / F.lit(float(b))
    b = Term.number(b)
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


class _Columns:
    """``c.x`` or ``c["any name"]``: a column by name."""

    def __getattr__(self, name: str) -> Term:
        if name.startswith("__"):
            raise AttributeError(name)
        return Term(quoted(name), name)

    def __getitem__(self, name: str) -> Term:
        return Term(quoted(name), name)


c = _Columns()


def lit(value: Any) -> Term:
    return Term(F.lit(value))


def if_else(condition: Any, yes: Any, no: Any = None) -> Term:
    return Term(F.when(Term.of(condition), Term.of(yes)).otherwise(Term.of(no)))


def desc(key: str | Term) -> Term:
    """A sort key in descending order."""
    if isinstance(key, Term):
        return Term(key.column, key.name, True)
    return Term(quoted(key), key, True)
