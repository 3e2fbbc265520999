"""Verbs on columns: select, rename, mutate."""

from __future__ import annotations

import warnings
from typing import Any

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.errors import EngineError, explained
from plumbline.frame import Frame, position
from plumbline.functions.aggregates import Aggregate
from plumbline.functions.selection import Selection, resolve
from plumbline.functions.terms import Later, Term, quoted


def select(frame: Frame, *wanted: str | int | Selection, **renamed: str) -> Frame:
    """Columns by name, place (from 1) or rule, in the order asked for; ``new="old"`` renames."""
    names = resolve(frame.names, list(wanted))
    new = {n: n for n in names}
    for to, source in renamed.items():
        frame.column(source, "select")
        new[source] = to
        names += [source] if source not in names else []
    if not names:
        raise EngineError("select", "the selection resulted in no columns")
    df = frame.df.select(*(quoted(n) if new[n] == n else quoted(n).alias(new[n]) for n in names))
    return frame._with(df, [new[g] for g in frame.groups if g in names])


def rename(frame: Frame, **renamed: str) -> Frame:
    for source in renamed.values():
        frame.column(source, "rename")
    old = {source: to for to, source in renamed.items()}
    return frame.set_names([old.get(n, n) for n in frame.names])


@explained("mutate")
def mutate(frame: Frame, *unnamed: Any, **named: Any) -> Frame:
    """New or replaced columns, one after the other: later ones see earlier ones.

    Values are terms, Spark columns, SQL text, or plain values. Neighbours that do not use each other's results make one projection.
    Groups matter only to aggregates (``c.x / sum_("x")``: the total of the row's group, or of all rows) and to ``row_number()``.
    """
    df, pending = frame.df, {}
    for k, value in enumerate(unnamed, 1):
        column = _value(value)
        name = value if isinstance(value, str) else value.name if isinstance(value, Term) and value.name else f"expression{k}"
        warnings.warn(f"an unnamed expression is named '{name}'", stacklevel=3)
        df = _put(df, {name: column})
    for name, value in named.items():
        if isinstance(value, Later):
            df, pending = _of_groups(_put(df, pending), frame.groups, name, value), {}
            continue
        column = _value(value)
        if pending and (name in pending or _uses(column, pending)):
            df, pending = _put(df, pending), {}
        pending[name] = column
    return frame._with(_put(df, pending))


def _of_groups(df: DataFrame, groups: tuple[str, ...], name: str, value: Later) -> DataFrame:
    """Adds a column that needs the rows of the group: each part under a name of its own, then the expression."""
    names = df.columns
    aggregates = [(k, p) for k, p in enumerate(value.parts) if isinstance(p, Aggregate)]
    if any(not isinstance(p, Aggregate) for p in value.parts):
        df = _numbered(df, groups)
    parts = {k: F.col("__place") for k, p in enumerate(value.parts) if not isinstance(p, Aggregate)}
    if aggregates and groups:  # partial sums and a join: a hot group needs no task of its own
        totals = df.groupBy(*(quoted(g).alias(f"__key{k}") for k, g in enumerate(groups))).agg(*(p.column(df).alias(f"__part{k}") for k, p in aggregates))
        df = df.join(totals, reduce(lambda a, b: a & b, (quoted(g).eqNullSafe(F.col(f"__key{k}")) for k, g in enumerate(groups))), "left")
        parts |= {k: F.col(f"__part{k}") for k, _ in aggregates}
    elif aggregates:
        parts |= {k: df.agg(p.column(df).alias("x")).scalar() for k, p in aggregates}
    out = df.withColumn(name, value.make([parts[k] for k in range(len(value.parts))]))
    return out.select(*(quoted(n) for n in [*names, *([name] if name not in names else [])]))


def _numbered(df: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Adds ``__place``: 1, 2, .. within each group, in the order of the rows. Numbers run within blocks of 65,536 rows
    and begin after the group's rows in the blocks before, so that a hot group is spread over its blocks. The rows keep their order."""
    placed, _ = position(df, "__place")
    if not groups:
        return placed.withColumn("__place", F.col("__place") + 1).orderBy("__place")
    keys, block = [quoted(g) for g in groups], F.shiftright("__place", 16)
    sizes = placed.groupBy(*(k.alias(f"__group{j}") for j, k in enumerate(keys)), block.alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*(f"__group{j}" for j in range(len(keys)))).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    within = F.row_number().over(Window.partitionBy(*keys, block).orderBy("__place")).cast("long")
    met = reduce(lambda a, b: a & b, (k.eqNullSafe(F.col(f"__group{j}")) for j, k in enumerate(keys)), block == F.col("__of"))
    return placed.withColumn("__within", within).join(sizes, met).orderBy("__place").withColumn("__place", F.col("__within") + F.col("__before"))


def _put(df, columns: dict[str, Column]):
    return df.withColumns(columns) if columns else df


def _value(value: Any) -> Column:
    if isinstance(value, str):
        return F.expr(value)
    if isinstance(value, (list, tuple, dict, set)):
        raise EngineError("mutate", "a value must be an expression or a single value, not a vector")
    return Term.of(value)


def _uses(column: Column, names: dict[str, Column]) -> bool:
    """Whether an expression may mention one of the names; a name within a longer word only costs a further projection."""
    text = str(column)
    return any(n in text for n in names)
