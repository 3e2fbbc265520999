"""Verbs on groups: group_by, ungroup, summarise."""

from __future__ import annotations

from plumbline.errors import EngineError, explained
from plumbline.frame import Frame
from plumbline.functions.aggregates import Aggregate
from plumbline.functions.selection import Selection, resolve
from plumbline.functions.terms import quoted


def group_by(frame: Frame, *wanted: str | int | Selection, add: bool = False) -> Frame:
    """Only notes the groups; ``add`` keeps those there are."""
    names = resolve(frame.names, list(wanted))
    return frame._with(frame.df, list(dict.fromkeys([*(frame.groups if add else ()), *names])), frame.computed)


def ungroup(frame: Frame) -> Frame:
    return frame._with(frame.df, (), frame.computed)


@explained("summarise")
def summarise(frame: Frame, *, drop_null_keys: bool = False, **aggregates: Aggregate) -> Frame:
    """One row for each group (or one row), keys first; the result has no groups. A NULL key is a group, unless dropped.

    Aggregation is partial before the shuffle, so that a hot group sends one row from each task.
    """
    if not aggregates:
        raise EngineError("summarise", "at least one aggregate is needed")
    for name, a in aggregates.items():
        if not isinstance(a, Aggregate):
            raise EngineError("summarise", f"'{name}' must be an aggregate: sum_, mean, min_, max_, n, count, sd or var")
    df = frame.df
    if drop_null_keys:
        for g in frame.groups:
            df = df.filter(quoted(g).isNotNull())
    columns = [a.column(df).alias(name) for name, a in aggregates.items()]
    return Frame(df.groupBy(*(quoted(g) for g in frame.groups)).agg(*columns), (), frame.mode)
