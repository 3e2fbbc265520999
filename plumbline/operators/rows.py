"""Verbs on rows: filter, arrange, head."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.errors import EngineError, explained
from plumbline.frame import Frame, position
from plumbline.functions.terms import Term, quoted


@explained("filter")
def filter_(frame: Frame, *conditions: Any) -> Frame:
    """Rows for which all conditions are true; NULL counts as not true.

    A condition is a term, a Spark column, SQL text, True or False, or a mask: a sequence of one boolean (or None) for each row.
    """
    out, masks = frame.df, []
    for condition in conditions:
        if isinstance(condition, (Term, Column)):
            out = out.filter(Term.of(condition))
        elif isinstance(condition, bool):
            out = out.filter(F.lit(condition))
        elif isinstance(condition, str):
            out = out.filter(F.expr(condition))
        elif isinstance(condition, Sequence) or hasattr(condition, "tolist"):
            masks.append(list(condition))
        else:
            raise EngineError("filter", f"a condition cannot be a {type(condition).__name__}")
    return frame._with(_masked(frame, masks, conditions) if masks else out)


def _masked(frame: Frame, masks: list[list[bool | None]], conditions: Sequence[Any]):
    """Masks speak of the rows of the input, so they apply before the other conditions. A mask lives on the host, which bounds its size."""
    placed, total = position(frame.df)
    kept = np.ones(total, bool)
    for mask in masks:
        if len(mask) != total:
            raise EngineError("filter", f"a logical mask must have {total} entries, not {len(mask)}")
        if not all(m is None or m in (True, False) for m in mask):
            raise EngineError("filter", "a mask holds booleans only")
        kept &= np.fromiter((m is not None and bool(m) for m in mask), bool, total)
    chosen = frame.df.sparkSession.createDataFrame(pa.table({"__position": pa.array(np.flatnonzero(kept), pa.int64())}))
    out = placed.join(chosen, "__position", "left_semi").orderBy("__position").drop("__position")
    rest = [x for x in conditions if isinstance(x, (Term, Column, bool, str))]
    return filter_(frame._with(out), *rest).df if rest else out


def sort_key(frame: Frame, key: Any) -> tuple[str | None, Column]:
    """The key's column name (if it is one) and the sort expression: NULLs last going up, first going down; factors by their levels."""
    if isinstance(key, str):
        descending = key.startswith("-") and key not in frame.names
        key = Term(frame.column(key[1:] if descending else key, "arrange"), key[1:] if descending else key, descending)
    if isinstance(key, Column):
        key = Term(key)
    if not isinstance(key, Term):
        raise EngineError("arrange", f"a key cannot be a {type(key).__name__}")
    x = key.column
    if key.name is not None:
        frame.column(key.name, "arrange")
        x = quoted(key.name)
        if (levels := frame.levels(key.name)) is not None:
            x = F.when(x.isNotNull(), F.array_position(F.array(*map(F.lit, levels)), x))
    return key.name, x.desc_nulls_first() if key.descending else x.asc_nulls_last()


@explained("arrange")
def arrange(frame: Frame, *keys: Any, by_group: bool = False, stable: bool = True) -> Frame:
    """Rows in order. With ``by_group`` the groups come first, in the direction that a key gives them, if one does.

    ``stable`` keeps tied rows in their order (the order of partitions), by a row number as the last key.
    """
    parsed = [sort_key(frame, k) for k in keys]
    if by_group:
        own = {name: x for name, x in reversed(parsed) if name is not None}
        parsed = [(g, own.get(g, sort_key(frame, g)[1])) for g in frame.groups] + [p for p in parsed if p[0] not in frame.groups]
    if not parsed:
        return frame
    columns = [x for _, x in parsed]
    if not stable:
        return frame._with(frame.df.orderBy(*columns))
    return frame._with(frame.df.withColumn("__order", F.monotonically_increasing_id()).orderBy(*columns, F.col("__order")).drop("__order"))


def head(frame: Frame, n: int = 6) -> Frame:
    """The first rows; after ``arrange`` this is a top-k, which never sorts everything."""
    return frame._with(frame.df.limit(n))
