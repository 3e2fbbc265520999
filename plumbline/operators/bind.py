"""Tables below each other and beside each other."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import EngineError
from plumbline.frame import Frame, position
from plumbline.functions.terms import quoted
from plumbline.sources.tables import tbl

LADDER = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]
_TIMES = ["date", "timestamp_ntz", "timestamp"]


def promoted(a: str, b: str) -> str:
    """The type that holds both: booleans below integers below doubles, anything with strings is a string, the finer of two times."""
    if a == b:
        return a
    if "void" in (a, b):
        return b if a == "void" else a
    if a in LADDER and b in LADDER:
        both = {a, b}
        return "double" if "float" in both and both & {"int", "bigint"} else max(a, b, key=LADDER.index)
    if a in _TIMES and b in _TIMES:
        return max(a, b, key=_TIMES.index)
    if "string" in (a, b):
        return "string"
    raise EngineError("bind_rows", f"columns of types {a} and {b} cannot be stacked")


def _tables(tables: tuple[Any, ...], operation: str) -> list[Frame]:
    if len(tables) == 1 and isinstance(tables[0], (list, tuple)):
        tables = tuple(tables[0])
    spark = next((t.df.sparkSession if isinstance(t, Frame) else t.sparkSession for t in tables if isinstance(t, (Frame, DataFrame))), None)
    frames = [t if isinstance(t, Frame) else tbl(t, spark) for t in tables if t is not None]
    if not frames:
        raise EngineError(operation, "there is no table")
    return frames


def bind_rows(*tables: Any, id: str | None = None, **named: Any) -> Frame:
    """Rows of all tables: the union of their columns in the order of first sight, NULL where a table has none, types promoted.

    ``id`` names a first column with the argument's name, or "1", "2", .. for unnamed tables.
    """
    labels = list(named)
    if len(tables) == 1 and isinstance(tables[0], dict):
        labels, tables = [*tables[0], *labels], tuple(tables[0].values())
    frames = _tables((*tables, *named.values()) if named else tables, "bind_rows")
    unnamed = len(frames) - len(labels)
    labels = [str(k + 1) for k in range(unnamed)] + labels
    kinds: dict[str, str] = {}
    levels: dict[str, list[str] | None] = {}
    for f in frames:
        for name, kind in f.types.items():
            kinds[name] = promoted(kinds[name], kind) if name in kinds else kind
            own = f.levels(name)
            levels[name] = None if own is None or (name in levels and levels[name] is None) else list(dict.fromkeys([*(levels.get(name) or []), *own]))
    out = None
    for label, f in zip(labels, frames):
        columns = [(quoted(n).cast(k) if f.types[n] != k else quoted(n)) if n in f.names else F.lit(None).cast(k) for n, k in kinds.items()]
        columns = [x.alias(n, metadata={"levels": levels[n]}) if levels[n] else x.alias(n) for x, n in zip(columns, kinds)]
        part = f.df.select(*([F.lit(label).alias(id)] if id else []), *columns)
        out = part if out is None else out.union(part)
    return Frame(out, (), frames[0].mode)


def repaired(names: list[str], repair: str) -> list[str]:
    """Column names of tables side by side: made unique by their places (``a...1``), valid besides (universal), checked, or as they are."""
    if repair == "minimal":
        return names
    if repair == "check_unique":
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise EngineError("bind_cols", f"names must be unique; {', '.join(twice)} occur more than once")
        return names
    if repair not in ("unique", "universal"):
        raise EngineError("bind_cols", f"unknown name repair '{repair}'")
    base = [re.sub(r"(\.\.\.\d+)+$", "", n) for n in names]
    if repair == "universal":
        base = [re.sub(r"[^0-9A-Za-z_.]", ".", n) for n in base]
        base = [n if re.match(r"^([A-Za-z]|\.(?!\d)|_)", n) or not n else f"...{n}" for n in base]
        base = [f".{n}" if n.startswith("_") else n for n in base]
    return [f"{n}...{k}" if base.count(n) > 1 or n == "" else n for k, n in enumerate(base, 1)]


def bind_cols(*tables: Any, name_repair: str = "unique") -> Frame:
    """Tables side by side, row by row in their order; they must have as many rows. Groups of the first one stay."""
    frames = _tables(tables, "bind_cols")
    names = [n for f in frames for n in f.names]
    new = repaired(names, name_repair)
    out, count, at, columns = None, None, 0, []
    for f in frames:
        inner = [f"__c{at + k}" for k in range(f.ncol)]
        placed, n = position(f.df.toDF(*inner))
        if count is not None and n != count:
            raise EngineError("bind_cols", f"tables have {count} and {n} rows")
        out, count = placed if out is None else out.join(placed, "__position"), n
        columns += [F.col(i).alias(new[at + k]) for k, i in enumerate(inner)]
        at += f.ncol
    first = dict(zip(frames[0].names, new))
    return Frame(out.select(*columns), [first[g] for g in frames[0].groups], frames[0].mode)
