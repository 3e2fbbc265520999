"""The table: an immutable wrapper of a Spark DataFrame with grouping and an execution mode.

Verbs only build plans; Catalyst optimises them, and nothing runs before ``collect``, ``compute`` or a write. In the mode
"eager" a verb's arguments are checked as it is called, which Spark's analysis does in both modes; the mode is kept for
``is_lazy`` and ``has_pending_ops``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import EngineError
from plumbline.functions.terms import quoted
from plumbline.sources.shared import stored

MODES = ("eager", "lazy")
MODE_OPTION, MODE_VARIABLE = "spark.plumbline.mode", "PLUMBLINE_MODE"


def resolve_mode(lazy: bool | None, df: DataFrame) -> str:
    """The argument, else the session's option, else the environment's variable, else eager."""
    if lazy is not None:
        return "lazy" if lazy else "eager"
    mode = df.sparkSession.conf.get(MODE_OPTION, None) or os.environ.get(MODE_VARIABLE) or "eager"
    if mode not in MODES:
        raise EngineError("tbl", f"mode must be one of {', '.join(MODES)}, not '{mode}'")
    return mode


class Frame:
    """Verbs are methods; they live in ``plumbline.operators`` and ``plumbline.plans``."""

    __slots__ = ("computed", "df", "groups", "mode")

    def __init__(self, df: DataFrame, groups: Sequence[str] = (), mode: str = "eager", computed: bool = False):
        self.df, self.groups, self.mode, self.computed = df, tuple(groups), mode, computed

    def _with(self, df: DataFrame, groups: Sequence[str] | None = None, computed: bool = False) -> Frame:
        return Frame(df, self.groups if groups is None else groups, self.mode, computed)

    # --- names, dimensions and types ---

    @property
    def names(self) -> list[str]:
        return self.df.columns

    def set_names(self, names: Sequence[str]) -> Frame:
        """All columns renamed, in order."""
        names = list(names)
        if not all(n is None or isinstance(n, str) for n in names):
            raise EngineError("names", "names must be strings")
        if len(names) != len(self.names):
            raise EngineError("names", f"{len(self.names)} names are needed, not {len(names)}")
        if any(n is None for n in names):
            raise EngineError("names", "names must not be missing")
        if any(n == "" for n in names):
            raise EngineError("names", "names must not be empty")
        new = dict(zip(self.names, names))
        return self._with(self.df.toDF(*names), [new[g] for g in self.groups])

    @property
    def ncol(self) -> int:
        return len(self.names)

    @property
    def nrow(self) -> int | None:
        """The number of rows; unknown (None) for a lazy table that was not computed, as counting runs the plan."""
        return self.df.count() if self.mode == "eager" or self.computed else None

    @property
    def dim(self) -> tuple[int | None, int]:
        return self.nrow, self.ncol

    @property
    def types(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    @property
    def schema(self):
        """The schema of the result, inferred without running anything."""
        return self.df.schema

    @property
    def group_vars(self) -> list[str]:
        return list(self.groups)

    def levels(self, name: str) -> list[str] | None:
        """The levels of a factor column."""
        return self.df.schema[name].metadata.get("levels")

    def column(self, name: str, operation: str) -> Column:
        if name not in self.names:
            raise EngineError(operation, f"column '{name}' not found; there are {', '.join(self.names)}")
        return quoted(name)

    def __repr__(self) -> str:
        kinds = ", ".join(f"{n} <{short_type(t)}>" for n, t in self.df.dtypes)
        grouped = f", grouped by {', '.join(self.groups)}" if self.groups else ""
        return f"<Frame [{'?' if self.mode == 'lazy' and not self.computed else 'rows on demand'} x {self.ncol}] {self.mode}{grouped}: {kinds}>"

    def glimpse(self, rows: int = 10, width: int = 80) -> str:
        """A preview: a line for each column with its type and first values."""
        head = self.df.limit(rows).collect()
        wide = max(map(len, self.names), default=0)
        lines = [f"Columns: {self.ncol}" + (f"   Groups: {', '.join(self.groups)}" if self.groups else "")]
        for k, (name, kind) in enumerate(self.df.dtypes):
            line = f"$ {name:<{wide}} <{short_type(kind)}> " + ", ".join("NA" if r[k] is None else str(r[k]) for r in head)
            lines.append(line if len(line) <= width else line[: width - 3] + "...")
        return "\n".join(lines)


def short_type(kind: str) -> str:
    """Types as they are printed."""
    short = {"double": "dbl", "float": "flt", "bigint": "i64", "int": "int", "smallint": "i16", "tinyint": "i8", "boolean": "lgl", "string": "chr", "date": "date", "timestamp": "dttm", "timestamp_ntz": "dttm"}
    return short.get(re.sub(r"\(.*", "", kind), "???")


def position(df: DataFrame, name: str = "__position") -> tuple[DataFrame, int]:
    """The frame with each row's place (0, 1, ..) in partition order, and the number of rows.

    The rows are written once with their partition and their number in it, and both the sizes of the partitions and the places
    come from that table: two runs of a plan may cut its shuffles differently. What is joined to the rows is one row for each
    partition. The order is that of the files for scans, and the sorted one after ``arrange``; after another shuffle it is any.
    """
    inner = [f"c{k}" for k in range(len(df.columns))]
    marked = df.toDF(*inner).withColumn("id", F.monotonically_increasing_id())
    void = [f.name for f in marked.schema if f.dataType.typeName() == "void"]
    marked = stored(marked.drop(*void), "positions")
    sizes = sorted((p, n) for p, n in marked.groupBy(F.shiftright("id", 33)).count().collect())  # one row for each partition
    begins, total = [], 0
    for p, n in sizes:
        begins.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(begins or [(0, 0)], "part long, begin long")
    placed = marked.join(F.broadcast(offsets), F.shiftright("id", 33) == F.col("part"))
    metadata = {k: f.metadata for k, f in zip(inner, df.schema)}
    columns = [(F.lit(None) if k in void else F.col(k)).alias(n, metadata=metadata[k]) for k, n in zip(inner, df.columns)]
    return placed.select(*columns, (F.col("id").bitwiseAND((1 << 33) - 1) + F.col("begin")).alias(name)), total
