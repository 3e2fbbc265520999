"""Keyed joins. NULL keys match each other; Catalyst picks the physical join."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import EngineError
from plumbline.frame import Frame
from plumbline.functions.terms import quoted
from plumbline.sources.tables import tbl

By = Sequence[str | tuple[str, str]] | dict[str, str] | str | None
_NUMBERS = {"double", "float", "bigint", "int", "smallint", "tinyint", "boolean"}
#: Pairs of rows of one key that make a unit of work, where a join is declared many-to-many.
UNIT = 1 << 20


def keys_of(x: Frame, y: Frame, by: By, operation: str) -> list[tuple[str, str]]:
    """Pairs of a left and a right key; without ``by``, the names that both have, in the left order."""
    if by is None:
        pairs = [(n, n) for n in x.names if n in y.names]
        if not pairs:
            raise EngineError(operation, "the tables have no common names to join by")
    elif isinstance(by, str):
        pairs = [(by, by)]
    elif isinstance(by, dict):
        pairs = list(by.items())
    else:
        pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in by]
    for k, (a, b) in enumerate(pairs):
        x.column(a, operation)
        y.column(b, operation)
        if (a, b) in pairs[:k] or a in [p[0] for p in pairs[:k]] or b in [p[1] for p in pairs[:k]]:
            raise EngineError(operation, f"the key '{a}' occurs more than once")
        s, t = x.types[a], y.types[b]
        if s != t and not (s in _NUMBERS and t in _NUMBERS):
            raise EngineError(operation, f"the keys '{a}' ({s}) and '{b}' ({t}) have different types")
    return pairs


def _spread(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], kind: str, nulls: bool) -> DataFrame:
    """The join of two tables whose result may be far larger than they are, as work of even size.

    Spark deals a join by the bytes that go in, and all pairs of a key are made by one task. Here the pairs of each key with more
    than ``UNIT`` are cut into a x b cells: a left row goes to one of a strips and is copied to all b, a right row the other way
    round, so each pair meets in exactly one cell. Outer joins cut only the side whose rows are all kept. Rows are dealt by their
    number within a partition that is sorted by hash, so a task that runs again deals them alike. The counts read the keys of both
    tables once more; of the cut keys, which are broadcast, there is at most one for each 1,024 rows of the two tables.
    """
    spark = left.sparkSession
    sides = [(left, F.struct(*(l for l, _ in keys)), "l"), (right, F.struct(*(r for _, r in keys)), "r")]
    counts = [df.groupBy(key.alias(f"__k{s}")).agg(F.count(F.lit(1)).alias(f"__n{s}")) for df, key, s in sides]
    a, b = F.col("__nl").cast("double"), F.col("__nr").cast("double")
    units = F.ceil(a * b / UNIT).cast("double")
    of_left = {"inner": F.round(F.sqrt(units * a / b)), "left": units, "right": F.lit(1.0)}[kind]
    of_left = F.greatest(F.lit(1.0), F.least(a, of_left))
    of_right = F.lit(1.0) if kind == "left" else F.greatest(F.lit(1.0), F.least(b, F.ceil(units / of_left).cast("double")))
    cut = counts[0].join(counts[1], F.col("__kl") == F.col("__kr")).where(a * b > UNIT).select(F.col("__kl").alias("__cut"), of_left.cast("long").alias("__a"), of_right.cast("long").alias("__b"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = []
    for df, key, s in sides:
        hashed = [F.col(f.name) for f in df.schema if not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]
        df = df.withColumn(f"__k{s}", key).sortWithinPartitions(F.xxhash64(*hashed)).withColumn("__id", F.monotonically_increasing_id())
        df = df.join(F.broadcast(cut), F.col(f"__k{s}") == F.col("__cut"), "left")
        own, other = ("__a", "__b") if s == "l" else ("__b", "__a")
        df = df.withColumn(f"__own{s}", F.pmod("__id", F.coalesce(own, F.lit(1)))).withColumn(f"__all{s}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)))
        dealt.append(df.drop("__id", "__cut", "__a", "__b").repartition(tasks, *(F.col(n) for n in ((f"__k{s}", "__ownl", "__alll") if s == "l" else (f"__k{s}", "__allr", "__ownr")))))
    met = (F.col("__kl") == F.col("__kr")) & (F.col("__ownl") == F.col("__allr")) & (F.col("__alll") == F.col("__ownr"))
    if not nulls:
        met = reduce(lambda p, q: p & q, (l.isNotNull() for l, _ in keys), met)
    return dealt[0].join(dealt[1].hint("merge"), met, kind)  # a broadcast would be of all copies


def _join(x: Frame, y: Frame | DataFrame, by: By, kind: str, suffix: tuple[str, str], keep: bool, na_matches: str, ordered: bool, relationship: str | None = None) -> Frame:
    operation = f"{kind}_join"
    if na_matches not in ("na", "never"):
        raise EngineError(operation, "na_matches must be 'na' or 'never'")
    if relationship not in (None, "many-to-many"):
        raise EngineError(operation, "relationship must be 'many-to-many' or None")
    y = y if isinstance(y, Frame) else tbl(y, x.df.sparkSession)
    pairs = keys_of(x, y, by, operation)
    right_keys = {b: a for a, b in pairs}
    shown = [n for n in y.names if keep or n not in right_keys]
    clash = set(x.names) & set(shown)
    left_out = {n: n + suffix[0] if n in clash else n for n in x.names}
    right_out = {n: n + suffix[1] if n in clash else n for n in shown}
    inner = lambda side, k: f"__{side}{k}"  # noqa: E731  names that cannot clash while both sides are in one plan
    left = x.df.select(*(quoted(n).alias(inner("l", k)) for k, n in enumerate(x.names)))
    right = y.df.select(*(quoted(n).alias(inner("r", k)) for k, n in enumerate(y.names)))
    if ordered:
        left, right = left.withColumn("__lo", F.monotonically_increasing_id()), right.withColumn("__ro", F.monotonically_increasing_id())
    at = {n: inner("l", k) for k, n in enumerate(x.names)}, {n: inner("r", k) for k, n in enumerate(y.names)}
    kinds = x.types, y.types

    def pair(a: str, b: str) -> tuple[Column, Column]:
        l, r = F.col(at[0][a]), F.col(at[1][b])
        if "boolean" in (kinds[0][a], kinds[1][b]) and kinds[0][a] != kinds[1][b]:
            l, r = l.cast("int"), r.cast("int")
        if relationship and kinds[0][a] != kinds[1][b]:  # both sides are dealt by keys of one type
            common = "double" if {"double", "float"} & {kinds[0][a], kinds[1][b]} else "bigint"
            l, r = l.cast(common), r.cast(common)
        return l, r

    keys = [pair(a, b) for a, b in pairs]
    if relationship:
        joined = _spread(left, right, keys, kind, na_matches == "na")
    else:
        joined = left.join(right, reduce(lambda p, q: p & q, (l.eqNullSafe(r) if na_matches == "na" else l == r for l, r in keys)), {"full": "full", "left": "left", "right": "right", "inner": "inner"}[kind])
    if ordered:
        joined = joined.orderBy(F.col("__lo").asc_nulls_last(), F.col("__ro").asc_nulls_last())
    of_left = dict(pairs)
    out = []
    for n in x.names:
        column = F.col(at[0][n])
        if not keep and n in of_left and kind in ("full", "right"):
            other = F.col(at[1][of_left[n]])
            column = F.coalesce(column, other) if kind == "full" else other
        out.append(column.alias(left_out[n], metadata=x.df.schema[n].metadata) if x.df.schema[n].metadata else column.alias(left_out[n]))
    for n in shown:
        metadata = y.df.schema[n].metadata
        out.append(F.col(at[1][n]).alias(right_out[n], metadata=metadata) if metadata else F.col(at[1][n]).alias(right_out[n]))
    return Frame(joined.select(*out), (), "lazy" if "lazy" in (x.mode, y.mode) else "eager")


def inner_join(x: Frame, y: Frame | DataFrame, by: By = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na", ordered: bool = False, relationship: str | None = None) -> Frame:
    """Pairs of rows with equal keys. ``ordered`` sorts by the places of the left and then the right row.

    ``relationship="many-to-many"`` says that keys have many rows on both sides, so that the result may be far larger than the
    tables; the pairs of a key are then spread over tasks, at the cost of counting the keys first. The rows are the same.
    """
    return _join(x, y, by, "inner", suffix, keep, na_matches, ordered, relationship)


def left_join(x: Frame, y: Frame | DataFrame, by: By = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na", ordered: bool = False, relationship: str | None = None) -> Frame:
    return _join(x, y, by, "left", suffix, keep, na_matches, ordered, relationship)


def right_join(x: Frame, y: Frame | DataFrame, by: By = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na", ordered: bool = False, relationship: str | None = None) -> Frame:
    """The key columns hold the right table's keys."""
    return _join(x, y, by, "right", suffix, keep, na_matches, ordered, relationship)


def full_join(x: Frame, y: Frame | DataFrame, by: By = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na", ordered: bool = False) -> Frame:
    """The key columns hold whichever side's key there is."""
    return _join(x, y, by, "full", suffix, keep, na_matches, ordered)
