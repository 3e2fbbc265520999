"""Materialisation, barriers, modes and plans."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

from pyspark.sql.types import StructType

from plumbline.frame import Frame


def compute(frame: Frame, partitions: int | None = None) -> Frame:
    """Runs the plan and keeps the result on the executors (in memory, else on their disks); lost parts are computed again.

    ``partitions`` deals the rows evenly to so many first, where a plan leaves them in a few (a file of one row group is one task,
    and so would be all that reads the kept result); rows then have no order.
    """
    if frame.computed:
        return frame
    df = (frame.df if partitions is None else frame.df.repartition(partitions)).persist()
    df.count()
    return frame._with(df, computed=True)


def collapse(frame: Frame) -> Frame:
    """An optimisation barrier: the plan so far is planned by itself and kept once it runs; nothing runs now."""
    return frame._with(frame.df.persist())


def release(frame: Frame) -> Frame:
    """Gives back what ``compute`` or ``collapse`` keeps."""
    return Frame(frame.df.unpersist(), frame.groups, frame.mode)


def as_eager(frame: Frame) -> Frame:
    """Computes what is pending."""
    done = compute(frame) if frame.mode == "lazy" else frame
    return Frame(done.df, done.groups, "eager", done.computed)


def as_lazy(frame: Frame) -> Frame:
    return Frame(frame.df, frame.groups, "lazy", frame.computed)


def is_lazy(frame: Frame) -> bool:
    return frame.mode == "lazy"


def has_pending_ops(frame: Frame) -> bool:
    return frame.mode == "lazy" and not frame.computed


def query_text(frame: Frame, mode: str = "formatted") -> str:
    with redirect_stdout(out := io.StringIO()):
        frame.df.explain(mode)
    return out.getvalue()


def plan_size(frame: Frame) -> tuple[int, int]:
    """The depth of the optimised plan and its number of nodes."""
    lines = frame.df._jdf.queryExecution().optimizedPlan().numberedTreeString().splitlines()
    indents = [len(m[1]) for line in lines if (m := re.match(r"\d+ ([ :+-]*)", line))]
    return max(indents, default=0) // 3 + 1, len(indents)


def show_query(frame: Frame, mode: str = "formatted") -> Frame:
    """Prints the plan, its depth and its number of nodes."""
    depth, nodes = plan_size(frame)
    print(f"{query_text(frame, mode)}\nDepth: {depth}\nNodes: {nodes}")
    return frame


def infer_schema(frame: Frame) -> StructType:
    """The result's schema, without running anything."""
    return frame.df.schema
