"""A PySpark-native analytics engine with a verb-based table API."""

from plumbline.errors import EngineError
from plumbline.frame import Frame
from plumbline.functions import all_of, between, c, contains, count, desc, ends_with, everything, exclude, if_else, lit, matches, max_, mean, min_, n, row_number, sd, starts_with, sum_, var
from plumbline.operators.bind import bind_cols, bind_rows
from plumbline.operators.columns import mutate, rename, select
from plumbline.operators.groups import group_by, summarise, ungroup
from plumbline.operators.joins import full_join, inner_join, left_join, right_join
from plumbline.operators.rows import arrange, filter_, head
from plumbline.plans.control import as_eager, as_lazy, collapse, compute, has_pending_ops, infer_schema, is_lazy, release, show_query
from plumbline.sources.shipping import ship
from plumbline.sources.tables import as_tbl, collect, is_tbl, read, tbl, write

summarize = summarise

# The verbs as methods, so that they can be chained.
for _name, _verb in {
    "select": select, "rename": rename, "mutate": mutate, "filter": filter_, "arrange": arrange, "head": head, "group_by": group_by, "ungroup": ungroup, "summarise": summarise, "summarize": summarise,
    "inner_join": inner_join, "left_join": left_join, "right_join": right_join, "full_join": full_join, "collect": collect, "write": write, "compute": compute, "collapse": collapse,
    "as_eager": as_eager, "as_lazy": as_lazy, "show_query": show_query, "release": release,
}.items():
    setattr(Frame, _name, _verb)

__all__ = [
    "EngineError", "Frame", "all_of", "arrange", "as_eager", "as_lazy", "as_tbl", "between", "bind_cols", "bind_rows", "c", "collapse", "collect", "compute", "contains", "count", "desc", "ends_with",
    "everything", "exclude", "filter_", "full_join", "group_by", "has_pending_ops", "head", "if_else", "infer_schema", "inner_join", "is_lazy", "is_tbl", "left_join", "lit", "matches", "max_", "mean", "min_",
    "mutate", "n", "read", "release", "rename", "right_join", "row_number", "sd", "select", "ship", "show_query", "starts_with", "sum_", "summarise", "summarize", "tbl", "ungroup", "var", "write",
]
