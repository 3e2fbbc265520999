"""Expressions, selections and aggregates that the verbs take."""

from plumbline.functions.aggregates import count, max_, mean, min_, n, row_number, sd, sum_, var
from plumbline.functions.selection import all_of, between, contains, ends_with, everything, exclude, matches, starts_with
from plumbline.functions.terms import Term, c, desc, if_else, lit, quoted

__all__ = ["Term", "all_of", "between", "c", "contains", "count", "desc", "ends_with", "everything", "exclude", "if_else", "lit", "matches", "max_", "mean", "min_", "n", "quoted", "row_number", "sd", "starts_with", "sum_", "var"]
