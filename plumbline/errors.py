"""One error type for all verbs."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException


class EngineError(Exception):
    """A verb was given something it cannot work with; the message says which operation failed and why."""

    def __init__(self, operation: str, reason: str):
        super().__init__(f"operation '{operation}' failed: {reason}")
        self.operation, self.reason = operation, reason


def explained(operation: str) -> Callable[[Callable], Callable]:
    """Verbs whose plans Spark refuses raise an ``EngineError`` that names the operation; Spark's own error is its cause."""

    def around(verb: Callable) -> Callable:
        @functools.wraps(verb)
        def run(frame, *args, **kwargs):
            try:
                return verb(frame, *args, **kwargs)
            except AnalysisException as error:
                raise EngineError(operation, _reason(error, frame.names)) from error

        return run

    return around


def _reason(error: AnalysisException, names: list[str]) -> str:
    if (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
        missing = (error.getMessageParameters() or {}).get("objectName", "?")
        return f"column {re.sub('`', chr(39), missing)} not found; there are {', '.join(names)}"
    return f"the expression cannot be evaluated. Original error: {str(error).splitlines()[0]}"
