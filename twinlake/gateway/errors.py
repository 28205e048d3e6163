"""Errors by kind, with locations and passwords taken out."""

from __future__ import annotations

from pyspark.errors import PySparkException

from twinlake.sources.registry import redact

#: SQLSTATE classes by kind.
_CLASSES = {"42": "syntax", "22": "data", "08": "connection", "28": "permission", "57": "cancelled", "58": "system", "54": "limit", "0A": "unsupported", "HY": "driver"}


class GatewayError(Exception):
    def __init__(self, kind: str, message: str, sqlstate: str | None = None, condition: str | None = None):
        super().__init__(message)
        self.kind, self.message, self.sqlstate, self.condition = kind, message, sqlstate, condition

    def as_dict(self) -> dict:
        return {"error": self.kind, "message": self.message, "sqlstate": self.sqlstate, "condition": self.condition}


def classify(error: Exception) -> GatewayError:
    if isinstance(error, GatewayError):
        return error
    text = redact(str(error))
    first = text.strip().splitlines()[0] if text.strip() else type(error).__name__
    if isinstance(error, PySparkException):
        state = error.getSqlState()
        return GatewayError(_CLASSES.get((state or "")[:2], "query"), first, state, error.getCondition())
    kind = {ConnectionError: "connection", KeyError: "not_found", ValueError: "invalid", TimeoutError: "timeout"}.get(type(error), "internal")
    return GatewayError(kind, first.strip("'\""))
