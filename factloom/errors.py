"""What can go wrong with a request, told apart from what the data refuse."""

from __future__ import annotations


class QueryError(Exception):
    """A request that cannot be served."""


class QueryValidationError(QueryError, ValueError):
    """The request itself is malformed or asks for something its columns do not support."""


class QueryLookupError(QueryError, KeyError):
    """The request names something that does not exist; the message lists what does."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class Refusal(QueryError):
    """The request is well formed, but the data do not allow an answer. ``payload`` says why."""

    def __init__(self, reason: str, **payload: object) -> None:
        super().__init__(reason)
        self.payload = {"status": "refused", "reason": reason, **payload}
