"""Errors of the engine."""


class GraphError(RuntimeError):
    """Anything the engine refuses."""


class NotFound(GraphError):
    """A node, edge or property that does not exist."""


class QuerySyntaxError(GraphError):
    """Text that the parser does not accept."""

    def __init__(self, message: str):
        super().__init__(f"Parse error: {message}")


class InvalidOperation(GraphError):
    """An operation that makes no sense here."""


class CorruptLog(GraphError):
    """A mutation log in which records are missing or repeated."""


class TransactionError(GraphError):
    """An unknown or finished transaction."""


class Deadlock(TransactionError):
    """A lock request that closes a cycle."""
