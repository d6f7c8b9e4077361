"""Errors with the status that a service would answer with."""


class QueryError(Exception):
    """400: bad request; 404: not found; 410: gone; 412: precondition failed; 501: not supported."""

    def __init__(self, status: int, message: str):
        super().__init__(f"{status}: {message}")
        self.status = status
        self.message = message


def bad(message: str) -> QueryError:
    return QueryError(400, message)


def unsupported(message: str) -> QueryError:
    return QueryError(501, message)
