"""Errors of the typed-table engine."""


class TableError(ValueError):
    """A request that the engine rejects."""


class PermissionDenied(TableError):
    """The role of the user does not allow the request."""
