"""Outcomes of store operations that are not plain success."""


class StoreError(Exception):
    """Base of all store errors."""


class NotFound(StoreError):
    """The key or table does not exist."""


class Corruption(StoreError):
    """Stored data fails a check."""


class NotSupported(StoreError):
    """The operation does not apply in the table's present state."""


class InvalidArgument(StoreError, ValueError):
    """An argument is outside its range."""


class IOFault(StoreError, OSError):
    """The storage below failed."""

class Conflict(StoreError):
    """Another writer has published a version first."""
