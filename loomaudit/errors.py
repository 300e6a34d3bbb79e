"""Errors of the engine; all derive from :class:`AuditError`."""

from __future__ import annotations


class AuditError(Exception):
    """Base of all errors raised on purpose."""


class InputError(AuditError):
    """Data that cannot be read; names the path, table or column."""

    def __init__(self, message: str, path: object = None, table: str | None = None, column: str | None = None):
        super().__init__(message)
        self.path, self.table, self.column = path, table, column


class SchemaError(InputError):
    """A required column is missing or malformed."""


class TaskSpecError(AuditError):
    """A task specification that contradicts itself or cannot be parsed."""


class SplitsError(AuditError):
    """Splits that cannot be read or mapped."""


class CheckError(AuditError):
    """A check that fabricated evidence; names the check."""

    def __init__(self, message: str, check_id: str | None = None):
        super().__init__(message)
        self.check_id = check_id


class RegistryError(AuditError):
    """An unknown, unnamed or doubly registered check."""


class ReportError(AuditError):
    """A report that cannot be written."""
