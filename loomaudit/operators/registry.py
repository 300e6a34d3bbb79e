"""Checks and their registry; own checks join the same battery."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from ..errors import RegistryError
from ..plans.evidence import Finding, Severity, Skipped, make_finding


class Check:
    """A check: ``run`` returns findings, none if all is well, or why it skipped."""

    id: str = ""
    name: str = ""
    description: str = ""
    rationale: str = ""
    severity: Severity = Severity.ERROR

    def run(self, ctx) -> list[Finding] | Skipped:
        raise NotImplementedError

    def skip(self, reason: str) -> Skipped:
        return Skipped(self.id, self.name, reason)

    def clean(self, ctx, message: str = "nothing found") -> list[Finding]:
        return [Finding(self.id, self.name, self.severity, message, 0, 0, ctx.n_subjects)]

    def finding(self, ctx, message: str, rows: DataFrame, columns=(), query: str = "", detail=None, total=None, severity=None, name=None) -> Finding:
        total = ctx.n_subjects if total is None else total
        return make_finding(self.id, name or self.name, self.severity if severity is None else severity, message, rows, total, columns, query, detail)

    def metadata(self) -> dict:
        return {"id": self.id, "name": self.name, "severity": str(self.severity), "description": self.description, "rationale": self.rationale}


_checks: dict[str, Check] = {}


def register(check: Check, replace: bool = False) -> Check:
    if not check.id or not check.name:
        raise RegistryError("a check needs an id and a name")
    key = check.id.strip().upper()
    if key in _checks and not replace:
        raise RegistryError(f"check {key} is registered already")
    _checks[key] = check
    return check


def register_check(id: str, name: str, severity: Severity | str = Severity.WARNING, description: str | None = None, rationale: str = "", replace: bool = False) -> Callable:
    """Register a function of the context; the first line of its docstring describes it."""

    def wrap(function: Callable) -> Callable:
        check = Check()
        check.id, check.name, check.rationale, check.severity = id, name, rationale, Severity.of(severity)
        check.description = description or ((function.__doc__ or "").strip().splitlines() or [""])[0]
        check.run = function
        register(check, replace)
        return function

    return wrap


def check_ids() -> list[str]:
    return sorted(_checks)


def all_checks() -> list[Check]:
    return [_checks[i] for i in check_ids()]


def get_check(id: str) -> Check:
    key = id.strip().upper()
    if key not in _checks:
        raise RegistryError(f"unknown check {id!r}; known are {', '.join(check_ids())}")
    return _checks[key]


def resolve_checks(ids: Iterable[str] | None = None) -> list[Check]:
    found = {i.strip().upper(): get_check(i) for i in ids or ()}
    return [found[i] for i in sorted(found)] or all_checks()


def snapshot() -> dict[str, Check]:
    return dict(_checks)


def restore(state: dict[str, Check]) -> None:
    _checks.clear()
    _checks.update(state)


def clear() -> None:
    _checks.clear()
