"""Findings and the bounded evidence that goes with them."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_EXAMPLES = 10
MAX_SUBJECTS = 50


class Severity(IntEnum):
    INFO = 0
    WARNING = 1
    ERROR = 2

    @classmethod
    def of(cls, value: str | Severity) -> Severity:
        return value if isinstance(value, Severity) else cls[str(value).strip().upper()]

    def __str__(self) -> str:
        return self.name.lower()


def jsonable(value: Any) -> Any:
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    return str(value)


@dataclass(frozen=True)
class Finding:
    check_id: str
    name: str
    severity: Severity
    message: str
    n_rows: int
    n_subjects: int
    total: int
    subjects: tuple[str, ...] = ()
    examples: tuple[dict, ...] = ()
    example_schema: Any = None
    query: str = ""
    detail: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.severity is not Severity.INFO and self.n_subjects > 0 and not self.examples:
            raise ValueError(f"{self.check_id} claims {self.n_subjects} subject(s) without an example")

    @property
    def fired(self) -> bool:
        return self.severity is not Severity.INFO and self.n_subjects > 0

    @property
    def subject_rate(self) -> float | None:
        return self.n_subjects / self.total if self.total else None

    def to_dict(self) -> dict:
        return {
            "check_id": self.check_id,
            "name": self.name,
            "severity": str(self.severity),
            "fired": self.fired,
            "message": self.message,
            "n_rows": self.n_rows,
            "n_subjects": self.n_subjects,
            "total": self.total,
            "subject_rate": self.subject_rate,
            "subjects": list(self.subjects),
            "examples": jsonable(list(self.examples)),
            "query": self.query,
            "detail": jsonable(self.detail),
        }

    def examples_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(e.values()) for e in self.examples], self.example_schema)


@dataclass(frozen=True)
class Skipped:
    check_id: str
    name: str
    reason: str

    def __post_init__(self):
        if not self.reason.strip():
            raise ValueError(f"{self.check_id} was skipped without a reason")

    def to_dict(self) -> dict:
        return {"check_id": self.check_id, "name": self.name, "reason": self.reason}


def sort_keys(df: DataFrame) -> list:
    """A total order: subject, time and code, then all other sortable columns, nulls last."""
    first = [c for c in ("subject_id", "time", "code") if c in df.columns]
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    rest = sorted(f.name for f in df.schema.fields if f.name not in first and not isinstance(f.dataType, nested))
    return [F.col(c).asc_nulls_last() for c in (*first, *rest)]


def top_rows(df: DataFrame, n: int = MAX_EXAMPLES) -> DataFrame:
    return df.orderBy(*sort_keys(df)).limit(n)


def subject_list(df: DataFrame, n: int = MAX_SUBJECTS) -> DataFrame:
    return df.select("subject_id").filter("subject_id is not null").distinct().orderBy("subject_id").limit(n)


def counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("subject_id").alias("n_subjects"))


def unknown_subjects(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed subjects (at most 50) that no input has; of the inputs only these ids are shuffled."""
    met = known.select("subject_id").join(F.broadcast(listed), "subject_id", "left_semi").distinct()
    return listed.join(met, "subject_id", "left_anti")


def make_finding(
    check_id: str,
    name: str,
    severity: Severity,
    message: str,
    offending: DataFrame,
    total: int,
    columns: tuple[str, ...] = (),
    query: str = "",
    detail: dict | None = None,
    keep: bool = True,
) -> Finding:
    """Count the offending rows and fetch ten of them and fifty subjects, no more.

    ``keep`` caches them for these three passes; not for rows as many as the input's.
    """
    offending = offending.persist() if keep else offending
    try:
        rows, subjects = counts(offending).first()
        kept = [c for c in columns if c in offending.columns] or offending.columns
        shown = top_rows(offending).select(*kept) if rows else None
        return Finding(
            check_id,
            name,
            severity,
            message.format(n_rows=rows, n_subjects=subjects),
            rows,
            subjects,
            total,
            tuple(r.subject_id for r in subject_list(offending).collect()) if rows else (),
            tuple(r.asDict() for r in shown.collect()) if rows else (),
            offending.select(*kept).schema,
            query,
            detail or {},
        )
    finally:
        if keep:
            offending.unpersist()
