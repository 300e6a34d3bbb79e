"""The declarative task: index event, outcome, horizon, follow-up and split rules."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import timedelta
from pathlib import Path

from ..errors import TaskSpecError
from ..functions.normalize import DEATH

#: Days of each unit: fixed values.
UNIT_DAYS = {"d": 1.0, "w": 7.0, "m": 30.4375, "y": 365.25}
STRATEGIES = ("subject", "encounter", "temporal", "random")
_DURATION = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*([dwmy])\s*$", re.IGNORECASE)


def _strict(cls, data, where: str):
    if not isinstance(data, dict):
        raise TaskSpecError(f"{where}: expected a mapping, found {type(data).__name__}")
    names = {f.name for f in fields(cls)}
    unknown = sorted(set(data) - names)
    if unknown:
        raise TaskSpecError(f"{where}: unknown key(s) {', '.join(unknown)}; known are {', '.join(sorted(names))}")
    return data


@dataclass(frozen=True)
class Duration:
    n: float
    unit: str

    def __post_init__(self):
        if not self.n > 0 or self.unit not in UNIT_DAYS:
            raise TaskSpecError(f"duration must be positive, in d, w, m or y; found {self.n}{self.unit}")

    @classmethod
    def parse(cls, value) -> Duration:
        if isinstance(value, Duration):
            return value
        if isinstance(value, dict):
            return cls(**_strict(cls, value, "duration"))
        hit = _DURATION.match(str(value))
        if not hit or float(hit[1]) <= 0:
            raise TaskSpecError(f"cannot read duration {value!r}; write a positive number and d, w, m or y, such as 30d, 6m or 2y")
        return cls(float(hit[1]), hit[2].lower())

    @property
    def days(self) -> float:
        return self.n * UNIT_DAYS[self.unit]

    def to_timedelta(self) -> timedelta:
        return timedelta(days=self.days)

    def __str__(self) -> str:
        return f"{self.n:g}{self.unit}"


@dataclass(frozen=True)
class CodeSet:
    values: tuple[str, ...]
    system: str | None = None

    def __post_init__(self):
        kept = tuple(v.strip() for v in map(str, self.values) if v.strip())
        if not kept:
            raise TaskSpecError("a code set needs at least one code")
        object.__setattr__(self, "values", kept)


def code_sets(value, where: str) -> tuple[CodeSet, ...]:
    """Code sets from a list of codes, one mapping, or a list of mappings."""
    if value is None:
        return ()
    if isinstance(value, (dict, CodeSet)):
        value = [value]
    if isinstance(value, str):
        value = [value]
    if value and all(isinstance(v, (str, int)) for v in value):
        return (CodeSet(tuple(map(str, value))),)
    out = []
    for v in value:
        if isinstance(v, CodeSet):
            out.append(v)
        else:
            v = _strict(CodeSet, v, where)
            out.append(CodeSet(tuple(v.get("values") or ()), v.get("system")))
    return tuple(out)


@dataclass(frozen=True)
class IndexDef:
    event: str | None = None
    code_system: str | None = None
    occurrence: str = "first"

    def __post_init__(self):
        if self.occurrence not in ("first", "last"):
            raise TaskSpecError(f"index.occurrence must be first or last, found {self.occurrence!r}")


@dataclass(frozen=True)
class OutcomeDef:
    codes: tuple[CodeSet, ...] = ()
    window: tuple[str, str] | None = None
    proxy_codes: tuple[CodeSet, ...] = ()
    competing_codes: tuple[CodeSet, ...] = (CodeSet((DEATH,)),)

    def __post_init__(self):
        for name in ("codes", "proxy_codes", "competing_codes"):
            object.__setattr__(self, name, code_sets(getattr(self, name), f"outcome.{name}"))
        if self.window is not None:
            if len(self.window) != 2:
                raise TaskSpecError("outcome.window needs exactly two bounds")
            object.__setattr__(self, "window", tuple(map(str, self.window)))


@dataclass(frozen=True)
class FollowUp:
    require_full_horizon_for_negatives: bool = True
    min_days: float | None = None
    allow_death_as_censoring: bool = True


@dataclass(frozen=True)
class SplitRules:
    strategy: str = "subject"
    temporal: bool = False
    group_column: str | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise TaskSpecError(f"splits.strategy must be one of {', '.join(STRATEGIES)}, found {self.strategy!r}")


@dataclass(frozen=True)
class TaskSpec:
    task: str
    index: IndexDef = field(default_factory=IndexDef)
    outcome: OutcomeDef = field(default_factory=OutcomeDef)
    horizon: Duration | None = None
    followup: FollowUp = field(default_factory=FollowUp)
    exclusion: tuple = ()
    splits: SplitRules = field(default_factory=SplitRules)
    description: str | None = None

    def __post_init__(self):
        if self.followup.require_full_horizon_for_negatives and self.horizon is None:
            raise TaskSpecError("followup.require_full_horizon_for_negatives needs a horizon; set one or turn the rule off")

    @classmethod
    def from_dict(cls, data: dict) -> TaskSpec:
        data = dict(_strict(cls, data, "task"))
        if "task" not in data:
            raise TaskSpecError("task: the key task is missing")
        for name, node in (("index", IndexDef), ("outcome", OutcomeDef), ("followup", FollowUp), ("splits", SplitRules)):
            if data.get(name) is None:
                data.pop(name, None)
            elif isinstance(data[name], dict):
                data[name] = node(**_strict(node, data[name], name))
        if data.get("horizon") is not None:
            data["horizon"] = Duration.parse(data["horizon"])
        data["exclusion"] = tuple(data.get("exclusion") or ())
        return cls(**data)

    @classmethod
    def from_yaml(cls, path) -> TaskSpec:
        import yaml

        try:
            data = yaml.safe_load(Path(path).read_text())
        except (OSError, yaml.YAMLError) as error:
            raise TaskSpecError(f"cannot read task specification {path}: {error}") from error
        return cls.from_dict(data)

    def to_dict(self) -> dict:
        def plain(x):
            if isinstance(x, Duration):
                return str(x)
            if is_dataclass(x):
                return {f.name: plain(getattr(x, f.name)) for f in fields(x)}
            return [plain(v) for v in x] if isinstance(x, (tuple, list)) else x

        return plain(self)

    def to_yaml(self, path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True))

    def describe(self) -> dict:
        count = lambda sets: sum(len(s.values) for s in sets)
        return {
            "task": self.task,
            "description": self.description,
            "index": asdict(self.index),
            "outcome_codes": count(self.outcome.codes),
            "proxy_codes": count(self.outcome.proxy_codes),
            "competing_codes": count(self.outcome.competing_codes),
            "horizon": None if self.horizon is None else str(self.horizon),
            "strategy": self.splits.strategy,
            "exclusion": list(self.exclusion),
        }

    def warnings(self) -> list[str]:
        out = []
        if not self.outcome.codes:
            out.append("no outcome codes: LK002, LK007 and LK010 will be skipped")
        if not self.outcome.proxy_codes:
            out.append("no proxy codes: LK003 will be skipped")
        if self.horizon is None:
            out.append("no horizon: LK004, LK007 and LK010 will be skipped")
        elif not self.followup.require_full_horizon_for_negatives:
            out.append("full follow-up is not required: LK004 will be skipped")
        if self.index.event is None:
            out.append("no index event: index dates must come from labels")
        return out
