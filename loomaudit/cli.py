"""Command line: audit, synth, validate-task, list-checks.

Exit codes: 0 nothing fired at the threshold, 1 something did, 2 wrong usage or input.
"""

from __future__ import annotations

import argparse
import sys

from .audit import VERSION, run_audit
from .errors import AuditError


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("loomaudit").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomaudit", description="Audit prediction datasets for leakage.")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="run checks over a dataset")
    a.add_argument("--data", required=True)
    a.add_argument("--task", required=True)
    a.add_argument("--out")
    a.add_argument("--format", choices=("meds", "omop"), default="meds")
    for name in ("splits", "labels", "features", "encounter-column", "feature-subject-column", "feature-time-column"):
        a.add_argument(f"--{name}")
    a.add_argument("--checks", help="comma-separated ids")
    a.add_argument("--fail-on", default="error")
    a.add_argument("--quiet", action="store_true")
    s = sub.add_parser("synth", help="write a synthetic cohort")
    s.add_argument("--out", required=True)
    s.add_argument("--n-subjects", type=int, default=500)
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--inject", help="comma-separated ids, or all")
    s.add_argument("--positive-rate", type=float, default=0.2)
    s.add_argument("--quiet", action="store_true")
    v = sub.add_parser("validate-task", help="read a task specification")
    v.add_argument("spec")
    sub.add_parser("list-checks", help="show the registered checks")
    return p


def _short(text: str, width: int = 72) -> str:
    return text if len(text) <= width else text[: width - 1] + "…"


def _audit(args) -> int:
    from .operators.registry import resolve_checks
    from .plans.context import AuditContext
    from .report.render import write_report

    if args.fail_on not in ("error", "warning"):
        raise AuditError(f"--fail-on takes error or warning, not {args.fail_on}: observations are no failures")
    checks = [c for c in (args.checks or "").split(",") if c.strip()]
    resolve_checks(checks)
    spark = _session()
    from .sources.files import exists

    for path in (args.data, args.task, args.splits, args.labels, args.features):
        if path and not exists(path):
            raise AuditError(f"no such path: {path}")
    if (args.feature_subject_column or args.feature_time_column) and not args.features:
        raise AuditError("--feature-subject-column and --feature-time-column need --features")
    more = {"feature_subject": args.feature_subject_column, "feature_time": args.feature_time_column}
    more |= {"encounter_column": args.encounter_column} if args.format == "meds" else {}
    build = AuditContext.from_meds if args.format == "meds" else AuditContext.from_omop
    ctx = build(spark, args.data, args.task, args.splits, args.labels, args.features, **more)
    report = run_audit(ctx, checks, args.fail_on)
    if args.out:
        write_report(report, args.out)
    if not args.quiet:
        for s in report.skipped:
            print(f"SKIPPED {s.check_id} {s.name}: {_short(s.reason)}")
        for f in report.fired:
            print(f"{str(f.severity).upper()} {f.check_id} {f.name}: {_short(f.message)}")
        print(f"{len(report.fired)} finding(s), {len(report.skipped)} skipped; exit {report.exit_code}")
    return report.exit_code


def _synth(args) -> int:
    from .synth.generate import generate
    from .synth.inject import inject_many

    data = generate(_session(), args.n_subjects, args.seed, args.positive_rate)
    if args.inject:
        data, _ = inject_many(data, None if args.inject == "all" else args.inject.split(","))
    data.write(args.out)
    if not args.quiet:
        print(f"wrote {args.n_subjects} subjects to {args.out}; planted: {', '.join(sorted(data.planted or {})) or 'nothing'}")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        if args.command == "audit":
            return _audit(args)
        if args.command == "synth":
            return _synth(args)
        if args.command == "validate-task":
            from .plans.task import TaskSpec

            task = TaskSpec.from_yaml(args.spec)
            for key, value in task.describe().items():
                print(f"{key}: {value}")
            for w in task.warnings():
                print(f"warning: {w}")
            return 0
        from .operators.registry import all_checks

        for c in all_checks():
            print(f"{c.id}  {c.severity!s:8} {c.name}: {_short(c.description)}")
        return 0
    except (AuditError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
