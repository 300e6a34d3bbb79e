"""A demonstration that checks itself: planted leaks must be found, a clean cohort must pass.

    python -m loomaudit.demo [folder]

Exit code 0 if every step says what it should, 1 if one does not.
"""

from __future__ import annotations

import sys
import tempfile

from .audit import run_audit
from .plans.task import TaskSpec
from .report.render import write_report
from .synth.generate import generate
from .synth.inject import inject_many

PLANTED = ("LK002", "LK003", "LK005", "LK007", "LK010")


def run(spark, folder: str, n: int = 200, seed: int = 0, say=print) -> bool:
    """The six steps; whether all went as they should."""
    right = True

    def step(k: int, text: str, ok: bool) -> None:
        nonlocal right
        right &= ok
        say(f"{k}. {text}: {'as expected' if ok else 'NOT as expected'}")

    clean = generate(spark, n, seed)
    again = TaskSpec.from_dict(clean.task.to_dict())
    step(1, f"task {again.task} survives its own YAML form", again == clean.task)
    first = run_audit(clean.context())
    step(2, f"clean cohort: {len(first.fired)} finding(s), {len(first.skipped)} skipped", first.ok and not first.fired and not first.skipped)
    leaky, planted = inject_many(clean, PLANTED)
    second = run_audit(leaky.context())
    step(3, f"leaky cohort: {', '.join(sorted({f.check_id for f in second.fired}))} fired", not second.ok)
    found = {p.check_id: set(p.subjects) <= {s for f in second.findings_for(p.check_id) if f.fired for s in f.subjects} for p in planted}
    step(4, f"planted subjects found by {sum(found.values())} of {len(found)} checks", all(found.values()))
    shown = {f.check_id: len(f.examples) for f in second.fired}
    step(5, f"rows of evidence: {shown}", all(shown.values()))
    files = write_report(second, folder)
    step(6, f"{len(files)} report files in {folder}", len(files) == 4)
    return right


def main(argv: list[str] | None = None) -> int:
    from .cli import _session

    args = sys.argv[1:] if argv is None else argv
    return 0 if run(_session(), args[0] if args else tempfile.mkdtemp(prefix="loomaudit-demo-")) else 1


if __name__ == "__main__":
    sys.exit(main())
