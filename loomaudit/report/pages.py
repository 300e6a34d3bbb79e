"""One page a check: what it asks, and what it says of a clean cohort and of one with its leak."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..audit import run_audit
from ..operators.registry import all_checks
from ..synth.generate import generate
from ..synth.inject import INJECTORS, inject


def check_page(spark: SparkSession, check, n: int = 120, seed: int = 0, subjects: int = 4) -> str:
    clean = generate(spark, n, seed)
    lines = [f"# {check.id} {check.name}", "", f"Severity: {check.severity}", "", check.description, "", f"Why: {check.rationale}", ""]
    cases = [("clean cohort", clean)]
    if check.id in INJECTORS:
        cases.append(("cohort with the leak", inject(clean, check.id, subjects)[0]))
    for title, cohort in cases:
        report = run_audit(cohort.context(), [check.id])
        lines += [f"## On a {title}", ""]
        lines += [f"- {f.name}: {f.message} ({'fires' if f.fired else 'does not fire'})" for f in report.findings]
        lines += [f"- skipped: {s.reason}" for s in report.skipped]
        for f in report.fired[:1]:
            lines += ["", "Relation:", "", f"    {f.query}", "", "Evidence:", ""]
            names = list(f.examples[0])
            lines += ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
            lines += ["| " + " | ".join("" if e[c] is None else str(e[c]).replace("|", "\\|") for c in names) + " |" for e in f.examples]
        lines.append("")
    return "\n".join(lines)


def write_check_pages(spark: SparkSession, folder, n: int = 120, seed: int = 0, subjects: int = 4) -> list[Path]:
    """A Markdown page for each registered check, and an index of them."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for check in all_checks():
        out.append(folder / f"{check.id}.md")
        out[-1].write_text(check_page(spark, check, n, seed, subjects))
    index = ["# Checks", "", *(f"- [{c.id} {c.name}]({c.id}.md): {c.description}" for c in all_checks()), ""]
    (folder / "index.md").write_text("\n".join(index))
    return [*out, folder / "index.md"]
