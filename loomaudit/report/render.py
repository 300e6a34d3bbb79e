"""Reports as one self-contained HTML page, Markdown, JSON and JSON lines."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from ..audit import AuditReport
from ..errors import ReportError
from ..plans.evidence import jsonable

_STYLE = "body{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto;padding:0 1em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.2em .6em;text-align:left}.tile{display:inline-block;border:1px solid #bbb;padding:.5em 1em;margin:.3em}.error{color:#a00}.warning{color:#960}code{white-space:pre-wrap}"


def _bars(title: str, rows: list[tuple[str, float, str]]) -> str:
    """Horizontal bars as inline SVG; zeros say none."""
    top = max([v for _, v, _ in rows] or [0]) or 1
    parts = []
    for i, (name, value, text) in enumerate(rows):
        y = 24 * i
        parts.append(f'<text x="0" y="{y + 16}">{escape(name)}</text><rect x="160" y="{y + 4}" width="{value / top * 260:.1f}" height="16" fill="#57a"></rect>')
        parts.append(f'<text x="{168 + value / top * 260:.1f}" y="{y + 16}">{escape(text if value else "none")}</text>')
    return f'<figure><figcaption>{escape(title)}</figcaption><svg width="560" height="{24 * len(rows)}" font-size="13">{"".join(parts)}</svg></figure>'


def _table(rows: list[dict]) -> str:
    if not rows:
        return ""
    head = "".join(f"<th>{escape(str(k))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in jsonable(r).values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def render_html(report: AuditReport) -> str:
    s, e = report.summary(), lambda x: escape(str(x))
    out = ["<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Leakage audit</title>", f"<style>{_STYLE}</style></head><body><h1>Leakage audit</h1>"]
    out.append("".join(f"<div class='tile'><b>{e(s[k])}</b><br>{e(k[2:].replace('_', ' '))}</div>" for k in ("n_checks", "n_fired", "n_passed", "n_skipped", "n_subjects", "n_events")))
    out.append(f"<p><b>{'PASS' if report.ok else 'FAIL'}</b> at severity {e(report.fail_on)}</p>")
    if report.skipped:
        out.append(f"<p><b>{len(report.skipped)} check(s) were skipped; a skipped check is not a passed check.</b></p>")
    if report.warnings:
        out.append("<h2>Warnings</h2><ul>" + "".join(f"<li>{e(w)}</li>" for w in report.warnings) + "</ul>")
    out.append("<h2>Skipped</h2>" + _table([x.to_dict() for x in report.skipped]) if report.skipped else "")
    out.append(_bars("Checks by outcome", [(n, s[k], str(s[k])) for n, k in (("error", "n_errors"), ("warning", "n_warnings"), ("passed", "n_passed"), ("skipped", "n_skipped"))]))
    if report.fired:
        out.append(_bars("Affected share of subjects", [(f"{f.check_id}", f.subject_rate or 0, f"{(f.subject_rate or 0):.1%}") for f in report.fired]))
    task = {k: v for k, v in (report.data.get("task") or {}).items()}
    out.append("<h2>Task</h2>" + _table([{"key": k, "value": json.dumps(jsonable(v), ensure_ascii=False)} for k, v in task.items()]) if task else "")
    out.append("<h2>Data</h2>" + _table([{"key": k, "value": json.dumps(jsonable(v), ensure_ascii=False)} for k, v in report.data.items()]))
    for title, found in (("Findings", report.fired), ("Observations", [f for f in report.passed if f.n_rows]), ("Passed", [f for f in report.passed if not f.n_rows])):
        out.append(f"<h2>{title}</h2>")
        for f in found:
            out.append(f"<h3 class='{e(f.severity)}'>{e(f.check_id)} {e(f.name)}</h3><p>{e(f.message)}</p>")
            if f.n_rows:
                out.append(_table(list(f.examples)) + f"<p><code>{e(f.query)}</code></p><p>{e(json.dumps(jsonable(f.detail), ensure_ascii=False))}</p>")
    return "".join(out) + "</body></html>"


def render_markdown(report: AuditReport) -> str:
    s = report.summary()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out = ["# Leakage audit", "", f"**{'PASS' if report.ok else 'FAIL'}** at severity {report.fail_on}", ""]
    if report.skipped:
        out += ["## Skipped", "", "A skipped check is not a passed check.", "", "| check | reason |", "| --- | --- |"]
        out += [f"| {x.check_id} {x.name} | {cell(x.reason)} |" for x in report.skipped] + [""]
    if report.warnings:
        out += ["## Warnings", "", *(f"- {w}" for w in report.warnings), ""]
    out += ["## Summary", "", "| key | value |", "| --- | --- |", *(f"| {k} | {cell(v)} |" for k, v in s.items()), ""]
    out += ["## Data", "", "| key | value |", "| --- | --- |", *(f"| {k} | {cell(json.dumps(jsonable(v), ensure_ascii=False))} |" for k, v in report.data.items()), ""]
    for title, found in (("Findings", report.fired), ("Observations", [f for f in report.passed if f.n_rows]), ("Passed", [f for f in report.passed if not f.n_rows])):
        out += [f"## {title}", ""]
        for f in found:
            out += [f"### {f.check_id} {f.name} ({f.severity})", "", f.message, ""]
            if f.examples:
                names = list(f.examples[0])
                out += ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
                out += ["| " + " | ".join(cell(x.get(n)) for n in names) + " |" for x in f.examples] + [""]
    return "\n".join(out)


def write_report(report: AuditReport, folder) -> list[Path]:
    """report.html, report.md, report.json and findings.jsonl."""
    folder = Path(folder)
    try:
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "report.html").write_text(render_html(report))
        (folder / "report.md").write_text(render_markdown(report))
        report.write_json(folder / "report.json")
        report.write_findings_jsonl(folder / "findings.jsonl")
    except OSError as error:
        raise ReportError(f"cannot write the report to {folder}: {error}") from error
    return sorted(folder.glob("*.*"))
