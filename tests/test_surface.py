import json

import __spark_entry__ as entry
from loomaudit import cli
from loomaudit.audit import run_audit
from loomaudit.report.render import render_html, render_markdown, write_report
from loomaudit.streaming.watch import watch
from loomaudit.synth.generate import generate
from loomaudit.synth.inject import inject_many


def test_cli_and_reports(spark, tmp_path, capsys):
    folder = str(tmp_path / "leaky")
    assert cli.main(["synth", "--out", folder, "--n-subjects", "60", "--inject", "LK002,LK010", "--quiet"]) == 0
    out = tmp_path / "report"
    args = ["audit", "--data", folder, "--task", f"{folder}/task.yaml", "--labels", f"{folder}/labels.parquet", "--checks", "LK002,LK005,LK010", "--out", str(out)]
    # labels carry original ids, the dataset surrogates: either is understood
    assert cli.main(args) == 1
    assert {p.name for p in out.iterdir()} == {"report.html", "report.md", "report.json", "findings.jsonl"}
    report = json.loads((out / "report.json").read_text())
    planted = json.loads((tmp_path / "leaky" / "planted_leaks.json").read_text())
    for f in report["findings"]:
        if f["fired"]:
            assert set(planted[f["check_id"]]) <= set(f["subjects"])
    assert "FAIL" in (out / "report.md").read_text()
    for bad in (["audit", "--data", "/none", "--task", "/none"], ["audit", "--data", folder, "--task", f"{folder}/task.yaml", "--fail-on", "info"], ["audit", "--data", folder, "--task", "x", "--checks", "LK999"], ["nonsense"]):
        assert cli.main(bad) == 2
    assert cli.main(["validate-task", f"{folder}/task.yaml"]) == 0 and "horizon: 2y" in capsys.readouterr().out


def test_report_escapes(spark, tmp_path):
    data, _ = inject_many(generate(spark, 40, 1), ["LK002"], 1)
    report = run_audit(data.context(), ["LK002"])
    report.warnings.append("<script>alert(1)</script>")
    page = render_html(report)
    assert "<script>" not in page and "http://" not in page and "https://" not in page
    assert "LK002" in render_markdown(report) and len(write_report(report, tmp_path)) == 4


def test_stream(spark, tmp_path):
    data, planted = inject_many(generate(spark, 40, 1), ["LK010"], 2)
    source = str(tmp_path / "in")
    data.events.coalesce(1).write.parquet(source)
    seen = {}
    stream = spark.readStream.schema(data.events.schema).parquet(source)
    watch(stream, str(tmp_path / "table"), data.task, seen.__setitem__, str(tmp_path / "check"), ["LK010"]).awaitTermination()
    assert set(planted[0].subjects) <= set(seen[0].finding("LK010").subjects)


def test_entry_contract(spark):
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) >= 43
    assert entry.entry(spark).count() == 118
