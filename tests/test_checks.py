import pytest

from loomaudit.audit import run_audit
from loomaudit.errors import CheckError, RegistryError
from loomaudit.operators import registry
from loomaudit.plans.context import AuditContext
from loomaudit.plans.evidence import Finding, Severity
from loomaudit.plans.task import TaskSpec
from loomaudit.functions.normalize import empty_events
from loomaudit.synth.generate import generate
from loomaudit.synth.inject import inject, inject_many, injector_ids


@pytest.fixture(scope="module")
def clean(spark):
    data = generate(spark, 120, 0)
    return data.replace(events=data.events.persist(), labels=data.labels.persist(), splits=data.splits.persist())


def test_clean_cohort(clean):
    report = run_audit(clean.context())
    assert report.ok and not report.fired and not report.skipped
    info = report.finding("LK001")
    assert info.severity is Severity.INFO and info.n_subjects == 120
    sizes = {r.split: r.n for r in clean.splits.groupBy("split").count().withColumnRenamed("count", "n").collect()}
    assert sizes == {"train": 72, "valid": 24, "test": 24}


@pytest.mark.parametrize("check_id", injector_ids())
def test_duality(clean, check_id):
    data, planted = inject(clean, check_id, 3)
    report = run_audit(data.context(), [check_id])
    found = report.finding(check_id)
    assert found.fired and set(planted.subjects) <= set(found.subjects) and found.examples
    assert report.exit_code == (1 if found.severity is Severity.ERROR else 0)


def test_all_leaks_at_once(clean):
    data, planted = inject_many(clean, n=2)
    listed = [s for p in planted for s in p.subjects]
    assert len(listed) == len(set(listed))
    report = run_audit(data.context(), fail_on="warning")
    assert {f.check_id for f in report.fired} == set(injector_ids()) and report.exit_code == 1
    with pytest.raises(ValueError):
        inject(clean, "LK002", 200)


def test_partitions_do_not_matter(clean):
    data, _ = inject_many(clean, ["LK002", "LK010"], n=2)
    one = run_audit(data.replace(events=data.events.coalesce(1)).context(), ["LK002", "LK010"])
    two = run_audit(data.replace(events=data.events.repartition(8)).context(), ["LK002", "LK010"])
    assert [f.to_dict() for f in one.findings] == [f.to_dict() for f in two.findings]
    assert one.data["data_hash"] == two.data["data_hash"]


def test_empty_input_skips_everything(spark):
    task = TaskSpec.from_dict({"task": "t", "index": {"event": "x"}, "horizon": "1y"})
    report = run_audit(AuditContext(empty_events(spark), task))
    assert len(report.skipped) == 10 and report.exit_code == 0
    reasons = {s.check_id: s.reason for s in report.skipped}
    assert "encounter" in reasons["LK002"] and "proxy" in reasons["LK003"] and "split" in reasons["LK005"]


def test_coarse_signatures(spark):
    rows = [(f"s{i}", None, c) for i in range(30) for c in ("F", f"R{i % 3}")]
    events = spark.createDataFrame(rows, "subject_id string, time timestamp_ntz, code string")
    task = TaskSpec.from_dict({"task": "t", "followup": {"require_full_horizon_for_negatives": False}})
    report = run_audit(AuditContext(events, task), ["LK009"])
    assert "arithmetic rather than evidence" in report.skipped[0].reason


def test_fabricated_evidence_and_crashes(clean):
    state = registry.snapshot()
    try:

        @registry.register_check("X1", "ghost")
        def ghost(ctx):
            """Names nobody."""
            return [Finding("X1", "ghost", Severity.ERROR, "m", 1, 1, 1, ("NOT_A_SUBJECT",), ({"subject_id": "NOT_A_SUBJECT"},))]

        @registry.register_check("X2", "crash")
        def crash(ctx):
            raise KeyError("boom")

        assert registry.get_check(" x1 ").description == "Names nobody."
        with pytest.raises(RegistryError):
            registry.register_check("X1", "again")(crash)
        with pytest.raises(CheckError):
            run_audit(clean.context(), ["X1"])
        assert "KeyError" in run_audit(clean.context(), ["X2"]).skipped[0].reason
    finally:
        registry.restore(state)
    with pytest.raises(RegistryError):
        registry.get_check("X1")
    with pytest.raises(ValueError):
        Finding("X", "x", Severity.ERROR, "m", 1, 1, 1)
