import gzip

import pytest
from pyspark.sql import functions as F

import loomaudit
from loomaudit import cli, demo
from loomaudit.audit import run_audit
from loomaudit.errors import SchemaError
from loomaudit.operators import checks as ck
from loomaudit.operators import registry
from loomaudit.plans.evidence import Severity
from loomaudit.report.pages import check_page
from loomaudit.sources import features as fx
from loomaudit.sources import hospital
from loomaudit.sources import splits as sp
from loomaudit.synth.generate import generate


def test_public_names():
    assert len(loomaudit.__all__) >= 52
    for name in loomaudit.__all__:
        assert getattr(loomaudit, name) is not None
    assert loomaudit.run_audit is run_audit and "AuditContext" in dir(loomaudit)
    with pytest.raises(AttributeError):
        loomaudit.nothing


def test_column_names_of_labels_and_matrices(spark):
    for who in ("subject", "ID", "person_id"):
        for when in ("index_time", "TIME", "prediction_time"):
            df = spark.createDataFrame([(1, "2020-01-01 00:00:00", 1)], f"{who} int, {when} string, outcome int")
            assert [(r.subject_id, str(r.index_date), r.label) for r in fx.build_labels(df).collect()] == [("1", "2020-01-01 00:00:00", True)]
    with pytest.raises(SchemaError, match="index date"):
        fx.build_labels(spark.createDataFrame([(1, 1)], "subject_id int, label int"))
    wide = spark.createDataFrame([(1, "2020-01-01", 1, 0, "a", 7, 2.5)], "id int, timestamp string, y int, fold int, split string, visit_id int, dose double")
    matrix = fx.build_feature_matrix(wide)
    assert matrix.features == ("dose",) and matrix.time_column == "timestamp" and matrix.label_column == "y"


def test_splits_views(spark):
    splits = sp.splits_from_mapping(spark, {"test": ["a", "b"], "train": ["b", "c"], "extra": ["b"]})
    assert {r.subject_id: r.splits for r in sp.split_of(splits).collect()} == {"a": ["test"], "b": ["train", "test", "extra"], "c": ["train"]}
    assert sp.describe(splits, "x") == {"source": "x", "names": ["train", "test", "extra"], "sizes": {"train": 2, "test": 2, "extra": 1}, "n_subjects": 3, "n_overlapping_pairs": 3}


def test_report_and_context(spark):
    report = run_audit(generate(spark, 40, 1).context(), ["LK001", "LK005"])
    assert report.by_severity("info") == [] and report.duration_s > 0 and "checks run | 2 of 2" in report.summary_markdown()
    assert {"source_format", "source_path", "n_timed_events", "n_static_events", "dataset_metadata"} <= set(report.data)
    assert report.data["n_timed_events"] + report.data["n_static_events"] == report.data["n_events"]
    no_index = generate(spark, 10, 1)
    ctx = no_index.replace(labels=no_index.labels.limit(0)).context()
    assert any("no subject has an index date" in w for w in ctx.warnings())
    state = registry.snapshot()
    try:
        registry.register_check("ZZ1", "own")(lambda ctx: [])
        assert registry.get_check("zz1").severity is Severity.WARNING
    finally:
        registry.restore(state)


def test_many_subjects_of_one_signature_and_one_group(spark):
    signed = spark.range(5000).select(F.concat(F.lit("S"), F.lpad("id", 5, "0")).alias("subject_id"), F.array(F.lit("a"), F.lit("b")).alias("codes"), F.lit("a|b").alias("signature"), F.lit(2).cast("bigint").alias("n_facts"))
    got = ck.duplicate_subjects(signed).select("n_subject_ids", "subject_ids").distinct().collect()
    assert len(got) == 1 and got[0].n_subject_ids == 5000 and got[0].subject_ids.split(",") == [f"S{i:05d}" for i in range(50)]
    events = spark.range(3000).select(F.col("id").cast("string").alias("subject_id"), F.lit("one").alias("site"))
    splits = events.select("subject_id", F.when(F.col("subject_id").cast("int") % 2 == 0, "train").otherwise("test").alias("split"))
    rows = ck.straddling_members(events, splits, "site")
    assert rows.count() == 3000 and rows.first().splits == "test,train"


def test_matrix_options_of_the_command_line(spark, tmp_path, capsys):
    folder = str(tmp_path / "cohort")
    data = generate(spark, 40, 3)
    data.write(folder)
    late = data.labels.select(F.col("subject_id").alias("who"), (F.col("index_date") + F.expr("interval 2 days")).alias("seen"), F.lit(1.0).alias("dose"))
    late.write.parquet(f"{folder}/matrix.parquet")
    args = ["audit", "--data", folder, "--task", f"{folder}/task.yaml", "--labels", f"{folder}/labels.parquet", "--checks", "LK001"]
    assert cli.main([*args, "--features", f"{folder}/matrix.parquet", "--feature-subject-column", "who", "--feature-time-column", "seen"]) == 1
    assert "post_index_features_matrix" in capsys.readouterr().out
    renamed = late.withColumnRenamed("who", "subject_id")
    renamed.write.parquet(f"{folder}/named.parquet")
    assert cli.main([*args, "--features", f"{folder}/named.parquet", "--feature-time-column", "seen"]) == 1
    assert cli.main([*args, "--feature-time-column", "seen"]) == 2


def test_demo_and_pages(spark, tmp_path):
    said = []
    assert demo.run(spark, str(tmp_path / "demo"), 80, 1, said.append) and len(said) == 6
    page = check_page(spark, registry.get_check("LK010"), 60)
    assert "does not fire" in page and "(fires)" in page and "Evidence" in page


def test_hospital_tables(spark, tmp_path):
    write = lambda name, text: gzip.open(tmp_path / f"{name}.csv.gz", "wt").write(text)
    write("patients", "subject_id,gender,anchor_age,dod\n007,F,61,\n008,M,50,2021-03-01 00:00:00\n")
    write("admissions", "subject_id,hadm_id,admittime,admission_type,race\n007,1,2020-01-01 08:00:00,EMERGENCY,X\n007,2,2020-02-01 08:00:00,ELECTIVE,X\n008,3,2021-01-01 00:00:00,,\n")
    write("diagnoses", "subject_id,hadm_id,icd_code,icd_version\n007,2,E11,10\n008,3,I10,10\n")
    write("labs", "subject_id,hadm_id,charttime,itemid,valuenum\n007,1,2020-01-01 09:00:00,50912,1.5\n")
    events = hospital.events(hospital.read_tables(spark, str(tmp_path))).persist()
    assert {r.subject_id for r in events.collect()} == {"007", "008"}
    assert events.filter("time is null").count() == 5 and events.filter("code = 'MEDS_DEATH'").count() == 1
    labels = hospital.labels(events, ["E11"], 60)
    assert sorted((r.subject_id, r.label) for r in labels.collect()) == [("007", True), ("008", False)]
    assert {r.subject_id: r.split for r in hospital.time_splits(labels).collect()} == {"007": "train", "008": "test"}
