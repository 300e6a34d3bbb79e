import json

import pytest

from loomaudit.errors import InputError, SchemaError, SplitsError, TaskSpecError
from loomaudit.functions import normalize as nz
from loomaudit.plans.evidence import make_finding, Severity
from loomaudit.plans.task import Duration, TaskSpec
from loomaudit.sources import features as fx
from loomaudit.sources import meds, omop
from loomaudit.sources import splits as sp
from loomaudit.synth.generate import generate


def test_durations_and_task(tmp_path):
    assert [Duration.parse(x).days for x in ("30d", "2w", "6M", " 2 y ", "1.5y")] == [30, 14, 182.625, 730.5, 547.875]
    for bad in ("2 years", "", "y2", "-1d", "0d", "two y", "2q"):
        with pytest.raises(TaskSpecError):
            Duration.parse(bad)
    spec = {"task": "t", "index": {"event": "x"}, "outcome": {"codes": ["A", " ", "B"], "proxy_codes": {"values": ["P"], "system": "RX"}}, "horizon": "2y"}
    task = TaskSpec.from_dict(spec)
    assert task.outcome.codes[0].values == ("A", "B") and task.outcome.proxy_codes[0].system == "RX"
    task.to_yaml(tmp_path / "t.yaml")
    assert TaskSpec.from_yaml(tmp_path / "t.yaml") == task
    for bad in ({"task": "t"}, spec | {"colour": 1}, spec | {"outcome": {"codes": ["A"], "window": ["0d"]}}, spec | {"splits": {"strategy": "time"}}):
        with pytest.raises(TaskSpecError):
            TaskSpec.from_dict(bad)


def test_codes_coercion_and_hash(spark):
    codes = ["ICD10CM//E11.9", "MEDS_DEATH", "A//B//C", "//x", None]
    df = spark.createDataFrame([(float(i), None, c) for i, c in enumerate(codes)], "subject_id double, time string, code string")
    got = [(r.code_system, r.code) for r in nz.split_code(df).orderBy("subject_id").collect()]
    assert got == [("ICD10CM", "E11.9"), (None, "MEDS_DEATH"), ("A", "B//C"), ("", "x"), (None, None)]
    events = nz.coerce_events(df.withColumn("extra", df.code))
    assert events.columns == nz.EVENT_SCHEMA.names and [r.subject_id for r in events.orderBy("subject_id").collect()] == ["0", "1", "2", "3", "4"]
    assert nz.events_hash(events) == nz.events_hash(events.repartition(3)) != nz.events_hash(events.limit(4))
    with pytest.raises(SchemaError, match="code"):
        nz.coerce_events(df.drop("code"))


def test_evidence_is_bounded(spark):
    df = spark.createDataFrame([(f"S{i:03d}" if i % 9 else None, i, [i]) for i in range(200)], "subject_id string, v int, nested array<int>")
    found = make_finding("X", "x", Severity.ERROR, "{n_rows} of {n_subjects}", df.repartition(5), 200)
    assert (found.n_rows, found.n_subjects, len(found.examples), len(found.subjects)) == (200, 177, 10, 50)
    assert found.examples[0]["subject_id"] == "S001" and found.message == "200 of 177" and found.subject_rate == 177 / 200


def test_meds_round_trip(spark, tmp_path):
    data = generate(spark, 30, 5)
    folder = str(tmp_path / "meds")
    meds.write_meds_dataset(data.events, folder, "t", data.splits)
    back = meds.read_meds_events(spark, folder)
    want = {(r.subject_id, r.time, r.code, r.code_system, r.encounter_id) for r in data.events.collect()}
    assert {(r.subject_id, r.time, r.code, r.code_system, r.encounter_id) for r in back.collect()} == want
    assert meds.read_dataset_metadata(folder)["dataset_name"] == "t"
    splits = sp.read_splits(spark, meds.find_splits(folder), meds.read_subject_id_map(spark, folder))
    assert {tuple(r) for r in splits.collect()} == {tuple(r) for r in data.splits.collect()}
    part = meds.read_subject_id_map(spark, folder).limit(3)
    with pytest.raises(InputError):
        meds.restore_ids(spark.read.parquet(f"{folder}/data").withColumn("subject_id", nz.F.col("subject_id").cast("string")), part, "events")


def test_meds_shards_of_different_types(spark, tmp_path):
    one = spark.createDataFrame([(1, "A//B//C", 7)], "subject_id int, code string, hadm_id bigint").selectExpr("*", "timestamp_ntz'2020-01-01' as time")
    two = spark.createDataFrame([("x2", "//d", 1.5)], "subject_id string, code string, numeric_value float").selectExpr("*", "cast(null as timestamp_ntz) as time")
    one.coalesce(1).write.parquet(str(tmp_path / "data" / "a"))
    two.coalesce(1).write.parquet(str(tmp_path / "data" / "b"))
    got = sorted((r.subject_id, r.code_system, r.code, r.encounter_id) for r in meds.read_meds_events(spark, str(tmp_path)).collect())
    assert got == [("1", "A", "B//C", "7"), ("x2", "", "d", None)]
    two.drop("code").coalesce(1).write.parquet(str(tmp_path / "data" / "c"))
    with pytest.raises(SchemaError):
        meds.read_meds_events(spark, str(tmp_path))
    with pytest.raises(InputError):
        meds.read_meds_events(spark, str(tmp_path / "none"))


def test_omop(spark, tmp_path):
    (tmp_path / "person.csv").write_text("person_id,gender_concept_id,race_concept_id,year_of_birth,birth_datetime\n1,8507,0,1970,1970-05-01 00:00:00\n2,8532,8516,1985,\n")
    (tmp_path / "CONDITION_OCCURRENCE.csv").write_text(
        "person_id,visit_occurrence_id,condition_concept_id,condition_start_datetime,condition_start_date,condition_source_value\n1,100,201826,2020-01-01 08:00:00,2020-01-01,E11.9\n2,200,0,,2020-02-01,E10.10\n"
    )
    got = {(r.subject_id, str(r.time), r.code, r.code_system, r.encounter_id) for r in omop.read_omop_events(spark, str(tmp_path)).collect()}
    assert ("1", "2020-01-01 08:00:00", "201826", "OMOP_CONDITION", "100") in got
    assert ("2", "2020-02-01 00:00:00", "E10.10", "OMOP_CONDITION_SOURCE", "200") in got
    assert ("1", "1970-05-01 00:00:00", "MEDS_BIRTH", None, None) in got and ("2", "None", "8516", "OMOP_RACE", None) in got
    assert len(got) == 2 + 1 + 2 + 3 and omop.tables_present(str(tmp_path)) == ["condition_occurrence", "person"]
    with pytest.raises(InputError):
        omop.read_omop_events(spark, str(tmp_path / "x"))


def test_features_labels_splits(spark, tmp_path):
    raw = spark.createDataFrame([("a", 1, "true"), ("a", 2, "no")], "Patient_ID string, age int, label string")
    matrix = fx.build_feature_matrix(raw)
    assert matrix.features == ("age",) and matrix.time_column is None and len(matrix.warnings()) == 2
    assert [r.label for r in matrix.frame.orderBy("age").collect()] == [True, None]
    with pytest.raises(SchemaError):
        fx.build_feature_matrix(raw, "who")
    with pytest.raises(InputError):
        fx.read_table(spark, "x.xlsx")
    typed = spark.createDataFrame([(1, None, 0), (2, None, 3), (3, True, 0)], "subject_id bigint, boolean_value boolean, integer_value int").withColumn("time", nz.F.lit("2020-01-01"))
    assert [r.label for r in fx.build_labels(typed).orderBy("subject_id").collect()] == [False, True, True]
    splits = sp.splits_from_mapping(spark, {"Training": ["a", "b", None], "tuning": ["b"], "held_out": ["c"], "extra": ["b"]})
    assert {r.split for r in splits.collect()} == {"train", "valid", "test", "extra"}
    assert {(r.a, r.b): r.n_shared for r in sp.overlaps(splits).collect()} == {("extra", "train"): 1, ("extra", "valid"): 1, ("train", "valid"): 1}
    sp.write_json(splits, tmp_path / "s.json")
    assert list(json.loads((tmp_path / "s.json").read_text())) == ["train", "valid", "test", "extra"]
    assert sp.read_splits(spark, str(tmp_path / "s.json")).count() == splits.count()
    for bad in ({}, {"train": "a"}):
        with pytest.raises(SplitsError):
            sp.splits_from_mapping(spark, bad)
