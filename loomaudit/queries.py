"""Queries of the audit engine over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as nz
from .operators import checks as ck
from .plans import context as cx
from .plans import evidence as ev
from .sources import retail
from .sources import splits as sp
from .sources.features import build_feature_matrix, build_labels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Shared SQL.  The twins are written apart from the engine, from its definitions.

_EVENTS = """
ev AS (
  SELECT o_custkey::VARCHAR AS subject_id, o_orderdate::TIMESTAMP AS time, o_orderpriority AS code, 'PRIORITY' AS code_system,
    o_totalprice::DOUBLE AS numeric_value, NULL::VARCHAR AS text_value, o_orderkey::VARCHAR AS encounter_id FROM orders
  UNION ALL SELECT o_custkey::VARCHAR, o_orderdate::TIMESTAMP, 'STATUS_' || o_orderstatus, 'STATUS', NULL, NULL, o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT o_custkey::VARCHAR, l_shipdate::TIMESTAMP, 'SHIP_' || l_returnflag || l_linestatus, 'SHIP', l_extendedprice, NULL, l_orderkey::VARCHAR
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT c_custkey::VARCHAR, NULL, 'SEG_' || c_mktsegment, 'DEMO', NULL, NULL, NULL FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, NULL, 'NAT_' || c_nationkey, 'DEMO', NULL, NULL, NULL FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, NULL, 'BAL_' || floor(c_acctbal / 100)::BIGINT, 'DEMO', NULL, NULL, NULL FROM customer
)"""
_IDX = "idx AS (SELECT subject_id, min(time) AS index_date FROM ev WHERE code = 'STATUS_F' AND code_system = 'STATUS' AND time IS NOT NULL GROUP BY subject_id)"
_EWI = "ewi AS (SELECT ev.*, index_date FROM ev JOIN idx USING (subject_id) WHERE time IS NOT NULL)"
_OUT = "outc AS (SELECT DISTINCT * FROM ewi WHERE code = '1-URGENT' AND code_system = 'PRIORITY')"
_DAYS = "date_sub('second', index_date, time) / 86400.0::DOUBLE"
_BASE = f"WITH {_EVENTS}, {_IDX}, {_EWI}, {_OUT}"
_SPLIT = """sp AS (SELECT c_custkey::VARCHAR AS subject_id, CASE WHEN c_custkey % 10 < 6 THEN 'train' WHEN c_custkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM customer)"""
_SPLIT2 = """sp AS (SELECT c_custkey::VARCHAR AS subject_id, CASE WHEN c_custkey % 10 < 6 THEN 'train' WHEN c_custkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, 'valid' FROM customer WHERE c_custkey % 10 = 0)"""
_CANON = "subject_id, time, code, code_system, numeric_value, text_value, encounter_id"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


class _Retail:
    """The retail cohort's shared relations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.task = spark, sf_dir, retail.retail_task()
        self.events = retail.retail_events(spark, sf_dir)
        self.index = cx.index_from_events(self.events, self.task)

    def outcomes(self, indexed: bool = True) -> DataFrame:
        frame = cx.with_index(self.events, self.index) if indexed else nz.timed(self.events)
        return cx.match_code_sets(frame, self.task.outcome.codes)

    def proxies(self) -> DataFrame:
        return cx.match_code_sets(cx.with_index(self.events, self.index), self.task.outcome.proxy_codes)

    def labels(self) -> DataFrame:
        positive = F.col("subject_id").cast("bigint") % 3 == 0
        return self.index.select("subject_id", positive.alias("label"))

    def splits(self, overlap: bool = False) -> DataFrame:
        return retail.retail_splits(self.spark, self.dir, overlap)

    def followed(self) -> DataFrame:
        competing = F.col("code").isin("SHIP_RF")
        return ck.follow_up(self.events, self.index, cx.matches(self.task.outcome.codes), competing)


# normalisation


@query("canonical_events", f"WITH {_EVENTS} SELECT {_CANON} FROM ev")
def _(spark, d):
    return nz.coerce_events(retail.retail_events(spark, d))


@query(
    "coerce_lossy_cast",
    f"WITH {_EVENTS}, x AS (SELECT code, code_system, TRY_CAST(code AS DOUBLE) AS numeric_value FROM ev) SELECT code_system, count(*)::BIGINT AS n, count(numeric_value)::BIGINT AS n_number FROM x GROUP BY 1",
)
def _(spark, d):
    raw = retail.retail_events(spark, d).withColumn("numeric_value", F.col("code"))
    return nz.coerce_events(raw).groupBy("code_system").agg(F.count("*").alias("n"), F.count("numeric_value").alias("n_number"))


@query(
    "split_namespaced_code",
    f"WITH {_EVENTS}, j AS (SELECT code_system || '//' || code || '//x' AS raw FROM ev UNION ALL SELECT code FROM ev) SELECT CASE WHEN instr(raw, '//') > 0 THEN left(raw, instr(raw, '//') - 1) END AS code_system, CASE WHEN instr(raw, '//') > 0 THEN substr(raw, instr(raw, '//') + 2) ELSE raw END AS code, count(*)::BIGINT AS n FROM j GROUP BY 1, 2",
)
def _(spark, d):
    ev_ = retail.retail_events(spark, d)
    raw = ev_.select(F.concat("code_system", F.lit("//"), "code", F.lit("//x")).alias("code")).unionByName(ev_.select("code"))
    return nz.split_code(raw).groupBy("code_system", "code").agg(F.count("*").alias("n"))


@query("static_events", f"WITH {_EVENTS} SELECT {_CANON} FROM ev WHERE time IS NULL")
def _(spark, d):
    return nz.static(retail.retail_events(spark, d))


@query("timed_events", f"WITH {_EVENTS} SELECT {_CANON} FROM ev WHERE time IS NOT NULL")
def _(spark, d):
    return nz.timed(retail.retail_events(spark, d))


@query(
    "validate_null_counts",
    f"WITH {_EVENTS} SELECT count(*)::BIGINT AS n_events, count(DISTINCT subject_id)::BIGINT AS n_subjects, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_{c}" for c in ("subject_id", "code", "time", "code_system", "encounter_id"))
    + " FROM ev",
)
def _(spark, d):
    return retail.retail_events(spark, d).agg(*nz.profile_columns())


@query("distinct_subjects", f"WITH {_EVENTS} SELECT DISTINCT subject_id FROM ev WHERE subject_id IS NOT NULL")
def _(spark, d):
    return nz.subjects(retail.retail_events(spark, d))


@query("events_hash")
def _(spark, d):
    return spark.createDataFrame([(nz.events_hash(retail.retail_events(spark, d)),)], "data_hash string")


# context relations


@query("index_first", f"{_BASE} SELECT subject_id, index_date FROM idx")
def _(spark, d):
    return _Retail(spark, d).index


@query("index_last", f"WITH {_EVENTS} SELECT subject_id, max(time) AS index_date FROM ev WHERE code = 'STATUS_F' AND code_system = 'STATUS' GROUP BY 1")
def _(spark, d):
    from .plans.task import IndexDef, TaskSpec, FollowUp

    task = TaskSpec("last", IndexDef("STATUS_F", "STATUS", "last"), followup=FollowUp(False))
    return cx.index_from_events(retail.retail_events(spark, d), task)


@query("index_from_labels", "SELECT o_custkey::VARCHAR AS subject_id, min(o_orderdate) AS index_date FROM orders GROUP BY 1")
def _(spark, d):
    raw = retail.table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("prediction_time"), (F.col("o_orderstatus") == "F").alias("boolean_value"))
    return cx.index_from_labels(build_labels(raw))


@query("events_with_index", f"{_BASE} SELECT {_CANON}, index_date FROM ewi")
def _(spark, d):
    r = _Retail(spark, d)
    return cx.with_index(r.events, r.index)


@query("match_code_system", f"WITH {_EVENTS} SELECT {_CANON} FROM ev WHERE code IN ('1-URGENT', 'STATUS_F') AND code_system = 'PRIORITY'")
def _(spark, d):
    from .plans.task import CodeSet

    return retail.retail_events(spark, d).filter(cx.matches((CodeSet(("1-URGENT", "STATUS_F"), "PRIORITY"),)))


@query("match_code_bare", f"WITH {_EVENTS} SELECT {_CANON} FROM ev WHERE code IN ('1-URGENT', 'STATUS_F')")
def _(spark, d):
    from .plans.task import CodeSet

    return retail.retail_events(spark, d).filter(cx.matches((CodeSet(("1-URGENT", "STATUS_F")),)))


@query("match_code_sets_dedup", f"WITH {_EVENTS} SELECT DISTINCT {_CANON} FROM ev WHERE code = 'SHIP_RF' OR (code = '5-LOW' AND code_system = 'PRIORITY')")
def _(spark, d):
    from .plans.task import CodeSet

    return cx.match_code_sets(retail.retail_events(spark, d), (CodeSet(("SHIP_RF",)), CodeSet(("5-LOW",), "PRIORITY")))


_SP_QUERY = "SELECT a.split AS a, b.split AS b, count(DISTINCT a.subject_id)::BIGINT AS n_shared FROM sp a JOIN sp b ON a.subject_id = b.subject_id AND a.split < b.split GROUP BY 1, 2"


@query("split_sizes", f"WITH {_SPLIT2} SELECT split, count(DISTINCT subject_id)::BIGINT AS n_subjects FROM sp GROUP BY 1")
def _(spark, d):
    return sp.sizes(retail.retail_splits(spark, d, True))


@query("split_overlaps", f"WITH {_SPLIT2} {_SP_QUERY}")
def _(spark, d):
    return sp.overlaps(retail.retail_splits(spark, d, True))


@query(
    "split_alias_canonical",
    "SELECT CASE WHEN t IN ('train', 'training') THEN 'train' WHEN t IN ('tuning', 'valid', 'validation', 'dev') THEN 'valid' WHEN t IN ('held_out', 'heldout', 'test', 'testing', 'eval') THEN 'test' ELSE raw END AS split, count(*)::BIGINT AS n FROM (SELECT raw, lower(trim(raw)) AS t FROM (SELECT [' Train', 'TUNING', 'dev ', 'Held_Out', 'eval', 'Other'][1 + c_custkey % 6] AS raw FROM customer)) GROUP BY 1",
)
def _(spark, d):
    names = F.array(*(F.lit(x) for x in (" Train", "TUNING", "dev ", "Held_Out", "eval", "Other")))
    raw = retail.table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), names[F.col("c_custkey") % 6].alias("split"))
    return sp.normalise(raw).groupBy("split").agg(F.count("*").alias("n"))


@query("split_unknown_subjects", f"WITH {_SPLIT} SELECT DISTINCT subject_id FROM sp ANTI JOIN (SELECT DISTINCT o_custkey::VARCHAR AS subject_id FROM orders) USING (subject_id)")
def _(spark, d):
    have = retail.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject_id"))
    return retail.retail_splits(spark, d).select("subject_id").distinct().join(have, "subject_id", "left_anti")


@query("split_unassigned", f"WITH {_EVENTS}, {_SPLIT} SELECT DISTINCT subject_id FROM ev ANTI JOIN (SELECT subject_id FROM sp WHERE split <> 'test') USING (subject_id) WHERE subject_id IS NOT NULL")
def _(spark, d):
    have = retail.retail_events(spark, d).select("subject_id").filter("subject_id is not null").distinct()
    return have.join(retail.retail_splits(spark, d).filter("split <> 'test'"), "subject_id", "left_anti")


# checks


@query("lk001_events", f"{_BASE} SELECT {_CANON}, index_date FROM ewi WHERE time > index_date")
def _(spark, d):
    r = _Retail(spark, d)
    return ck.post_index_events(r.events, r.index)


@query("lk001_matrix", f"{_BASE} SELECT o_custkey::VARCHAR AS subject_id, o_orderdate::TIMESTAMP AS feature_time, o_totalprice, index_date FROM orders JOIN idx ON o_custkey::VARCHAR = subject_id WHERE o_orderdate > index_date")
def _(spark, d):
    r = _Retail(spark, d)
    raw = retail.table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("index_date"), "o_totalprice")
    return ck.post_index_rows(build_feature_matrix(raw).frame, r.index)


@query(
    "lk002",
    f"{_BASE}, enc AS (SELECT DISTINCT subject_id, encounter_id AS index_encounter FROM ewi WHERE time = index_date AND encounter_id IS NOT NULL) SELECT outc.*, index_encounter FROM outc JOIN enc ON outc.subject_id = enc.subject_id AND encounter_id = index_encounter",
)
def _(spark, d):
    r = _Retail(spark, d)
    return ck.same_encounter(r.outcomes(), ck.index_encounters(r.events, r.index))


@query("lk003", f"{_BASE} SELECT DISTINCT * FROM ewi WHERE code = '5-LOW' AND code_system = 'PRIORITY' AND time <= index_date")
def _(spark, d):
    return ck.early_proxies(_Retail(spark, d).proxies())


def _lk004_sql(censor: bool) -> str:
    exempt = " OR code = 'SHIP_RF'" if censor else ""
    return f"""{_BASE}, last AS (SELECT subject_id, max(time) AS last_event_time FROM ev WHERE time IS NOT NULL GROUP BY 1),
      ex AS (SELECT DISTINCT subject_id FROM ev WHERE time IS NOT NULL AND ((code = '1-URGENT' AND code_system = 'PRIORITY'){exempt})),
      f AS (SELECT idx.*, last_event_time, date_sub('second', index_date, last_event_time) / 86400.0::DOUBLE AS observed_days FROM idx LEFT JOIN last USING (subject_id))
      SELECT *, 1826.25::DOUBLE AS required_days FROM f ANTI JOIN ex USING (subject_id) WHERE observed_days IS NULL OR observed_days < 1826.25"""


@query("lk004", _lk004_sql(True))
def _(spark, d):
    return ck.short_follow_up(_Retail(spark, d).followed(), 5 * 365.25, True)


@query("lk004_no_censoring", _lk004_sql(False))
def _(spark, d):
    return ck.short_follow_up(_Retail(spark, d).followed(), 5 * 365.25, False)


@query("lk005", f"WITH {_SPLIT2} SELECT subject_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split)::BIGINT AS n_splits FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(spark, d):
    return ck.split_overlap(retail.retail_splits(spark, d, True))


@query(
    "lk006",
    f"{_BASE}, {_SPLIT}, m AS (SELECT max(index_date) AS train_max_index_date FROM sp JOIN idx USING (subject_id) WHERE split = 'train') SELECT subject_id, index_date, train_max_index_date FROM sp JOIN idx USING (subject_id), m WHERE split = 'test' AND index_date < train_max_index_date",
)
def _(spark, d):
    r = _Retail(spark, d)
    return ck.early_test_subjects(r.splits(), r.index)


@query(
    "lk007",
    f"{_BASE}, inw AS (SELECT DISTINCT subject_id FROM outc WHERE time > index_date AND {_DAYS} <= 365.25) SELECT subject_id, true AS label, false AS outcome_in_window FROM idx ANTI JOIN inw USING (subject_id) WHERE subject_id::BIGINT % 3 = 0",
)
def _(spark, d):
    r = _Retail(spark, d)
    return ck.unsupported_positives(r.labels(), ck.in_window_subjects(r.outcomes(), r.task.horizon.days))


def _lk008_sql(members: str) -> str:
    return f"""WITH {_SPLIT}, mem AS ({members}), j AS (SELECT DISTINCT mem.subject_id, group_id, split FROM mem JOIN sp USING (subject_id)),
      w AS (SELECT group_id, count(DISTINCT split)::BIGINT AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM j GROUP BY 1 HAVING count(DISTINCT split) > 1)
      SELECT subject_id, group_id, split, n_splits, splits FROM j JOIN w USING (group_id)"""


@query("lk008", _lk008_sql("SELECT DISTINCT o_custkey::VARCHAR AS subject_id, l_suppkey::VARCHAR AS group_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"))
def _(spark, d):
    lines, orders = retail.table(spark, d, "lineitem"), retail.table(spark, d, "orders")
    raw = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    raw = raw.select(F.col("o_custkey").alias("subject_id"), F.col("l_shipdate").alias("time"), F.lit("SHIP").alias("code"), F.col("l_suppkey").alias("supplier"))
    return ck.straddling_members(nz.coerce_events(raw, "supplier"), retail.retail_splits(spark, d), "supplier")


_SIG = "sig AS (SELECT subject_id, string_agg(DISTINCT code, '|' ORDER BY code) AS signature, count(DISTINCT code)::BIGINT AS n_facts FROM ev WHERE time IS NULL GROUP BY 1 HAVING count(DISTINCT code) > 1)"


@query(
    "lk009",
    f"WITH {_EVENTS}, {_SIG}, g AS (SELECT signature, count(*)::BIGINT AS n_subject_ids, array_to_string(list_slice(list(subject_id ORDER BY subject_id), 1, 50), ',') AS subject_ids FROM sig GROUP BY 1 HAVING count(*) > 1) SELECT subject_id, signature, n_facts, n_subject_ids, subject_ids FROM sig JOIN g USING (signature)",
)
def _(spark, d):
    return ck.duplicate_subjects(ck.signatures(retail.retail_events(spark, d)))


_LK010 = f"o AS (SELECT *, {_DAYS} AS days_after_index FROM outc), late AS (SELECT * FROM o ANTI JOIN (SELECT DISTINCT subject_id FROM o WHERE days_after_index > 0 AND days_after_index <= 365.25) USING (subject_id) WHERE days_after_index > 365.25)"


@query("lk010", f"{_BASE}, {_LK010} SELECT * FROM late")
def _(spark, d):
    r = _Retail(spark, d)
    return ck.beyond_horizon(r.outcomes(), r.task.horizon.days)


@query(
    "subject_profile",
    f"""{_BASE} SELECT subject_id, index_date, max(time) AS last_event_time, count(*) FILTER (WHERE time > index_date)::BIGINT AS n_post_index,
  bool_or(code = '1-URGENT' AND code_system = 'PRIORITY') AS has_outcome,
  bool_or(code = '1-URGENT' AND code_system = 'PRIORITY' AND {_DAYS} > 0 AND {_DAYS} <= 365.25) AS outcome_in_window,
  bool_or(code = '1-URGENT' AND code_system = 'PRIORITY' AND {_DAYS} > 365.25) AS outcome_beyond,
  bool_or(code = '5-LOW' AND code_system = 'PRIORITY' AND time <= index_date) AS early_proxy, bool_or(code = 'SHIP_RF') AS has_competing FROM ewi GROUP BY 1, 2""",
)
def _(spark, d):
    r = _Retail(spark, d)
    t = r.task.outcome
    return ck.subject_profile(r.events, r.index, cx.matches(t.codes), cx.matches(t.proxy_codes), F.col("code") == "SHIP_RF", r.task.horizon.days)


@query(
    "clickstream_horizon",
    f"""WITH ev AS (SELECT user_id::VARCHAR AS subject_id, ts::TIMESTAMP AS time, event_type AS code, value::DOUBLE AS numeric_value, props AS text_value, user_id || '-' || strftime(ts, '%Y-%m-%d') AS encounter_id FROM events),
  idx AS (SELECT subject_id, min(time) AS index_date FROM ev WHERE code = 'click' GROUP BY 1), outc AS (SELECT DISTINCT ev.*, index_date FROM ev JOIN idx USING (subject_id) WHERE code = 'purchase'),
  o AS (SELECT *, {_DAYS} AS days_after_index FROM outc)
  SELECT subject_id, time, code, numeric_value, text_value, encounter_id, index_date, days_after_index FROM o ANTI JOIN (SELECT DISTINCT subject_id FROM o WHERE days_after_index > 0 AND days_after_index <= 1) USING (subject_id) WHERE days_after_index > 1""",
)
def _(spark, d):
    from .plans.task import TaskSpec

    task = TaskSpec.from_dict({"task": "clicks", "index": {"event": "click"}, "outcome": {"codes": ["purchase"]}, "horizon": "1d"})
    events = retail.clickstream_events(spark, d)
    outcomes = cx.match_code_sets(cx.with_index(events, cx.index_from_events(events, task)), task.outcome.codes)
    return ck.beyond_horizon(outcomes, task.horizon.days).drop("code_system")


# evidence


def _all_checks(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    r = _Retail(spark, d)
    members = ("lk005", "lk008", "lk009")
    out = {
        "LK001": ck.post_index_events(r.events, r.index),
        "LK002": ck.same_encounter(r.outcomes(), ck.index_encounters(r.events, r.index)),
        "LK003": ck.early_proxies(r.proxies()),
        "LK004": ck.short_follow_up(r.followed(), 5 * 365.25, True),
        "LK006": ck.early_test_subjects(r.splits(), r.index),
        "LK007": ck.unsupported_positives(r.labels(), ck.in_window_subjects(r.outcomes(), r.task.horizon.days)),
        "LK010": ck.beyond_horizon(r.outcomes(), r.task.horizon.days),
    }
    return out | {m.upper(): QUERIES[m](spark, d) for m in members}


_NAMES = {"LK001": "lk001_events", "LK002": "lk002", "LK003": "lk003", "LK004": "lk004", "LK005": "lk005", "LK006": "lk006", "LK007": "lk007", "LK008": "lk008", "LK009": "lk009", "LK010": "lk010"}
_TOTALS = "(SELECT count(*) FROM customer)"


def _summary_sql() -> str:
    totals = {"LK006": "(SELECT count(*) FROM customer WHERE c_custkey % 10 >= 8)", "LK007": "(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F')"}
    parts = [
        f"SELECT '{k}' AS check_id, count(*)::BIGINT AS n_rows, count(DISTINCT subject_id)::BIGINT AS n_subjects, count(DISTINCT subject_id) / {totals.get(k, _TOTALS)}::DOUBLE AS subject_rate FROM ({ORACLES[v]})"
        for k, v in _NAMES.items()
    ]
    return " UNION ALL ".join(parts)


@query("finding_summary")
def _(spark, d):
    r = _Retail(spark, d)
    n = nz.subjects(r.events).count()
    totals = {"LK006": r.splits().filter("split = 'test'").count(), "LK007": r.labels().count()}
    out = None
    for k, rows in sorted(_all_checks(spark, d).items()):
        one = ev.counts(rows).select(F.lit(k).alias("check_id"), "n_rows", "n_subjects", (F.col("n_subjects") / float(totals.get(k, n))).alias("subject_rate"))
        out = one if out is None else out.unionByName(one)
    return out


ORACLES["finding_summary"] = _summary_sql()


@query(
    "top10_evidence",
    f"{_BASE}, {_LK010} SELECT * FROM late ORDER BY subject_id NULLS LAST, time NULLS LAST, code NULLS LAST, code_system NULLS LAST, days_after_index NULLS LAST, encounter_id NULLS LAST, index_date NULLS LAST, numeric_value NULLS LAST, text_value NULLS LAST LIMIT 10",
)
def _(spark, d):
    return ev.top_rows(QUERIES["lk010"](spark, d))


@query("subject_list_50", f"{_BASE}, {_LK010} SELECT DISTINCT subject_id FROM late ORDER BY 1 LIMIT 50")
def _(spark, d):
    return ev.subject_list(QUERIES["lk010"](spark, d))


@query("evidence_antijoin", f"{_BASE}, {_LK010}, l AS (SELECT DISTINCT subject_id FROM late ORDER BY 1 LIMIT 50) SELECT subject_id FROM l ANTI JOIN (SELECT DISTINCT subject_id FROM ev WHERE code = '2-HIGH') USING (subject_id)")
def _(spark, d):
    listed = ev.subject_list(QUERIES["lk010"](spark, d))
    return ev.unknown_subjects(listed, retail.retail_events(spark, d).filter("code = '2-HIGH'"))


# sources and sinks


@query(
    "omop_condition_unmapped",
    "SELECT o_custkey::VARCHAR AS subject_id, o_orderdate::TIMESTAMP AS time, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE (o_orderkey % 100)::VARCHAR END AS code, CASE WHEN o_orderkey % 5 = 0 THEN 'OMOP_CONDITION_SOURCE' ELSE 'OMOP_CONDITION' END AS code_system, NULL::DOUBLE AS numeric_value, NULL::VARCHAR AS text_value, o_orderkey::VARCHAR AS encounter_id FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 100 <> 0",
)
def _(spark, d):
    from .sources import omop

    o = retail.table(spark, d, "orders")
    concept = F.when(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 2 == 0, 0)).otherwise(F.col("o_orderkey") % 100)
    raw = o.select(
        F.col("o_custkey").alias("person_id"), concept.alias("condition_concept_id"), F.col("o_orderpriority").alias("condition_source_value"),
        F.col("o_orderdate").alias("condition_start_datetime"), F.col("o_orderkey").alias("visit_occurrence_id"),
    )
    return omop.convert_table(raw, omop.SPECS["condition_occurrence"])


@query(
    "omop_person_static",
    "SELECT c_custkey::VARCHAR AS subject_id, NULL::TIMESTAMP AS time, c_nationkey::VARCHAR AS code, 'OMOP_GENDER' AS code_system, NULL::DOUBLE AS numeric_value, NULL::VARCHAR AS text_value, NULL::VARCHAR AS encounter_id FROM customer WHERE c_nationkey <> 0 UNION ALL SELECT c_custkey::VARCHAR, NULL, (1950 + c_custkey % 50)::VARCHAR, 'OMOP_BIRTH_YEAR', NULL, NULL, NULL FROM customer",
)
def _(spark, d):
    from .sources import omop

    raw = retail.table(spark, d, "customer").select(
        F.col("c_custkey").alias("person_id"), F.nullif(F.col("c_nationkey"), F.lit(0)).alias("gender_concept_id"), (1950 + F.col("c_custkey") % 50).alias("year_of_birth")
    )
    return omop.convert_person(raw)


@query("meds_roundtrip", f"WITH {_EVENTS} SELECT subject_id, time, code, code_system, numeric_value::FLOAT::DOUBLE AS numeric_value, text_value, encounter_id FROM ev")
def _(spark, d):
    import uuid

    from .sources import meds
    from .sources.files import shared_folder

    base = shared_folder(spark)
    folder = f"{base.rstrip('/')}/meds-{uuid.uuid4().hex}"
    meds.write_meds_dataset(retail.retail_events(spark, d), folder, "retail")
    return meds.read_meds_events(spark, folder)


@query("surrogate_ids", f"WITH {_EVENTS}, s AS (SELECT DISTINCT 'S' || subject_id AS original_subject_id FROM ev) SELECT row_number() OVER (ORDER BY original_subject_id) AS subject_id, original_subject_id FROM s")
def _(spark, d):
    from .sources import meds

    ids = retail.retail_events(spark, d).select(F.concat(F.lit("S"), "subject_id").alias("subject_id"))
    return meds.subject_id_surrogates(ids)


@query("feature_duplicates", "SELECT subject_id, n_rows FROM (SELECT o_custkey::VARCHAR AS subject_id, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1) WHERE n_rows > 1")
def _(spark, d):
    raw = retail.table(spark, d, "orders").select(F.col("o_custkey").alias("PATIENT_ID"), "o_totalprice")
    return build_feature_matrix(raw).frame.groupBy("subject_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


@query("labels_time_aliases", "SELECT o_custkey::VARCHAR AS subject_id, o_orderdate::TIMESTAMP AS index_date, (o_orderstatus = 'F') AS label FROM orders")
def _(spark, d):
    raw = retail.table(spark, d, "orders").select(F.col("o_custkey").alias("Person_ID"), F.col("o_orderdate").alias("index_time"), (F.col("o_orderstatus") == "F").alias("target"))
    return build_labels(raw)


@query("labels_boolean_first", "SELECT o_custkey::VARCHAR AS subject_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus = 'F' ELSE o_totalprice > 150000 END AS label FROM orders")
def _(spark, d):
    raw = retail.table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("time"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 150000).alias("boolean_value")
    )
    return build_labels(raw).select("subject_id", "label")


@query(
    "feature_column_roles",
    "SELECT 'o_totalprice' AS feature, count(o_totalprice)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS n_subjects FROM orders UNION ALL SELECT 'weekday', count(o_orderdate), count(DISTINCT o_custkey) FROM orders",
)
def _(spark, d):
    """Of ids, times, labels, splits and visits none is a feature."""
    c = F.col
    named = {"id": c("o_custkey"), "as_of_time": c("o_orderdate"), "y": c("o_orderstatus") == "F", "outcome": c("o_orderstatus"), "Fold": c("o_orderkey") % 5, "split": c("o_orderpriority"), "hadm_id": c("o_orderkey")}
    matrix = build_feature_matrix(retail.table(spark, d, "orders").select(*(v.alias(k) for k, v in named.items()), "o_totalprice", F.dayofweek("o_orderdate").alias("weekday")))
    long = matrix.frame.select("subject_id", *(c(f).cast("string").alias(f) for f in matrix.features)).unpivot(["subject_id"], list(matrix.features), "feature", "value")
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.count_distinct("subject_id").alias("n_subjects"))


@query("split_of", f"WITH {_SPLIT2} SELECT subject_id, array_to_string(list(split ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END), ',') AS splits FROM (SELECT DISTINCT subject_id, split FROM sp) GROUP BY 1")
def _(spark, d):
    return sp.split_of(retail.retail_splits(spark, d, True)).select("subject_id", F.array_join("splits", ",").alias("splits"))


@query("evidence_unknown", "SELECT 'C' || c_custkey AS subject_id FROM customer WHERE c_custkey <= 20 UNION ALL SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey <= 20 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    few = retail.table(spark, d, "customer").filter("c_custkey <= 20").select(F.col("c_custkey").cast("string").alias("subject_id"))
    listed = few.unionByName(few.select(F.concat(F.lit("C"), "subject_id").alias("subject_id")))
    return ev.unknown_subjects(listed, retail.retail_events(spark, d))


@query("synth_clean_audit")
def _(spark, d):
    from .audit import run_audit
    from .synth.generate import generate

    return run_audit(generate(spark, 200, 3).context()).findings_frame(spark)


@query("inject_duality")
def _(spark, d):
    from .audit import run_audit
    from .synth.generate import generate
    from .synth.inject import inject_many

    data, _ = inject_many(generate(spark, 200, 3), n=3)
    return run_audit(data.context()).findings_frame(spark)
