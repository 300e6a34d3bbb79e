"""Leaks to plant in a clean cohort, one for each check, with the subjects they are in."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .generate import HISTORY, OUTCOMES, PROXIES, Cohort, after, below, draw

HORIZON_DAYS = 730.5


@dataclass(frozen=True)
class Injection:
    check_id: str
    subjects: tuple[str, ...]


def _choose(data: Cohort, n: int, exclude: Iterable[str], pool: DataFrame | None = None, by: Column | None = None) -> list[str]:
    """``n`` subjects in hash order, or by ``by``; n is small, so they come to the driver."""
    spark = data.events.sparkSession
    pool = data.labels if pool is None else pool
    gone = spark.createDataFrame([(s,) for s in exclude], "subject_id string")
    order = F.xxhash64(F.lit(data.seed), "subject_id") if by is None else by
    got = pool.join(F.broadcast(gone), "subject_id", "left_anti").orderBy(order, "subject_id").limit(n).select("subject_id").collect()
    if len(got) < n:
        raise ValueError(f"only {len(got)} of {n} subjects are left to plant a leak in")
    return sorted(r.subject_id for r in got)


def _rows(data: Cohort, chosen: list[str]) -> DataFrame:
    return data.labels.filter(F.col("subject_id").isin(chosen))


def _add(data: Cohort, rows: DataFrame, time: Column, code: Column, system: str, encounter: Column) -> Cohort:
    shaped = rows.select(
        "subject_id", time.alias("time"), code.alias("code"), F.lit(system).alias("code_system"), F.lit(None).cast("double").alias("numeric_value"), F.lit(None).cast("string").alias("text_value"), encounter.alias("encounter_id")
    )
    return data.replace(events=data.events.unionByName(shaped))


def _negatives(data: Cohort) -> DataFrame:
    return data.labels.filter("not label")


def _tag(suffix: str) -> Column:
    return F.concat("subject_id", F.lit(suffix))


def post_index(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    chosen = _choose(data, n, exclude)
    s = data.seed
    late = F.when(F.col("subject_id").isin(chosen), F.timestamp_add("DAY", F.lit(90), F.col("index_date"))).otherwise(F.col("index_date"))
    table = data.labels.select("subject_id", late.alias("prediction_time"), below(9, s, "n_prior", F.col("subject_id")).cast("bigint").alias("n_prior_visits"), F.round(5 + draw(s, "a1c", F.col("subject_id")) * 6, 1).alias("last_a1c"))
    return data.replace(features=table), chosen


def same_encounter(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    chosen = _choose(data, n, exclude)
    return _add(data, _rows(data, chosen), F.col("index_date"), F.lit(OUTCOMES[0]), "ICD10CM", _tag("-IDX")), chosen


def proxy(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    chosen = _choose(data, n, exclude)
    time = after(F.col("index_date"), -(1 + draw(data.seed, "proxy", F.col("subject_id")) * 29))
    return _add(data, _rows(data, chosen), time, F.lit(PROXIES[0]), "RX", _tag("-PRX")), chosen


def immortal(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    chosen = _choose(data, n, exclude, _negatives(data))
    cut = _rows(data, chosen).select("subject_id", F.timestamp_add("DAY", F.lit(30), F.col("index_date")).alias("cut"))
    kept = data.events.join(F.broadcast(cut), "subject_id", "left").filter("cut is null or time is null or time <= cut").drop("cut")
    return data.replace(events=kept.select(data.events.columns)), chosen


def overlap(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    chosen = _choose(data, n, exclude, data.splits.filter("split = 'test'"))
    again = data.splits.filter(F.col("subject_id").isin(chosen)).select("subject_id", F.lit("train").alias("split"))
    return data.replace(splits=data.splits.unionByName(again)), chosen


def temporal(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    train = data.splits.filter("split = 'train'").join(data.labels, "subject_id")
    chosen = _choose(data, n, exclude, train, F.col("index_date"))
    split = F.when(F.col("subject_id").isin(chosen), "test").otherwise(F.col("split"))
    return data.replace(splits=data.splits.withColumn("split", split)), chosen


def relabel(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    chosen = _choose(data, n, exclude, _negatives(data))
    return data.replace(labels=data.labels.withColumn("label", F.col("label") | F.col("subject_id").isin(chosen))), chosen


def shared_group(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    """Pairs of a training and a test subject in one encounter."""
    first = _choose(data, n, exclude, data.splits.filter("split = 'train'"))
    second = _choose(data, n, exclude, data.splits.filter("split = 'test'"))
    pairs = data.events.sparkSession.createDataFrame([(s, f"SHARED-ENC-{i}") for side in (first, second) for i, s in enumerate(side)], "subject_id string, enc string")
    rows = data.labels.join(F.broadcast(pairs), "subject_id")
    return _add(data, rows, F.timestamp_add("DAY", F.lit(-3), F.col("index_date")), F.lit(HISTORY[1]), "ICD10CM", F.col("enc")), sorted(first + second)


def twin(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    """Subjects cloned under a second id, with label and split."""
    chosen = _choose(data, n, exclude)
    new = F.concat("subject_id", F.lit("-DUP"))

    def copy(df: DataFrame) -> DataFrame:
        mine = df.filter(F.col("subject_id").isin(chosen))
        if "encounter_id" in df.columns:
            mine = mine.withColumn("encounter_id", F.concat("encounter_id", F.lit("-DUP")))
        return df.unionByName(mine.withColumn("subject_id", new))

    return data.replace(events=copy(data.events), labels=copy(data.labels), splits=copy(data.splits)), sorted(chosen + [f"{s}-DUP" for s in chosen])


def late_outcome(data: Cohort, n: int, exclude) -> tuple[Cohort, list[str]]:
    chosen = _choose(data, n, exclude, _negatives(data))
    time = after(F.col("index_date"), HORIZON_DAYS + 30 + draw(data.seed, "late", F.col("subject_id")) * 370)
    return _add(data, _rows(data, chosen), time, F.lit(OUTCOMES[1]), "ICD10CM", _tag("-LATE")), chosen


INJECTORS: dict[str, Callable] = {
    "LK001": post_index,
    "LK002": same_encounter,
    "LK003": proxy,
    "LK004": immortal,
    "LK005": overlap,
    "LK006": temporal,
    "LK007": relabel,
    "LK008": shared_group,
    "LK009": twin,
    "LK010": late_outcome,
}


def injector_ids() -> list[str]:
    return sorted(INJECTORS)


def inject(data: Cohort, check_id: str, n: int = 4, exclude: Iterable[str] = ()) -> tuple[Cohort, Injection]:
    key = check_id.strip().upper()
    if key not in INJECTORS:
        raise ValueError(f"no injector for {check_id!r}; known are {', '.join(injector_ids())}")
    changed, subjects = INJECTORS[key](data, n, exclude)
    return changed.replace(planted=(data.planted or {}) | {key: subjects}), Injection(key, tuple(subjects))


def inject_many(data: Cohort, ids: Iterable[str] | None = None, n: int = 4) -> tuple[Cohort, list[Injection]]:
    """Several leaks on disjoint subjects, in the order of their ids."""
    done: list[Injection] = []
    for key in sorted({i.strip().upper() for i in ids} if ids is not None else INJECTORS):
        data, one = inject(data, key, n, [s for d in done for s in d.subjects])
        done.append(one)
    return data, done
