"""The ten leakage checks.

The first part holds them as plain relations: DataFrames in, offending rows out.  The
second wraps each as a registered check, with the conditions under which it skips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import context as cx
from ..plans.evidence import Finding, Severity, Skipped, make_finding
from .registry import Check, register

#: Least share of distinct signatures among signed subjects for LK009 to mean anything.
SIGNATURE_FLOOR = 0.9


# relations


def post_index_rows(features: DataFrame, index: DataFrame) -> DataFrame:
    """Feature rows later than the index date (columns feature_time, index_date)."""
    return features.drop("index_date").join(index, "subject_id").filter(F.col("feature_time") > F.col("index_date"))


def post_index_events(events: DataFrame, index: DataFrame) -> DataFrame:
    return cx.with_index(events, index).filter(F.col("time") > F.col("index_date"))


def index_encounters(events: DataFrame, index: DataFrame) -> DataFrame:
    """Encounters of events exactly at the index date."""
    at = cx.with_index(events, index).filter("time = index_date and encounter_id is not null")
    return at.select("subject_id", F.col("encounter_id").alias("index_encounter")).distinct()


def same_encounter(outcomes: DataFrame, encounters: DataFrame) -> DataFrame:
    """Outcome events, whenever they are, in an encounter of the index event."""
    mine = encounters.withColumnRenamed("subject_id", "__who")
    on = (F.col("subject_id") == F.col("__who")) & (F.col("encounter_id") == F.col("index_encounter"))
    return outcomes.join(mine, on).drop("__who")


def early_proxies(proxies: DataFrame) -> DataFrame:
    return proxies.filter("time <= index_date")


def follow_up(events: DataFrame, index: DataFrame, outcomes, competing) -> DataFrame:
    """For each indexed subject: last event, observed days, and whether it has an outcome or competing event.

    One aggregate over the timed events; ``outcomes`` and ``competing`` are predicates.
    """
    seen = (
        events.filter("time is not null and subject_id is not null")
        .groupBy("subject_id")
        .agg(
            F.max("time").alias("last_event_time"),
            F.max(F.coalesce(outcomes, F.lit(False))).alias("has_outcome"),
            F.max(F.coalesce(competing, F.lit(False))).alias("has_competing"),
        )
    )
    days = F.expr("timestampdiff(SECOND, index_date, last_event_time) / 86400.0D")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return index.join(seen, "subject_id", "left").select("subject_id", "index_date", "last_event_time", days.alias("observed_days"), flag("has_outcome"), flag("has_competing"))


def short_follow_up(followed: DataFrame, required_days: float, censor: bool) -> DataFrame:
    """Subjects observed for less than the horizon that nothing exempts."""
    short = F.col("observed_days").isNull() | (F.col("observed_days") < required_days)
    exempt = F.col("has_outcome") | F.col("has_competing") if censor else F.col("has_outcome")
    return followed.filter(short & ~exempt).drop("has_outcome", "has_competing").withColumn("required_days", F.lit(float(required_days)))


def split_overlap(splits: DataFrame) -> DataFrame:
    per = splits.groupBy("subject_id").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    return per.select("subject_id", F.array_join("s", ",").alias("splits"), F.size("s").cast("bigint").alias("n_splits"))


def early_test_subjects(splits: DataFrame, index: DataFrame) -> DataFrame:
    """Test subjects indexed before the last training index date."""
    dated = splits.join(index, "subject_id")
    last = dated.filter("split = 'train'").agg(F.max("index_date").alias("train_max_index_date"))
    test = dated.filter("split = 'test'").select("subject_id", "index_date")
    return test.crossJoin(F.broadcast(last)).filter("index_date < train_max_index_date")  # one row


def in_window_subjects(outcomes: DataFrame, horizon_days: float) -> DataFrame:
    """Subjects with an outcome after the index date and within the horizon."""
    return outcomes.filter(F.col("time") > F.col("index_date")).filter(F.expr(cx.DAYS) <= horizon_days).select("subject_id").distinct()


def unsupported_positives(labels: DataFrame, in_window: DataFrame) -> DataFrame:
    positive = labels.filter("label").select("subject_id", "label")
    # a null subject matches no outcome and stays, as in an outer join
    return positive.join(in_window, "subject_id", "left_anti").withColumn("outcome_in_window", F.lit(False))


def straddling_members(events: DataFrame, splits: DataFrame, group_column: str) -> DataFrame:
    """Members of groups whose subjects are in several splits.

    Groups are reduced to their (group, split) pairs before they meet, so a hot group is
    as small as the number of splits; only then its members are fetched, by a join that
    deals both sides anew, so that AQE can split the group.
    """
    member = events.select("subject_id", F.col(group_column).alias("grp")).filter("grp is not null and subject_id is not null").distinct()
    member = member.join(splits, "subject_id")
    pairs = member.select("grp", "split").distinct()
    wide = pairs.groupBy("grp").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    wide = wide.select("grp", F.size("s").cast("bigint").alias("n_splits"), F.array_join("s", ",").alias("splits"))
    anew = lambda d: d.select(F.struct("grp").alias("key"), *(c for c in d.columns if c != "grp"))  # noqa: E731  a fresh key forces an exchange
    return anew(member).join(anew(wide), "key").select("subject_id", F.col("key.grp").alias("group_id"), "split", "n_splits", "splits")


def signatures(events: DataFrame) -> DataFrame:
    """Sorted distinct static codes of each subject, at least two."""
    facts = events.filter("time is null and subject_id is not null and code is not null").groupBy("subject_id")
    out = facts.agg(F.array_sort(F.collect_set("code")).alias("codes")).filter(F.size("codes") > 1)
    return out.select("subject_id", "codes", F.array_join("codes", "|").alias("signature"), F.size("codes").cast("bigint").alias("n_facts"))


def duplicate_subjects(signed: DataFrame, listed: int = 50) -> DataFrame:
    """One row for each subject that shares its signature, with how many do and the first ``listed`` of them.

    A group is counted and listed in parts, each with its own first ids, before the parts
    meet, so no list grows with the group; it is joined back by a hash of the codes.
    """
    key, part = F.xxhash64("codes").alias("key"), F.pmod(F.xxhash64("subject_id"), F.lit(1024)).alias("part")
    first = lambda ids: F.slice(F.array_sort(ids), 1, listed)
    parts = signed.select(key, "codes", part, "subject_id").groupBy("key", "codes", "part").agg(F.count("*").alias("n"), first(F.collect_set("subject_id")).alias("ids"))
    groups = parts.groupBy("key", "codes").agg(F.sum("n").alias("n_subject_ids"), first(F.flatten(F.collect_list("ids"))).alias("ids"))
    shared = groups.filter("n_subject_ids > 1").select("key", "codes", "n_subject_ids", F.array_join("ids", ",").alias("subject_ids"))
    return signed.withColumn("key", F.xxhash64("codes")).join(shared, ["key", "codes"]).select("subject_id", "signature", "n_facts", "n_subject_ids", "subject_ids")


def beyond_horizon(outcomes: DataFrame, horizon_days: float) -> DataFrame:
    """Outcome events past the horizon of subjects that have none within it."""
    dated = outcomes.withColumn("days_after_index", F.expr(cx.DAYS))
    inside = dated.filter((F.col("days_after_index") > 0) & (F.col("days_after_index") <= horizon_days)).select("subject_id").distinct()
    late = dated.filter((F.col("days_after_index") > horizon_days) & F.col("subject_id").isNotNull())
    return late.join(inside, "subject_id", "left_anti")


def subject_profile(events: DataFrame, index: DataFrame, outcomes, proxies, competing, horizon_days: float) -> DataFrame:
    """What LK001, LK003, LK004, LK007 and LK010 ask of a subject, in one aggregate."""
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    days = F.expr(cx.DAYS)
    return (
        cx.with_index(events, index)
        .groupBy("subject_id", "index_date")
        .agg(
            F.max("time").alias("last_event_time"),
            F.count_if(F.col("time") > F.col("index_date")).alias("n_post_index"),
            has(outcomes).alias("has_outcome"),
            has(outcomes & (days > 0) & (days <= horizon_days)).alias("outcome_in_window"),
            has(outcomes & (days > horizon_days)).alias("outcome_beyond"),
            has(proxies & (F.col("time") <= F.col("index_date"))).alias("early_proxy"),
            has(competing).alias("has_competing"),
        )
    )


# registered checks


def _need(ctx: cx.AuditContext, *rules: str) -> str | None:
    """The reason to skip, of the rules in their order."""
    task = ctx.task
    tests = {
        "index": (lambda: ctx.n_index == 0, "no subject has an index date"),
        "encounters": (lambda: not ctx.has_encounters, "no event has an encounter id; name the column with --encounter-column"),
        "outcomes": (lambda: not task.outcome.codes, "the task names no outcome codes"),
        "proxies": (lambda: not task.outcome.proxy_codes, "the task names no proxy codes"),
        "horizon": (lambda: task.horizon is None, "the task has no horizon"),
        "full": (lambda: not task.followup.require_full_horizon_for_negatives, "the task does not ask for follow-up over the full horizon"),
        "splits": (lambda: ctx.splits is None, "no split assignment was given"),
        "two": (lambda: len(ctx.split_sizes) < 2, "there are fewer than two splits"),
    }
    return next((tests[r][1] for r in rules if tests[r][0]()), None)


class PostIndexFeatures(Check):
    id, name, severity = "LK001", "post_index_features", Severity.ERROR
    description = "Features observed after the index date."
    rationale = "What happens after the prediction is made cannot be known when it is made."

    def run(self, ctx):
        if why := _need(ctx, "index"):
            return self.skip(why)
        out = []
        if ctx.features is not None and ctx.features.time_column:
            rows = post_index_rows(ctx.features.frame, ctx.index)
            query = "SELECT f.* FROM features f JOIN index_dates i USING (subject_id) WHERE f.time > i.index_date"
            message = "{n_rows} feature row(s) of {n_subjects} subject(s) are later than the index date"
            detail = {"source": "matrix", "time_column": ctx.features.time_column}
            out.append(self.finding(ctx, message, rows, ("subject_id", "feature_time", "index_date"), query, detail, name="post_index_features_matrix"))
        rows = post_index_events(ctx.events, ctx.index)
        n = ctx.n_subjects
        note = "an observation: events after the index date are a leak only if features are drawn from them"
        if ctx.features is not None and not ctx.features.time_column:
            note += "; the feature matrix has no time column, so its rows were not compared"
        query = "SELECT e.* FROM events e JOIN index_dates i USING (subject_id) WHERE e.time > i.index_date"
        found = make_finding(
            self.id, "post_index_features_events", Severity.INFO, "{n_rows} event(s) of {n_subjects} subject(s) are later than the index date", rows, n,
            ("subject_id", "time", "code", "code_system", "index_date"), query, {"source": "events", "note": note}, keep=False,
        )
        found.detail["n_post_index_events"] = found.n_rows
        return [*out, found]


class SameEncounter(Check):
    id, name, severity = "LK002", "same_encounter", Severity.ERROR
    description = "Outcomes in the encounter that starts the prediction."
    rationale = "Codes of one encounter are often assigned together, at its end."

    def run(self, ctx):
        if why := _need(ctx, "encounters", "index", "outcomes"):
            return self.skip(why)
        if ctx.with_index().isEmpty():
            return self.skip("no timed event belongs to a subject with an index date")
        encounters = index_encounters(ctx.events, ctx.index)
        if encounters.isEmpty():
            return self.skip("no event at an index date has an encounter id")
        rows = same_encounter(ctx.match(ctx.with_index(), ctx.task.outcome.codes), encounters)
        query = "SELECT o.* FROM outcomes o JOIN index_encounters x ON o.subject_id = x.subject_id AND o.encounter_id = x.index_encounter"
        message = "{n_rows} outcome event(s) of {n_subjects} subject(s) are in the index encounter"
        return [self.finding(ctx, message, rows, ("subject_id", "time", "code", "encounter_id", "index_encounter"), query)]


class OutcomeProxy(Check):
    id, name, severity = "LK003", "outcome_proxy", Severity.WARNING
    description = "Proxies of the outcome at or before the index date."
    rationale = "A treatment or test that follows only from the outcome gives it away."

    def run(self, ctx):
        if why := _need(ctx, "proxies", "index"):
            return self.skip(why)
        rows = early_proxies(ctx.match(ctx.with_index(), ctx.task.outcome.proxy_codes))
        query = "SELECT DISTINCT e.* FROM events e JOIN index_dates i USING (subject_id) WHERE e.code IN (proxies) AND e.time <= i.index_date"
        detail = {"n_proxy_codes": sum(len(s.values) for s in ctx.task.outcome.proxy_codes)}
        message = "{n_rows} proxy event(s) of {n_subjects} subject(s) are at or before the index date"
        return [self.finding(ctx, message, rows, ("subject_id", "time", "code", "code_system", "index_date"), query, detail)]


class ImmortalTime(Check):
    id, name, severity = "LK004", "immortal_time", Severity.ERROR
    description = "Negatives not followed over the whole horizon."
    rationale = "Whoever was not observed long enough cannot be known to be negative."

    def run(self, ctx):
        if why := _need(ctx, "horizon", "full", "index"):
            return self.skip(why)
        task = ctx.task
        bare = [v for s in task.outcome.competing_codes for v in s.values]
        followed = follow_up(ctx.events, ctx.index, cx.matches(task.outcome.codes, ctx.has_systems), F.col("code").isin(bare) if bare else F.lit(False)).persist()
        censor = task.followup.allow_death_as_censoring
        rows = short_follow_up(followed, task.horizon.days, censor).withColumn("horizon", F.lit(str(task.horizon)))
        exempt = followed.agg(F.count_if("has_outcome"), F.count_if("has_competing")).first()
        query = "SELECT i.* FROM index_dates i LEFT JOIN last_event l USING (subject_id) WHERE (observed_days IS NULL OR observed_days < horizon) AND NOT exempt"
        detail = {"horizon_days": task.horizon.days, "n_exempt_outcome": exempt[0], "n_exempt_competing": exempt[1] if censor else 0, "allow_death_as_censoring": censor}
        try:
            message = f"{{n_subjects}} subject(s) without outcome were followed for less than the horizon of {task.horizon}"
            return [self.finding(ctx, message, rows, ("subject_id", "index_date", "last_event_time", "observed_days", "required_days", "horizon"), query, detail)]
        finally:
            followed.unpersist()


class SplitOverlap(Check):
    id, name, severity = "LK005", "split_overlap", Severity.ERROR
    description = "Subjects in more than one split."
    rationale = "A model is not tested on whom it has seen."

    def run(self, ctx):
        from ..sources.splits import overlaps

        if why := _need(ctx, "splits", "two"):
            return self.skip(why)
        total = ctx.splits.select("subject_id").distinct().count()
        detail = {"sizes": ctx.split_sizes, "overlaps": {f"{r.a}|{r.b}": r.n_shared for r in overlaps(ctx.splits).orderBy("a", "b").collect()}}
        query = "SELECT subject_id, string_agg(DISTINCT split) FROM splits GROUP BY subject_id HAVING count(DISTINCT split) > 1"
        message = "{n_subjects} subject(s) are in more than one split"
        return [self.finding(ctx, message, split_overlap(ctx.splits), ("subject_id", "splits", "n_splits"), query, detail, total=total or ctx.n_subjects)]


class TemporalSplit(Check):
    id, name, severity = "LK006", "temporal_split", Severity.WARNING
    description = "Test subjects indexed before the last training subject."
    rationale = "A temporal split promises that testing lies in the future of training."

    def run(self, ctx):
        if why := _need(ctx, "splits"):
            return self.skip(why)
        if not {"train", "test"} <= set(ctx.split_sizes):
            return self.skip("the splits lack train or test")
        if why := _need(ctx, "index"):
            return self.skip(why)
        if ctx.splits.filter("split = 'train'").join(ctx.index, "subject_id").isEmpty():
            return self.skip("no training subject has an index date")
        severity = Severity.ERROR if ctx.task.splits.temporal else Severity.WARNING
        query = "SELECT t.* FROM test t WHERE t.index_date < (SELECT max(index_date) FROM train)"
        message = "{n_subjects} test subject(s) are indexed before the last training subject"
        rows = early_test_subjects(ctx.splits, ctx.index)
        return [self.finding(ctx, message, rows, ("subject_id", "index_date", "train_max_index_date"), query, total=ctx.split_sizes["test"], severity=severity)]


class LabelDefinition(Check):
    id, name, severity = "LK007", "label_definition", Severity.ERROR
    description = "Positive labels without an outcome within the horizon."
    rationale = "A label that its own definition does not support is wrong or leaks."

    def run(self, ctx):
        if ctx.labels is None or "label" not in ctx.labels.columns:
            return self.skip("no labels were given")
        if why := _need(ctx, "outcomes", "horizon"):
            return self.skip(why)
        total = ctx.labels.filter("label is not null").count()
        if not total:
            return self.skip("all labels are null")
        inside = in_window_subjects(ctx.match(ctx.timed, ctx.task.outcome.codes).join(ctx.index, "subject_id"), ctx.task.horizon.days)
        rows = unsupported_positives(ctx.labels, inside).withColumns({"horizon": F.lit(str(ctx.task.horizon)), "why": F.lit("no outcome event within the horizon after the index date")})
        query = "SELECT l.* FROM labels l WHERE l.label AND NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.subject_id = l.subject_id AND 0 < days AND days <= horizon)"
        message = "{n_rows} positive label(s) of {n_subjects} subject(s) have no outcome within the horizon"
        return [self.finding(ctx, message, rows, ("subject_id", "label", "outcome_in_window", "horizon", "why"), query, total=total)]


class EncounterGroup(Check):
    id, name, severity = "LK008", "encounter_group", Severity.ERROR
    description = "Groups whose members are in different splits."
    rationale = "Rows of one encounter, site or provider share what the model should not learn."

    def run(self, ctx):
        if why := _need(ctx, "splits", "two"):
            return self.skip(why)
        column = ctx.task.splits.group_column or "encounter_id"
        if column not in ctx.events.columns:
            return self.skip(f"the events have no column {column}")
        if ctx.events.filter(F.col(column).isNotNull()).isEmpty():
            return self.skip(f"the column {column} is null everywhere")
        if ctx.events.filter(F.col(column).isNotNull()).join(ctx.splits, "subject_id", "left_semi").isEmpty():
            return self.skip("no grouped event belongs to a subject of the splits")
        rows = straddling_members(ctx.events, ctx.splits, column).persist()
        try:
            detail = {"n_groups": rows.agg(F.count_distinct("group_id")).first()[0], "group_column": column}
            query = "SELECT m.* FROM members m WHERE group_id IN (SELECT group_id FROM members GROUP BY group_id HAVING count(DISTINCT split) > 1)"
            message = "{n_subjects} subject(s) share a group with a subject of another split"
            return [self.finding(ctx, message, rows, ("subject_id", "group_id", "split", "n_splits", "splits"), query, detail)]
        finally:
            rows.unpersist()


class DuplicateSubjects(Check):
    id, name, severity = "LK009", "duplicate_subjects", Severity.WARNING
    description = "Subjects with the same static facts."
    rationale = "One person under two ids may be in training and in testing."

    def run(self, ctx):
        if ctx.profile["null_time"] == 0:
            return self.skip("there are no static events")
        if ctx.events.filter("time is null and subject_id is not null and code is not null").isEmpty():
            return self.skip("no subject has a signature of static facts")
        signed = signatures(ctx.events).persist()
        try:
            n, kinds = signed.agg(F.count("*"), F.count_distinct("signature")).first()
            if n and kinds / n < SIGNATURE_FLOOR:
                return self.skip(f"{kinds} signatures for {n} subjects are too coarse: agreement would be arithmetic rather than evidence")
            query = "SELECT s.* FROM signatures s WHERE signature IN (SELECT signature FROM signatures GROUP BY signature HAVING count(*) > 1)"
            message = "{n_subjects} subject(s) share all their static facts with another"
            return [self.finding(ctx, message, duplicate_subjects(signed), ("subject_id", "signature", "n_facts", "n_subject_ids", "subject_ids"), query)]
        finally:
            signed.unpersist()


class HorizonViolation(Check):
    id, name, severity = "LK010", "horizon_violation", Severity.ERROR
    description = "Outcomes beyond the horizon only."
    rationale = "An outcome past the horizon must not make a subject positive."

    def run(self, ctx):
        if why := _need(ctx, "horizon", "outcomes", "index"):
            return self.skip(why)
        days = ctx.task.horizon.days
        outcomes = ctx.match(ctx.timed, ctx.task.outcome.codes).join(ctx.index, "subject_id").persist()
        try:
            inside = outcomes.filter(F.expr(cx.DAYS).between(1e-9, days)).agg(F.count_distinct("subject_id")).first()[0]
            query = "SELECT o.* FROM outcomes o WHERE days > horizon AND subject_id NOT IN (SELECT subject_id FROM outcomes WHERE 0 < days AND days <= horizon)"
            message = f"{{n_rows}} outcome event(s) of {{n_subjects}} subject(s) lie beyond the horizon of {ctx.task.horizon} only"
            columns = ("subject_id", "time", "code", "index_date", "days_after_index")
            return [self.finding(ctx, message, beyond_horizon(outcomes, days), columns, query, {"horizon_days": days, "n_in_window_subjects": inside})]
        finally:
            outcomes.unpersist()


BATTERY = (
    PostIndexFeatures, SameEncounter, OutcomeProxy, ImmortalTime, SplitOverlap,
    TemporalSplit, LabelDefinition, EncounterGroup, DuplicateSubjects, HorizonViolation,
)

for _check in BATTERY:
    register(_check(), replace=True)

__all__ = ["BATTERY", "Finding", "Skipped"]
