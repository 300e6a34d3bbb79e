"""Adapters from star-schema and clickstream tables to canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import EVENT_SCHEMA, coerce_events
from ..plans.task import TaskSpec


def _shape(df: DataFrame, **columns) -> DataFrame:
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subjects, orders as encounters, lines as events, master data as static facts."""
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    c = F.col
    who = {"subject_id": c("o_custkey"), "time": c("o_orderdate"), "encounter_id": c("o_orderkey")}
    shipped = lines.join(orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    parts = [
        _shape(orders, **who, code=c("o_orderpriority"), code_system=F.lit("PRIORITY"), numeric_value=c("o_totalprice")),
        _shape(orders, **who, code=F.concat(F.lit("STATUS_"), "o_orderstatus"), code_system=F.lit("STATUS")),
        _shape(
            shipped,
            subject_id=c("o_custkey"),
            time=c("l_shipdate"),
            code=F.concat(F.lit("SHIP_"), "l_returnflag", "l_linestatus"),
            code_system=F.lit("SHIP"),
            numeric_value=c("l_extendedprice"),
            encounter_id=c("l_orderkey"),
        ),
    ]
    facts = F.array(
        F.concat(F.lit("SEG_"), "c_mktsegment"),
        F.concat(F.lit("NAT_"), c("c_nationkey").cast("string")),
        F.concat(F.lit("BAL_"), F.floor(c("c_acctbal") / 100).cast("string")),
    )
    parts.append(_shape(customer.select("c_custkey", F.explode(facts).alias("fact")), subject_id=c("c_custkey"), code=c("fact"), code_system=F.lit("DEMO")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retail_task(horizon: str = "1y", **outcome) -> TaskSpec:
    codes = {"codes": [{"values": ["1-URGENT"], "system": "PRIORITY"}], "proxy_codes": [{"values": ["5-LOW"], "system": "PRIORITY"}]}
    return TaskSpec.from_dict({"task": "retail", "index": {"event": "STATUS_F", "code_system": "STATUS"}, "outcome": codes | outcome, "horizon": horizon})


def retail_splits(spark: SparkSession, sf_dir: str, overlap: bool = False) -> DataFrame:
    """Six tenths train, two valid, two test, by key; with ``overlap`` every tenth also validates."""
    key = table(spark, sf_dir, "customer").select("c_custkey")
    bucket = F.col("c_custkey") % 10
    split = F.when(bucket < 6, "train").when(bucket < 8, "valid").otherwise("test")
    out = key.select(F.col("c_custkey").cast("string").alias("subject_id"), split.alias("split"))
    again = key.filter("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("subject_id"), F.lit("valid").alias("split"))
    return out.unionByName(again) if overlap else out


def clickstream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, events = F.col, table(spark, sf_dir, "events")
    day = F.concat(c("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    return coerce_events(
        events.select(
            c("user_id").alias("subject_id"), c("ts").alias("time"), c("event_type").alias("code"), c("value").alias("numeric_value"), c("props").alias("text_value"), day.alias("encounter_id")
        )
    )
