"""Re-auditing events as they arrive, with Structured Streaming.

The reference semantics have no streams; this is the same battery, run on every
micro-batch's subjects over all events seen so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..audit import AuditReport, run_audit
from ..functions.normalize import coerce_events
from ..plans.context import AuditContext
from ..plans.task import TaskSpec


def watch(
    stream: DataFrame,
    table: str,
    task: TaskSpec,
    on_report: Callable[[int, AuditReport], None],
    checkpoint: str,
    checks: list[str] | None = None,
    splits=None,
    labels=None,
    parts: int = 256,
) -> StreamingQuery:
    """Append canonical events to ``table`` (a Parquet folder) and audit the subjects touched.

    A batch that is repeated after a failure overwrites its own folder, so every event
    counts once.  The table is partitioned by a hash of the subject, and a batch reads the
    partitions of its own subjects alone.
    """
    part = F.pmod(F.xxhash64("subject_id"), F.lit(parts)).alias("part")

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        coerce_events(batch, task.splits.group_column).select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{table}/epoch={epoch}")
        new = spark.read.parquet(f"{table}/epoch={epoch}")
        met = [r.part for r in new.select("part").distinct().collect()]  # as many as there are partitions, at most
        new = new.select("subject_id").distinct()
        events = spark.read.option("basePath", table).parquet(table).filter((F.col("epoch") <= epoch) & F.col("part").isin(met)).drop("epoch", "part")
        ctx = AuditContext(events.join(new, "subject_id", "left_semi"), task, splits, labels)
        try:
            on_report(epoch, run_audit(ctx, checks))
        finally:
            ctx.close()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
