"""What a query's scans did: operator metrics of the executed plan, a profile of scan streams, progress."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Bytes and nanoseconds of one handshake.
HANDSHAKE_BYTES, CYCLE_NS = 64, 4
# The profile's columns, in order.
COLUMNS = (
    "stream long, in_handshakes_cycles long, in_starved_cycles long, in_stalled_cycles long, in_idle_cycles long, in_last_handshakes long, "
    "out_handshakes_cycles long, out_starved_cycles long, out_stalled_cycles long, out_idle_cycles long, out_last_handshakes long, "
    "in_throughput_gbps double, in_throughput_excl_idle_gbps double, out_throughput_gbps double, out_throughput_excl_idle_gbps double"
)

VECTORED = "parquet.hadoop.vectored.io.enabled"
#: By application: (bytes read, milliseconds of its tasks, tasks) of each stage of the last measured query that read files.
_LAST: dict[str, list[tuple[int, int, int]]] = {}


def _nodes(plan) -> Iterator:  # noqa: ANN001
    """The executed plan's nodes, through adaptive stages to their final plans."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def run_measured(df: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """Run a query for its metrics: (operator, its metrics by name) of every node."""
    spark = df.sparkSession
    sc, tag = spark.sparkContext, f"lodestar-{uuid.uuid4().hex}"
    execution = df._jdf.queryExecution()
    # Vectored reads happen in threads whose bytes no task's counter sees.
    held = spark.conf.get(VECTORED, None)
    spark.conf.set(VECTORED, "false")
    sc.addJobTag(tag)
    try:
        execution.toRdd().count()
    finally:
        sc.removeJobTag(tag)
        if held is None:
            spark.conf.unset(VECTORED)
        else:
            spark.conf.set(VECTORED, held)
    out = []
    for node in _nodes(execution.executedPlan()):
        metrics, found = node.metrics(), {}
        keys = metrics.keysIterator()
        while keys.hasNext():
            key = keys.next()
            found[key] = max(0, metrics.apply(key).value())
        out.append((node.nodeName(), found))
    _LAST[sc.applicationId] = _stages_read(spark, tag)
    return out


def _stages_read(spark: SparkSession, tag: str) -> list[tuple[int, int, int]]:
    """What the stages of the jobs with a tag read, by their tasks' own counters."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    store, out = context.statusStore(), []
    for job in sorted(context.statusTracker().getJobIdsForTag(tag)):
        stages = store.job(job).stageIds()
        for i in range(stages.size()):
            stage = store.lastStageAttempt(stages.apply(i))
            if stage.inputBytes() > 0:
                out.append((stage.inputBytes(), stage.executorRunTime(), stage.numCompleteTasks()))
    return out


def scan_metrics(df: DataFrame) -> DataFrame:
    """(node, operator, metric, value): milliseconds, bytes or rows, as Spark counts them."""
    rows = [(i, name, metric, int(value)) for i, (name, found) in enumerate(run_measured(df)) for metric, value in sorted(found.items())]
    return df.sparkSession.createDataFrame(rows, "node int, operator string, metric string, value long")


def throughput(handshakes: int, cycles: int) -> float:
    """GB/s of so many handshakes in so many cycles; 0 without cycles."""
    return handshakes * HANDSHAKE_BYTES / (cycles * CYCLE_NS) if cycles else 0.0


def scan_profile(spark: SparkSession) -> DataFrame:
    """A row for each stage of the last measured query that read files, and a last one for reads that bypass decoding, of which Spark has none.

    Handshakes are the bytes that the stage's tasks really read, over 64; the throughput without idle time is that
    of the tasks' time. Spark knows nothing of cycles that starved, stalled or idled, nor of what decoders hand on:
    those columns are null.
    """
    scans = _LAST.get(spark.sparkContext.applicationId, [])
    rows: list[tuple] = []
    for stream, (size, ms, tasks) in enumerate(scans):
        hands = -(-size // HANDSHAKE_BYTES)
        # No stream moves more than a handshake a cycle.
        cycles = max(hands, ms * 1_000_000 // CYCLE_NS)
        rows.append((stream, hands, None, None, None, tasks, *[None] * 5, throughput(hands, cycles), throughput(hands, cycles), None, None))
    rows.append((len(scans), *[None] * 5, 0, 0, 0, 0, 0, None, None, 0.0, 0.0))
    return spark.createDataFrame(rows, COLUMNS)


def progress(spark: SparkSession, group: str | None = None) -> float:
    """Per cent of the tasks of the active jobs that are done, 100 where there are none."""
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(group) if group else tracker.getActiveJobsIds()
    total = done = 0
    for job in jobs:
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            s = tracker.getStageInfo(stage)
            if s:
                total, done = total + s.numTasks, done + s.numCompletedTasks
    return min(100.0, 100.0 * done / total) if total else 100.0
