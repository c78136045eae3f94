"""Session settings that the plans rely on; the caller's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # no call site per column expression: plans of many columns build faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def sized(input_bytes: int, per_task: int = 128 << 20) -> dict[str, str]:
    """Settings for an input size: enough shuffle partitions that one fits a task.

    Adaptive execution merges what turns out small, so a count that is too high
    costs little, where one that is too low spills.
    """
    tasks = max(8, -(-input_bytes // per_task))
    return {
        **ADAPTIVE,
        "spark.sql.files.maxPartitionBytes": str(per_task),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(per_task),
        "spark.sql.shuffle.partitions": str(tasks),
    }


def session(name: str, settings: dict[str, str] | None = None, master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
