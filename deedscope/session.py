"""One place that builds a session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "deedscope",
    *,
    master: str | None = None,
    warehouse_dir: str | None = None,
    checkpoint_dir: str | None = None,
    shuffle_partitions: int | None = None,
    hive: bool = False,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session; everything left out keeps the cluster's own setting."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Aggregates above a join must not stop a skewed join from being split.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    optional = {
        "spark.sql.warehouse.dir": warehouse_dir,
        "spark.checkpoint.dir": checkpoint_dir,
        "spark.sql.shuffle.partitions": shuffle_partitions,
    }
    for key, value in {**optional, **(conf or {})}.items():
        if value is not None:
            builder = builder.config(key, str(value))
    if master:
        builder = builder.master(master)
    if hive:
        builder = builder.enableHiveSupport()
    return builder.getOrCreate()
