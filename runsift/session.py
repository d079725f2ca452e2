"""Session settings shared by the entry point, the bench and the tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Only result-relevant settings; sizing belongs to the cluster's own config.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Static: without call-site capture, a large expression needs half the JVM calls to build.
PLANNING_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on (UTC days, AQE)."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("runsift")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in {**SEMANTIC_CONF, **PLANNING_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a scratch one only when unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="runsift-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path
