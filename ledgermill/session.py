"""Session settings used by the jobs, the tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Adaptive execution picks join strategies, splits skewed partitions and sizes shuffles at
# run time; the values below only give it room to do so.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long column expressions are built once per plan; skip recording a stack for each call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Methods beyond this size are never compiled by the JVM and run interpreted. Wide parsing
# projections exceed it as one whole-stage method, so they are generated per operator instead.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings that can change on a running session."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "ledgermill", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters pass their own session in."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **JOB_CONF,
        **TUNING,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_TEST_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a session on one machine that names none (tests) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
    if context.applicationId not in _TEST_FOLDERS:
        _TEST_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="ledgermill-")
    return _TEST_FOLDERS[context.applicationId]
