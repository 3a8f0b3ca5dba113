"""Session defaults and the few settings that operators read at run time."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Number of partitions that operators with costly work per row deal their input out over before it; unset: as read.
SPREAD = "spark.almagest.spread"

DEFAULTS = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("almagest")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    s = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config(SPREAD, str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoint(): the one that the cluster names in
    spark.checkpoint.dir. Where that is unset, a temporary one on a local master
    (tests); on any other an error, since executors would not share it."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "almagest-checkpoints")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; what it holds
    survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread_of(spark: SparkSession) -> int:
    """The session's SPREAD, 0 where unset."""
    return int(spark.conf.get(SPREAD, "0") or 0)
