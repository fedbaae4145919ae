"""Session settings shared by the tests, the bench and the entry point."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pitpanel", cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A local session; on a cluster the session is handed in and nothing here is used."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a folder of its own only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pitpanel-ckpt-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """A panel that several passes read, written once to the checkpoint folder.

    Meant for panels already reduced to one row per entity and period. A lost executor costs a
    re-read, and the passes do not repeat the scans and joins that made the panel."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
