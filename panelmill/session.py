"""Session helpers for tests, bench and scripts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, UTC and a quiet log."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelmill")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folder: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir; a local one only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="run-panelmill-", dir="/tmp")
    return _local_folder[app]


def cut_lineage(df):
    """Write the frame once as parquet in the shared folder and read it back.

    Used where several branches need the same derived rows: they are computed once, later stages can prune columns
    and see real sizes, and a lost executor costs no recomputation upstream. The folder is the cluster's checkpoint
    folder, so its retention rule clears the tables.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
