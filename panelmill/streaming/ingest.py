"""Incremental landing of raw pieces: every file is taken once, a restart resumes from the checkpoint."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _landed(spark: SparkSession, target: str) -> int:
    """Rows of the target so far, from the files' footers; none before the first run."""
    try:
        return spark.read.parquet(target).count()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise


def land_new_files(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, file_format: str = "parquet",
    max_files: int = 1000, options: dict | None = None,
) -> int:
    """Append files that appeared since the last run, then stop. Returns the rows landed in this run.

    The checkpoint records finished files and batches; source, target and checkpoint must be shared folders.
    """
    before = _landed(spark, target)
    r = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", max_files)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    q = (
        r.load(source).withColumn("_piece", F.input_file_name())
        .writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return _landed(spark, target) - before


def land_and_aggregate(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, aggregate, file_format: str = "parquet",
) -> None:
    """Per batch of new files: aggregate and write one folder named by the batch, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        aggregate(batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    q = (
        spark.readStream.format(file_format).schema(schema).load(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
