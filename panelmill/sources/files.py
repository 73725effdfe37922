"""Readers and writers: parquet pieces, all-string CSV (UTF-8 with mark, MS949), XML items, JSON bodies, stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pieces(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All parquet pieces below a folder, columns united by name."""
    r = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.parquet(path)


def union_pieces(frames: list[DataFrame]) -> DataFrame:
    """Union by name of already opened pieces; pieces without columns are skipped."""
    kept = [f for f in frames if f.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def read_text_csv(spark: SparkSession, path, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV with header, every column a string (codes keep their zeros), byte-order mark removed from the first name."""
    if encoding.upper() in ("CP949", "MS949"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        encoding = "MS949"
    r = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).option("multiLine", False)
    if columns:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = r.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def with_line_numbers(df: DataFrame, name: str = "line") -> DataFrame:
    """File order of a small reference table read as one piece."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_items_xml(spark: SparkSession, path, row_tag: str = "item", schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", False)).load(path)


def flatten_bodies(df: DataFrame, body: str, schema, records: str, children: str, prefix: str = "") -> DataFrame:
    """JSON bodies -> one row per child of each record; records without children stay with NULL child fields."""
    parsed = df.withColumn("_b", F.from_json(body, schema))
    rec = parsed.select(*[c for c in df.columns if c != body], F.explode_outer(F.col(f"_b.{records}")).alias("_r"))
    fields = [f for f in rec.schema["_r"].dataType.fieldNames() if f != children]
    out = rec.select(*[c for c in rec.columns if c != "_r"], *[F.col(f"_r.{f}").alias(f) for f in fields], F.explode_outer(F.col(f"_r.{children}")).alias("_c"))
    kids = out.schema["_c"].dataType.fieldNames()
    return out.select(*[c for c in out.columns if c != "_c"], *[F.col(f"_c.{k}").alias(prefix + k) for k in kids])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> bool:
    """Parquet folder; an empty table is skipped. Returns whether it was written."""
    if df.isEmpty():
        return False
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return True


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def stored(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """Build once, keep as parquet, reuse afterwards (the folder's success marker decides)."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    exists = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if rebuild or not exists:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def new_pieces(pieces: DataFrame, ingested: DataFrame, key: str) -> DataFrame:
    """Pieces not landed yet."""
    return pieces.join(ingested.select(key).distinct(), key, "left_anti")


def calendar(spark: SparkSession, first: str, last: str, name: str = "date") -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(name))
