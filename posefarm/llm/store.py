"""Session settings of these operators, shared tables and whole-row passing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posefarm.session import shared_folder, ship

#: Name under which an operator carries the caller's whole row, so that no column of
#: the caller can clash with one of the operator's own.
ROW = "__row"


def prepared(spark: SparkSession) -> SparkSession:
    """Settings the operators count on: bounded Arrow batches and adaptive plans."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *own: Column) -> DataFrame:
    """The operator's own columns next to the caller's row in one struct."""
    return docs.select(*own, F.struct(*[docs[c] for c in docs.columns]).alias(ROW))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Back to the caller's columns."""
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
