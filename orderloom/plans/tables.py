"""Where the tables of a data directory are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables below so many bytes on disk may be spread: their few row groups would be as few tasks.
SMALL = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table spread over all cores by a key; a larger one, whose row groups are many, is read as it lies.

    Only the layout differs, never the rows. The size is the optimizer's, of files on disk, so nothing is read for it.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if size < SMALL else df
