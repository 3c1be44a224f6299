"""What is there: organisms, tables, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def organisms(index: DataFrame) -> DataFrame:
    """Distinct organism ids, sorted as text."""
    return index.select(F.col("tax_id").cast("string").alias("tax_id")).distinct().orderBy("tax_id")


def inventory(names: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, has_names, has_labels, complete) over both tables."""
    a = names.select(key).distinct().withColumn("n", F.lit(1))
    b = labels.select(key).distinct().withColumn("l", F.lit(1))
    both = a.join(b, key, "full")
    return both.select(key, F.col("n").isNotNull().alias("has_names"), F.col("l").isNotNull().alias("has_labels"), (F.col("n").isNotNull() & F.col("l").isNotNull()).alias("complete"))


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder can be read, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def available(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    return {name: readable(spark, path) for name, path in paths.items()}
