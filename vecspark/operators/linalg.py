"""Dense kernels on tables: vector times matrix, and sums in several orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(spark: SparkSession, n: int) -> DataFrame:
    """``i, j, v`` with v = i + j."""
    return spark.range(n).withColumnRenamed("id", "i").select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j")).withColumn("v", (F.col("i") + F.col("j")).cast("double"))


def vector(spark: SparkSession, n: int) -> DataFrame:
    """``j, x`` with x = j."""
    return spark.range(n).select(F.col("id").alias("j"), F.col("id").cast("double").alias("x"))


def multiply(vec: DataFrame, mat: DataFrame) -> DataFrame:
    """``i, out``: for each column i of the matrix (rows j), the sum of x[j] times M[j][i]."""
    rows = mat.select(F.col("i").alias("j"), F.col("j").alias("i"), "v")
    return rows.join(vec, "j").groupBy("i").agg(F.sum(F.col("x") * F.col("v")).alias("out"))


def total(values: DataFrame, column: str = "v") -> DataFrame:
    return values.agg(F.sum(column).alias("total"))


def total_in_chains(values: DataFrame, chains: int, index: str = "i", column: str = "v") -> DataFrame:
    """The sum over ``chains`` accumulators, by index modulo their number."""
    return values.groupBy(F.pmod(F.col(index), F.lit(chains)).alias("chain")).agg(F.sum(column).alias("part")).agg(F.sum("part").alias("total"))


def total_by_folding(values: DataFrame, n: int, mode: int, index: str = "i", column: str = "v") -> DataFrame:
    """The sum by halving: mode 1 adds the upper half to the lower one, mode 2 adds neighbours.

    ``n`` is a power of two.  Any other mode gives -1, unless there is one value
    only.  Each step is a hash aggregation of half as many groups.
    """
    now = values.select(F.col(index).alias("i"), F.col(column).alias("v"))
    if mode not in (1, 2):
        return now.agg((F.max("v") if n == 1 else F.lit(-1.0)).alias("total"))
    while n > 1:
        n //= 2
        place = F.pmod(F.col("i"), F.lit(n)) if mode == 1 else F.floor(F.col("i") / 2)
        now = now.groupBy(place.alias("i")).agg(F.sum("v").alias("v"))
    return now.select(F.col("v").alias("total"))
