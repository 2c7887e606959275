"""The band cube: additive sums by sample, month and bin, from which bands, stability, months and the curve follow.

A row adds up loans and nothing else, so cubes of different months, or of parts of one, are merged by adding.
A stored cube is a table partitioned by the edges that its bins have and by month. Appending a month
again replaces it, so a month whose loans have matured since is simply counted anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.columns import ADDITIVE, Ranges
from scoreloom.functions.ordering import RISING, Ordering
from scoreloom.operators.bands import derived, sums, with_bands
from scoreloom.operators.quantiles import edge_table

KEYS = ("sample_group", "application_month", "bin_order")
#: Of loans in no sample the month is not kept, as no report asks for it and it may be any text.
NO_MONTH = "none"
SUMS = (*ADDITIVE, "score_sum", "score_n")


def cube(binned: DataFrame) -> DataFrame:
    """(sample_group, application_month, bin_order, sums, score extent) of binned loans; one pass, partial sums."""
    known = F.when(F.col("sample_group").isin("train", "oot"), F.col("application_month"))
    return sums(binned.withColumn("application_month", known), *KEYS)


def merged(cubes: DataFrame, *by: str) -> DataFrame:
    """Sums of cube rows by some of their columns."""
    extent = [F.min("score_min").alias("score_min"), F.max("score_max").alias("score_max")]
    return cubes.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], *extent)


# What follows from a cube ------------------------------------------------------------------------


def bin_sums(cubes: DataFrame, edges: Sequence[float], group: str = "train") -> DataFrame:
    """A row for each interval between edges of one sample, zeros where no row fell."""
    table = edge_table(cubes.sparkSession, edges)
    found = merged(cubes.filter((F.col("sample_group") == group) & F.col("bin_order").isNotNull()), "bin_order")
    joined = F.broadcast(table).join(found, "bin_order", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in SUMS})


def bands(cubes: DataFrame, ranges: Ranges, *by: str, ordering: Ordering = RISING) -> DataFrame:
    """Band statistics within by."""
    placed = with_bands(cubes, ranges)
    return derived(merged(placed, *by, "band_order", "band"), "band_order", list(by), ordering)


def months(cubes: DataFrame, ranges: Ranges, ordering: Ordering = RISING) -> DataFrame:
    """Band statistics of each month of both samples."""
    rows = cubes.filter(F.col("sample_group").isin("train", "oot") & F.col("application_month").isNotNull() & F.col("bin_order").isNotNull())
    return bands(rows, ranges, "sample_group", "application_month", ordering=ordering).filter("band_order is not null")


def band_counts(cubes: DataFrame, ranges: Ranges) -> DataFrame:
    """(band_order, train_n, oot_n): rows, with or without an application id, for the stability index."""
    placed = with_bands(cubes, ranges).filter("band_order is not null")
    # Rows of a bin all have a score, so scores count them.
    count = lambda g: F.coalesce(F.sum(F.when(F.col("sample_group") == g, F.col("score_n"))), F.lit(0)).alias(f"{g}_n")
    return placed.groupBy("band_order").agg(count("train"), count("oot"))


# Stored cubes ------------------------------------------------------------------------------------


def edition(edges: Sequence[float]) -> str:
    """A name for bins with these edges; sums over other bins cannot be added to them."""
    return hashlib.sha256(",".join(float(e).hex() for e in edges).encode()).hexdigest()[:16]


def append(cubes: DataFrame, edges: Sequence[float], path: str) -> None:
    """Adds a cube's months to the table at path, in place of the same months there if they were added before."""
    rows = cubes.withColumns({"edition": F.lit(edition(edges)), "month": F.coalesce("application_month", F.lit(NO_MONTH))})
    writer = rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("edition", "month").parquet(path)


def read(spark: SparkSession, path: str, edges: Sequence[float]) -> DataFrame:
    """The stored cube with these edges; fails if there is none."""
    rows = spark.read.option("basePath", path).parquet(path).filter(F.col("edition").cast("string") == edition(edges))
    if rows.isEmpty():
        raise ValueError("no cube with these edges")
    return rows.drop("edition", "month")
