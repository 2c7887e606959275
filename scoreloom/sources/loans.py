"""Readers: CSV inputs, the wide application table, and a loan view over an orders table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.columns import as_col, clean_double, is_incomplete
from scoreloom.settings import REQUIRED

#: A byte-order mark, and the three characters that it becomes when read in the wrong encoding.
BOM, MISREAD_BOM = "﻿", "ï»¿"

NUMBERS = ("score_mlt", "duedate_1m_30", "duedate_3m_30", "principal", "estimate_principal_remaining_mob1", "estimate_principal_remaining_mob3", "dpd_days_ever_mob1", "dpd_days_ever_mob3")

#: Synthetic loans over orders; the same text runs in Spark and in DuckDB.
LOANS_SQL = """
SELECT t.*,
  CASE WHEN duedate_1m_30 IS NULL THEN NULL
       WHEN duedate_1m_30 = 1 THEN CAST(30 + application_id % 60 AS DOUBLE)
       ELSE CAST(application_id % 30 AS DOUBLE) END AS dpd_days_ever_mob1,
  CASE WHEN duedate_3m_30 IS NULL THEN NULL
       WHEN duedate_3m_30 = 1 THEN CAST(30 + application_id % 90 AS DOUBLE)
       ELSE CAST(application_id % 30 AS DOUBLE) END AS dpd_days_ever_mob3,
  CASE WHEN application_id % 101 = 0 THEN NULL
       ELSE CAST(FLOOR(principal * 0.9) AS DOUBLE) END AS estimate_principal_remaining_mob1,
  CASE WHEN application_id % 103 = 0 THEN NULL
       ELSE CAST(FLOOR(principal * 0.6) AS DOUBLE) END AS estimate_principal_remaining_mob3
FROM (
  SELECT o_orderkey AS application_id, o_custkey AS user_id, o_orderdate AS application_time,
    SUBSTR(CAST(o_orderdate AS STRING), 1, 7) AS application_month,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         ELSE o_totalprice / CAST(500000 AS DOUBLE) END AS score_mlt,
    CASE WHEN SUBSTR(CAST(o_orderdate AS STRING), 1, 7) > '2001-06' OR o_orderkey % 23 = 0 THEN NULL
         WHEN CAST((o_orderkey * 7919 + 17) % 10000 AS DOUBLE)
              < 20 + 180 * POWER(o_totalprice / CAST(500000 AS DOUBLE), 2) THEN 1
         ELSE 0 END AS duedate_1m_30,
    CASE WHEN SUBSTR(CAST(o_orderdate AS STRING), 1, 7) > '2001-04' OR o_orderkey % 23 = 0 THEN NULL
         WHEN CAST((o_orderkey * 7919 + 17) % 10000 AS DOUBLE)
              < 200 + 1600 * POWER(o_totalprice / CAST(500000 AS DOUBLE), 2) THEN 1
         ELSE 0 END AS duedate_3m_30,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL
         ELSE CAST(500 + (o_orderkey * 37) % 4500 AS DOUBLE) END AS principal,
    CASE WHEN o_orderkey % 501 = 0 THEN NULL
         WHEN o_orderkey % 29 = 0 THEN '0.Incomplete'
         WHEN o_orderkey % 31 = 0 THEN '1.In Progress'
         WHEN o_orderstatus = 'F' THEN '4.Funded'
         WHEN o_orderstatus = 'P' THEN '3.1.Approved Withdrawn'
         ELSE '2.3.Risk Declined' END AS application_status,
    CASE WHEN o_orderkey % 503 = 0 THEN NULL
         WHEN o_orderstatus = 'O' THEN '2.3.Auto Declined'
         WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN '4.Auto Approved Auto Funded'
         ELSE '3.1.Manual Approved Auto Withdrawn' END AS assessment_status,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 < 3 THEN 'Active_Account'
         WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 3 THEN 'Closed'
         WHEN o_orderstatus = 'F' THEN 'Blocked'
         WHEN o_orderstatus = 'P' THEN 'Cancelled'
         ELSE 'Declined' END AS status
  FROM {orders}
) t
"""


def segmented_sql(segment: str) -> str:
    """LOANS_SQL with a column segment, an expression over orders."""
    return LOANS_SQL.replace("  SELECT o_orderkey AS application_id,", f"  SELECT {segment} AS segment, o_orderkey AS application_id,")


def loan_view(spark: SparkSession, sf_dir: str, segment: str | None = None) -> DataFrame:
    return spark.sql(segmented_sql(segment) if segment else LOANS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def clean_names(df: DataFrame) -> DataFrame:
    """Header names without a byte-order mark, however it was read."""
    return df.toDF(*[n.lstrip(BOM).lstrip(MISREAD_BOM) for n in df.columns])


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; all columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", False)
    return clean_names((reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first by order, an explicit one as files have none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).filter("__first = 1").drop("__first")


def month_of(month: str = "application_month", time: str = "application_time"):
    """YYYY-MM from the month's first seven characters, or else from the time."""
    stamp = as_col(time).try_cast("timestamp_ntz")
    return F.coalesce(F.substring(as_col(month).cast("string"), 1, 7), F.date_format(stamp, "yyyy-MM"))


@dataclass(frozen=True)
class Loaded:
    """The scored applications; those before the score filter, for the funnel; and what was dropped."""

    scored: DataFrame
    completed: DataFrame
    everything: DataFrame

    def dropped(self) -> DataFrame:
        """One row: applications, incomplete ones, and those without a score."""
        whole = self.everything.agg(F.count(F.lit(1)).alias("applications"), F.count_if(is_incomplete()).alias("incomplete"))
        rest = self.completed.agg(F.count_if(F.col("score_mlt").isNull()).alias("without_score"))
        return whole.select(F.lit(1).alias("k"), "*").join(rest.select(F.lit(1).alias("k"), "*"), "k").drop("k")


def wide(sample: DataFrame, application: DataFrame, score: DataFrame, score_column: str) -> Loaded:
    """The application table: sample rows with application facts and a score, both kept first by key.

    Of repeated application rows the latest time comes first, then the other columns as text; of
    repeated scores the smallest.
    """
    keys = ["application_id", "user_id"]
    require(sample, tuple(keys), "sample")
    require(application, tuple(keys), "application")
    require(score, ("application_id", score_column), "score")
    new = [c for c in application.columns if c not in sample.columns]
    latest = [F.expr("try_cast(application_time AS timestamp_ntz)").desc_nulls_last()] if "application_time" in application.columns else []
    ties = F.to_json(F.struct(*new)) if new else F.lit("")
    facts = keep_first(application.select(*keys, *new), keys, [*latest, ties])
    scores = keep_first(score.select("application_id", clean_double(score_column).alias("score_mlt")), ["application_id"], [F.asc_nulls_last("score_mlt")])
    df = sample.drop("score_mlt").join(facts.drop("score_mlt"), keys, "left").join(scores, "application_id", "left")
    if "application_month" not in df.columns:
        df = df.withColumn("application_month", F.lit(None).cast("string"))
    df = df.withColumn("application_month", month_of())
    require(df, REQUIRED, "wide table")
    df = df.withColumns({c: clean_double(c) for c in NUMBERS})
    completed = df.filter(~is_incomplete())
    return Loaded(completed.filter(F.col("score_mlt").isNotNull()), completed, df)


def extract(applications: DataFrame, since: str, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Chosen columns of the applications from a day on; both reach the scan."""
    return applications.filter(F.col("application_time") >= F.lit(since).cast("timestamp_ntz")).select(*[c for c in columns if c in applications.columns])
