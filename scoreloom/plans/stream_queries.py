"""A stream over the events, run to its end, and SQL that says the same of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import quantiles
from scoreloom.plans.queries import RANGES, query
from scoreloom.streaming import monitor

#: Days whose values give the edges; days of a lot; days that a tenth of the events comes late by; days waited for.
LEARNED, LOT, LATE, WAIT = 10, 8, 9, 2
ARRIVALS = 5
FIRST = "2024-01-01"
FROZEN = tuple((b - a + 1) / 20 for a, b in RANGES)

SHARES = [k / 20 for k in range(1, 20)]
BAND = "CASE " + " ".join(f"WHEN b BETWEEN {a} AND {z} THEN {k}" for k, (a, z) in enumerate(RANGES, 1)) + " END"
PSI = " + ".join(f"(greatest(c{k} / total, 1e-6) - {s}) * ln(greatest(c{k} / total, 1e-6) / {s})" for k, s in enumerate(FROZEN, 1))
STREAM_SQL = f"""
WITH days AS (
  SELECT *, date_diff('day', DATE '{FIRST}', CAST(ts AS DATE)) AS d FROM events
), cuts AS (
  SELECT quantile_cont(value, {SHARES}) AS q FROM days WHERE d < {LEARNED}
), lots AS (
  SELECT d, ts, least((d + CASE WHEN event_id % 10 = 0 THEN {LATE} ELSE 0 END) // {LOT}, {ARRIVALS - 1}) AS lot, 1 + len(list_filter(q, lambda x: value > x)) AS b FROM days, cuts
), marks AS (
  SELECT lot, (SELECT max(ts) FROM lots e WHERE e.lot < l.lot) - INTERVAL {WAIT} DAY AS mark FROM (SELECT DISTINCT lot FROM lots) l
), seen AS (
  SELECT d, {BAND} AS band FROM lots JOIN marks USING (lot) WHERE mark IS NULL OR CAST(DATE '{FIRST}' + INTERVAL 1 DAY * (CAST(d AS INTEGER) + 1) AS TIMESTAMP) > mark
), counted AS (
  SELECT strftime(DATE '{FIRST}' + INTERVAL 1 DAY * CAST(d AS INTEGER), '%Y-%m-%d') AS day, count(*) AS n, CAST(count(*) AS DOUBLE) AS total, {", ".join(f"CAST(count(*) FILTER (WHERE band = {k}) AS DOUBLE) AS c{k}" for k in range(1, len(RANGES) + 1))} FROM seen GROUP BY 1
)
SELECT day, n, {PSI} AS psi FROM counted
"""


@query("event_stream_drift", STREAM_SQL, ["psi"])
def _(spark, sf_dir):
    """Events by day and band against the first days, as they would have come in: a tenth of them late, the latest too late."""
    day = F.datediff(F.col("ts").cast("date"), F.to_date(F.lit(FIRST)))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    learned = events.filter(day < LEARNED)
    inner = quantiles.exact_quantiles(learned, "value", SHARES)
    edges = (float("-inf"), *inner, float("inf"))
    lot = F.least(F.floor((day + F.when(F.col("event_id") % 10 == 0, LATE).otherwise(0)) / LOT), F.lit(ARRIVALS - 1))
    seen = monitor.replay(events.withColumn("arrival", lot), "arrival", ARRIVALS, edges, RANGES, score="value", width="1 day", late=f"{WAIT} days")
    return monitor.drift(seen, FROZEN).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "psi")
