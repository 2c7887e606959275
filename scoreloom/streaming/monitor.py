"""Live monitoring, an extension: band counts of scored events by time window, and their stability."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.columns import Ranges, band_letter, band_order, ratio
from scoreloom.functions.ordering import RISING, Ordering


def windowed(events: DataFrame, edges: Sequence[float], ranges: Ranges, time: str = "ts", score: str = "score_mlt", width: str = "1 day", late: str = "2 days", ordering: Ordering = RISING) -> DataFrame:
    """(window, counts): a stream or table of scored events, counted by band within a watermark.

    A window's bands stay in one row, so that a stream's update always holds the whole window.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    rows = rows.withColumn("band_order", band_order(ordering.bucket(score, edges), ranges))
    counts = F.array(*[F.count_if(F.col("band_order") == k) for k in range(1, len(ranges) + 1)])
    return rows.groupBy(F.window(time, width).alias("window")).agg(counts.alias("counts"))


def by_band(counts: DataFrame) -> DataFrame:
    """(window, band_order, band, n) from windowed()."""
    return counts.select("window", F.posexplode("counts").alias("k", "n")).select("window", (F.col("k") + 1).alias("band_order"), band_letter(F.col("k") + 1).alias("band"), "n")


def drift(counts: DataFrame, frozen: Sequence[float], floor: float = 1e-6) -> DataFrame:
    """Stability of each window against frozen training shares, band A first."""
    known = [F.get("counts", k) for k in range(len(frozen))]
    total = sum(known[1:], known[0])
    parts = []
    for n, share in zip(known, frozen):
        now, base = F.greatest(ratio(n, total), F.lit(floor)), max(float(share), floor)
        parts.append((now - base) * F.ln(now / base))
    return counts.filter(total > 0).select("window", total.alias("n"), sum(parts, F.lit(0.0)).alias("psi"))


def watch(events: DataFrame, edges: Sequence[float], ranges: Ranges, frozen: Sequence[float], sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Starts a stream that hands each batch's drift to sink(drift, batch_id)."""
    counts = windowed(events, edges, ranges, **options)
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: sink(drift(df, frozen), k)).start()


# Streams run to their end ------------------------------------------------------------------------


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below the session's checkpoint folder, which only a local session may leave unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scoreloom-")
    return f"{found.rstrip('/')}/monitor/{uuid.uuid4().hex}"


def follow(events: DataFrame, edges: Sequence[float], ranges: Ranges, sink: str, checkpoint: str, **options) -> None:
    """Reads what a stream of events has that was not read before, and ends.

    Each batch's updated windows are written below sink under the batch's number, so a batch that is repeated after a
    failure replaces itself.
    """

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    counts = windowed(events, edges, ranges, **options)
    counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """(window, counts): the last state of each window that follow() wrote."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    return rows.groupBy("window").agg(F.max_by("counts", "batch").alias("counts"))


def replay(events: DataFrame, arrival: str, arrivals: int, edges: Sequence[float], ranges: Ranges, **options) -> DataFrame:
    """(window, counts) after events came in one lot after another, as their column arrival (0, 1, ...) says; what comes past the watermark is left out.

    Each lot is written as files of a folder, and the stream over it is started again from its checkpoint.
    """
    spark, folder = events.sparkSession, work_folder(events.sparkSession)
    lots = events.drop(arrival)
    for k in range(arrivals):
        events.filter(F.col(arrival) == k).drop(arrival).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(lots.schema).parquet(f"{folder}/in")
        follow(stream, edges, ranges, f"{folder}/out", f"{folder}/state", **options)
    return latest(spark, f"{folder}/out")
