"""The band cube against scans of the rows, stored cubes, and the stream over events."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import bands, cube, validation
from scoreloom.plans.queries import QUERIES, RANGES, run_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    return run_of(spark, SF)


def same(left, right, keys):
    a, b = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (left, right))
    assert a.keys() == b.keys() and a
    for k in a:
        for c, x in a[k].items():
            y = b[k][c]
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-12), (k, c, x, y)


def test_everything_follows_from_the_cube(run):
    rows = run.banded.filter(F.col("sample_group").isin("train", "oot"))
    same(run.both_bands, bands.derived(bands.sums(rows, "sample_group", "band_order", "band"), "band_order", ["sample_group"]), ["sample_group", "band_order"])
    same(run.train_sums, bands.dense_bin_sums(run.binned.filter("sample_group = 'train'"), run.edges), ["bin_order"])
    same(run.monthly, validation.monthly(run.banded), ["sample_group", "application_month", "band_order"])
    same(run.psi, validation.psi(run.banded, run.band_edges), ["band_order"])


def test_one_scan_serves_every_report(run):
    for df in (run.psi, run.monthly, run.both_bands, run.curve, validation.compare(run.train_bands, run.train_bands, run.band_edges)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan and "LocalRelation" in plan


def test_months_are_merged_and_replaced(spark, run, tmp_path):
    path = f"{tmp_path}/cube"
    months = sorted({r[0] for r in run.cube.select("application_month").distinct().collect() if r[0]})
    early, late = months[: len(months) // 2], months[len(months) // 2 :]
    part = lambda which: cube.cube(run.binned.filter(F.col("application_month").isin(which)))
    rest = cube.cube(run.binned.filter(~F.coalesce(F.col("sample_group").isin("train", "oot"), F.lit(False))))
    half = cube.cube(run.binned.filter(F.col("application_month").isin(late) & (F.col("application_id") % 2 == 0)))
    for c in (part(early), rest, half, part(late), part(late)):
        cube.append(c, run.edges, path)
    stored = cube.read(spark, path, run.edges)
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cube.KEYS])
    same(stored.withColumn("k", key.cast("string")), run.cube.withColumn("k", key.cast("string")), ["k"])
    with pytest.raises(ValueError):
        cube.read(spark, path, (-math.inf, 0.5, math.inf))
    cube.append(half, (-math.inf, 0.5, math.inf), path)
    assert cube.read(spark, path, run.edges).count() == stored.count()


def test_parts_of_a_month_add_up(run):
    a, b = (cube.cube(run.binned.filter(F.col("application_id") % 2 == k)) for k in (0, 1))
    same(cube.bands(a.unionByName(b), RANGES, "sample_group"), cube.bands(run.cube, RANGES, "sample_group"), ["sample_group", "band_order"])


def test_events_past_the_watermark_are_left_out(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["day"]: r["n"] for r in QUERIES["event_stream_drift"](spark, sf).collect()}
    whole = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd")).count().collect()}
    late = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/events.parquet").filter("event_id % 10 = 0").groupBy(F.date_format("ts", "yyyy-MM-dd")).count().collect()}
    assert got.keys() == whole.keys()
    assert sum(got.values()) < sum(whole.values())
    # Only late ones are missing.
    assert all(whole[d] - late.get(d, 0) <= got[d] <= whole[d] for d in whole)
