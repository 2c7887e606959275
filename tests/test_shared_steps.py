"""Steps that several reports share: keys made once for a row, flags counted in one shuffle, edges from the safe end."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.columns import distinct_flags
from scoreloom.functions.keys import order_key, with_key
from scoreloom.operators import scan, validation
from scoreloom.plans.pipeline import Run
from scoreloom.plans.queries import SETTINGS


@pytest.mark.parametrize("n", [91, 101, 181])
def test_edges_of_either_end_are_the_same_scores(spark, n):
    # With these sizes a share times the rows is whole from one end and just beside it from the other.
    rng = random.Random(n)
    df = spark.createDataFrame([("4.Funded", "2000-01", rng.random()) for _ in range(n)], "application_status string, application_month string, score_mlt double")
    up = Run(df, SETTINGS).edges
    down = Run(df.withColumn("score_mlt", -F.col("score_mlt")), replace(SETTINGS, search=replace(SETTINGS.search, high_is_bad=False))).edges
    assert down == tuple(-x for x in reversed(up))


def test_a_key_is_made_once_for_a_row(spark):
    df = spark.createDataFrame([(1.5, 1), (-0.25, 2), (0.0, 1)], "x double, n long")
    made = with_key(df, F.col("x"), "k").select("k", order_key(F.col("x")).alias("want"))
    assert all(r["k"] == r["want"] for r in made.collect())
    plan = scan.ordered(df, [], "x", ["n"])._jdf.queryExecution().optimizedPlan().toString().lower()
    # The values are read for the stretches, for the sums over them and for the rows.
    assert 0 < plan.count("log2(") <= 3


def test_flags_are_counted_by_distinct_value(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(20), rng.getrandbits(70).to_bytes(9, "big")) for _ in range(200)]
    flags = {f"f{k}": [b[k // 8] >> k % 8 & 1 for _, _, b in rows] for k in range(70)}
    df = spark.createDataFrame([(g, e, [v[i] if v[i] or i % 7 else None for v in flags.values()]) for i, (g, e, _) in enumerate(rows)], "g int, e int, f array<int>")
    got = distinct_flags(df, ["g"], "e", {n: F.col("f")[k] == 1 for k, n in enumerate(flags)}).collect()
    assert len(got) == 3
    for r in got:
        for n, v in flags.items():
            assert r[n] == len({e for i, (g, e, _) in enumerate(rows) if g == r["g"] and v[i]})


def test_labels_share_one_histogram(spark):
    df = spark.createDataFrame([("train", 0.5, 1, 0), ("train", 0.25, 0, None), ("oot", 0.5, None, None)], "sample_group string, score_mlt double, duedate_1m_30 int, duedate_3m_30 int")
    grid = validation.auc_ks(df)
    got = {(r["sample_group"], r["label"]): (r["n"], r["auc"], r["ks"]) for r in grid.collect()}
    assert got == {("train", "duedate_1m_30"): (2, 1.0, 1.0), ("train", "duedate_3m_30"): (1, None, None), ("oot", "duedate_1m_30"): (0, None, None), ("oot", "duedate_3m_30"): (0, None, None)}
    assert "explode" not in grid._jdf.queryExecution().optimizedPlan().toString().lower()
