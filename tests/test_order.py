"""Order-preserving keys, selection by leading bits, and running sums over ordered stretches."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.keys import double_of, leading, order_key
from scoreloom.operators import quantiles, scan

ODD = [0.0, -0.0, 1.0, 2.0, 4.0, 0.5, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 / 3, math.nextafter(1, 2), math.nextafter(1, 0), math.nextafter(8, 0), math.nextafter(1024, 0), 1e-310, 3.0e-320]


def bits_of(x: float) -> int:
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def doubles(rng, n):
    out = []
    while len(out) < n:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if x == x:
            out.append(x)
    return out


def test_keys_are_the_bits_of_doubles(spark):
    rng = random.Random(1)
    values = [*ODD, *(-x for x in ODD), *doubles(rng, 3000), *(rng.random() for _ in range(500)), *(2.0**k for k in range(-1074, 1024, 7)), *(math.nextafter(2.0**k, 0) for k in range(-1070, 1024, 7))]
    rows = spark.createDataFrame([(x,) for x in values] + [(None,), (math.nan,)], "x double").select("x", order_key(F.col("x")).alias("k"), leading(order_key(F.col("x")), 16).alias("top")).collect()
    assert [r["k"] for r in rows[: len(values)]] == [bits_of(x) for x in values]
    assert rows[-1]["k"] is None and rows[-2]["k"] is None
    assert all(double_of(r["k"]) == r["x"] for r in rows[: len(values)])
    in_order = sorted(rows[: len(values)], key=lambda r: r["x"])
    assert all(a["k"] <= b["k"] and a["top"] <= b["top"] for a, b in zip(in_order, in_order[1:]))


SHARES = [0, 0.001, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.999, 1]


def equal(a, b):
    return all(x == y or (x != x and y != y) for x, y in zip(a, b)) and len(a) == len(b)


@pytest.mark.parametrize("few", [0, 50, 10**6])
def test_selection_is_percentile_bit_for_bit(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(few)
    groups = {"random": doubles(rng, 700), "scores": [rng.random() for _ in range(2000)], "ties": [float(rng.randrange(4)) for _ in range(999)], "one": [7.25], "two": [1.0, 2.0], "same": [3.0] * 50, "ends": [-math.inf] * 3 + [math.inf] * 3 + [0.0, -0.0, 1.0], "close": [math.nextafter(1, 2), 1.0, math.nextafter(1, 0)] * 5}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("none", None), ("none", math.nan), ("ties", None), (None, 4.0), (None, 6.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    got = quantiles.quantiles_by(df, "x", SHARES, ["g"])
    known = df.filter("x is not null and not isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*[F.lit(float(q)) for q in SHARES])).alias("q"))
    want = {(r["g"],): r["q"] for r in known.collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert equal(got[g], want[g]), g
    whole = known.sparkSession.createDataFrame([(x,) for x in groups["scores"]], "x double")
    assert equal(quantiles.exact_quantiles(whole, "x", SHARES), whole.agg(F.percentile("x", F.array(*[F.lit(float(q)) for q in SHARES]))).first()[0])
    assert quantiles.exact_quantiles(whole.filter("false"), "x", SHARES) == []


def test_running_sums_in_order(spark):
    rng = random.Random(4)
    rows = []
    for g in ("a", "b", None):
        for x in {*(rng.random() for _ in range(300)), *(rng.gauss(0, 1e3) for _ in range(200)), *ODD[2:14], *(1 + k * 2.0**-52 for k in range(40))}:
            rows.append((g, x, rng.randrange(5), rng.randrange(3)))
    got = scan.ordered(spark.createDataFrame(rows, "g string, x double, b long, c long").filter("g is not null"), ["g"], "x", ["b", "c"]).collect()
    assert len(got) == sum(g is not None for g, *_ in rows)
    for r in got:
        own = [(x, b, c) for g, x, b, c in rows if g == r["g"]]
        assert r["before_b"] == sum(b for x, b, _ in own if x < r["x"]) and r["before_c"] == sum(c for x, _, c in own if x < r["x"])
        assert r["total_b"] == sum(b for _, b, _ in own)


def test_stretches_grow_with_the_values(spark):
    parts = lambda n: spark.range(n).select(F.countDistinct(leading(order_key(F.col("id") / n), scan.STRETCH))).first()[0]
    assert parts(200) > 150 and parts(5000) > 2000
