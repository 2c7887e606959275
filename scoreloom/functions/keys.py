"""Doubles as whole numbers in the same order, so that ordered stretches of values are runs of leading bits."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a mantissa, the exponents' offset, and the least normal double.
MANTISSA, OFFSET, LEAST = 52, 1023, 2.0**-1022
BITS = 64


def order_key(value: Column) -> Column:
    """The bits of a double as a signed long: a < b just when the key of a is below that of b; 0 and -0 are one. NaN and null have none.

    No built-in function gives a double's bits. The exponent is found by a logarithm, put right by comparison where that was
    rounded, and powers of two are exact, so that the mantissa is what an exact division leaves.
    """

    x = value.cast("double")
    size = F.abs(x)
    rough = _rough(size)
    return _signed(x, _bits(size, _exponent(size, rough, _power(rough))))


def with_key(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with order_key(value) as a column, each step a column of its own; df has no rows whose value is null or NaN.

    As one expression the steps are written out again wherever they are used, so that logarithms and powers are taken
    several times for a row and the generated method is too long to be compiled. The key is marked as never null, as the
    test that joins make for it would be moved before the steps, with all of them written out in it.
    """
    x, size, rough, low, exponent = (f"{name}_{c}" for c in ("value", "size", "rough", "low", "exponent"))
    out = df.withColumn(x, value.cast("double")).withColumn(size, F.abs(x)).withColumn(rough, _rough(F.col(size))).withColumn(low, _power(F.col(rough)))
    out = out.withColumn(exponent, _exponent(F.col(size), F.col(rough), F.col(low)))
    return out.withColumn(name, _bits(F.col(size), F.col(exponent))).withColumn(name, F.coalesce(_signed(F.col(x), F.col(name)), F.lit(0).cast("long"))).drop(x, size, rough, low, exponent)


def _rough(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("double")


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def _exponent(size: Column, rough: Column, low: Column) -> Column:
    return F.when(size < low, rough - 1).when(size >= low * 2, rough + 1).otherwise(rough)


def _bits(size: Column, exponent: Column) -> Column:
    part = size / _power(exponent) - 1
    normal = F.shiftleft((exponent + OFFSET).cast("long"), MANTISSA) + (part * float(1 << MANTISSA)).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    infinite = F.lit((2 * OFFSET + 1) << MANTISSA).cast("long")
    return F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), infinite).when(size < LEAST, tiny).otherwise(normal)


def _signed(x: Column, bits: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def double_of(key: int) -> float:
    """The double whose key it is."""
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


def leading(key: Column, bits: int) -> Column:
    """The first bits of a key, in the same order."""
    return F.shiftright(key, BITS - bits)
