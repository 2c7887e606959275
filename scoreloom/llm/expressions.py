"""Native array expressions that the DataFrame-only operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.llm.common import SPACE

BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text without null; empty if it has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def count_of(text: Column, others: str) -> Column:
    """Code points that are left when runs of `others` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def running_starts(sizes: Column) -> Column:
    """For each element the sum of those before it, in blocks so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def body(s: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK)))
        )
        tops = F.aggregate(
            blocks,
            F.array(F.lit(0).cast("long")),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        )
        return let(
            tops,
            lambda t: F.transform(
                s,
                lambda _, k: F.get(t, F.floor(k / BLOCK).cast("int")) + total(F.slice(s, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK)),
            ),
        )

    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(let(sizes, body))


def matches(text: Column, pattern: str, kind: str, groups: tuple[int, ...] = ()) -> Column:
    """array<struct<start,end,kind,text[,g1..]>> of leftmost non-overlapping matches, in code points.

    The text is cut at the matches; the lengths of cuts and matches give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]

    def body(cuts: Column, m: Column, gs: list[Column]) -> Column:
        steps = F.transform(m, lambda x, k: (F.length(F.get(cuts, k)) + F.length(x)).cast("long"))
        return let(
            running_starts(steps),
            lambda at: F.transform(
                m,
                lambda x, k: F.struct(
                    (F.get(at, k) + F.length(F.get(cuts, k))).alias("start"),
                    (F.get(at, k) + F.length(F.get(cuts, k)) + F.length(x)).alias("end"),
                    F.lit(kind).alias("kind"),
                    x.alias("text"),
                    *[F.get(g, k).alias(f"g{n}") for n, g in zip(groups, gs)],
                ),
            ),
        )

    if not groups:
        return let(F.split(text, pattern, -1), lambda c: let(found, lambda m: body(c, m, [])))
    return let(F.split(text, pattern, -1), lambda c: let(found, lambda m: let(inner[0], lambda g: body(c, m, [g]))))


#: DuckDB has no crc32: its 256 table entries from the polynomial, and the unsigned value of a text of ASCII characters.
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_entries"
CRC32_SQL = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all({0}, '.'), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(crc_entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
