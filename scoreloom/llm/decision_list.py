"""Quality rules: a learned decision list over text measures, as ordered Spark conditions.

Sequential covering: a rule grows by the threshold test of greatest information gain on two thirds
of the labelled documents, is pruned on the other third, and takes away the documents that it
covers; the next rule starts on what is left. All counting is Spark aggregation over a table of
binned measures; the driver sees only counts by measure and bin.

Defined cases: a null or empty text has no words and so fails the base rules; a document without
a label is judged, not learned from; a document labelled twice counts once, by its lowest label;
with no usable labels the list is empty and only the base rules reject; repeated rows, null doc_ids
and empty tables pass through row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, store
from scoreloom.llm.expressions import BLANKS, count_of, let, words

#: Threshold candidates of a measure (quantiles of the labelled documents).
CUTS = 24
MAX_RULES = 10
MAX_TESTS = 4
#: A rule must reject rightly at least so often among pruning documents, and so many of both parts.
PRECISION = 0.9
SUPPORT = 10

#: Measures that rules may test, from the counted columns.
MEASURES = (
    "n_words",
    "chars_per_word",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "shout_per_word",
    "digit_share",
    "distinct_share",
)


@dataclass(frozen=True)
class Test:
    measure: str
    cut: float
    above: bool

    def on(self, value: Column) -> Column:
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Test, ...]


def _repeated(w: Column) -> Column:
    """Words that lie in a five-word window found twice or more."""
    at = lambda i: F.sequence(F.lit(0), F.size(w) - 5)
    hashes = F.transform(at(0), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

    def exact(_: Column) -> Column:
        windows = F.array_sort(
            F.transform(at(0), lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(5)]).alias("s"), i.alias("i")))
        )
        starts = let(
            windows,
            lambda v: F.transform(
                v,
                lambda x, k: F.when(
                    F.coalesce(F.get(v, k - 1)["s"] == x["s"], F.lit(False)) | F.coalesce(F.get(v, k + 1)["s"] == x["s"], F.lit(False)), x["i"]
                ).otherwise(-1),
            ),
        )
        ordered = F.array_sort(F.filter(starts, lambda x: x >= 0))
        return let(
            ordered,
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(s, k + 1), x + 5) - x)), F.lit(0), lambda a, b: a + b
            ),
        )

    return F.when(F.size(w) < 6, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))
    )


def counts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and what is counted in each whole text; with carry the whole row too, as `row`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return (
        docs.select(F.col("doc_id").cast("long"), text.alias("text"), *([F.struct(*docs.columns).alias("row")] if carry else []))
        .withColumn("words", words(F.col("text")))
        .withColumn("lines", lines)
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.concat_ws("", F.col("words"))).cast("long").alias("word_chars"),
            count_of(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            let(F.col("words"), _repeated).cast("long").alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            count_of(F.col("text"), r"[^\p{Lu}]+").alias("n_upper"),
            count_of(F.col("text"), r"[^!?]+").alias("n_shout"),
            count_of(F.col("text"), r"[^0-9]+").alias("n_digits"),
            F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
            *(["row"] if carry else []),
        )
    )


def measured(counted: DataFrame) -> DataFrame:
    """Adds MEASURES as doubles, 0 where a text has no words or lines."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.withColumns(
        {
            "chars_per_word": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper", "word_chars"),
            "shout_per_word": share("n_shout", "n_words"),
            "digit_share": share("n_digits", "word_chars"),
            "distinct_share": share("n_distinct", "n_words"),
        }
    )


def _covered(rule: Rule, bins: dict[str, list[float]]) -> Column:
    """A rule over bin columns; bin b of a measure holds values above b of its cuts."""
    out = F.lit(True)
    for t in rule:
        k = bins[t.measure].index(t.cut) + 1
        out = out & ((F.col(t.measure) >= k) if t.above else (F.col(t.measure) < k))
    return out


def learn(labelled: DataFrame) -> list[Rule]:
    """An ordered list of rules for bad = 1; labelled has MEASURES, bad (0 or 1) and doc_id."""
    picked = labelled.agg(*[F.percentile_approx(m, [k / CUTS for k in range(1, CUTS)], 10_000).alias(m) for m in MEASURES]).first()
    bins = {m: sorted(set(picked[m] or [])) for m in MEASURES}
    bins = {m: c for m, c in bins.items() if c}
    if not bins:
        return []
    to_bin = lambda m: sum((F.when(F.col(m) > c, 1).otherwise(0) for c in bins[m]), F.lit(0))
    grown = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(3)) < 2
    cells = store(
        labelled.select(*[to_bin(m).alias(m) for m in bins], grown.alias("grow"), F.col("bad"))
        .groupBy(*bins, "grow", "bad")
        .agg(F.count(F.lit(1)).alias("n")),
        "cells",
    )
    rules: list[Rule] = []
    left = F.lit(True)

    def tally(rule: Rule) -> dict[bool, tuple[int, int]]:
        """(bad, good) that the rule covers, of growing (True) and pruning documents."""
        rows = cells.filter(left & _covered(rule, bins)).groupBy("grow").agg(
            F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("q")
        )
        found = {r["grow"]: (r["p"], r["q"]) for r in rows.collect()}
        return {side: found.get(side, (0, 0)) for side in (True, False)}

    def grow() -> Rule:
        rule: Rule = ()
        while len(rule) < MAX_TESTS:
            by_bin = (
                cells.filter(F.col("grow") & left & _covered(rule, bins))
                .select("bad", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("b")) for m in bins])).alias("x"))
                .groupBy("x.m", "x.b")
                .agg(F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("q"))
            )
            table: dict[str, dict[int, tuple[int, int]]] = {m: {} for m in bins}
            for r in by_bin.collect():
                table[r["m"]][r["b"]] = (r["p"], r["q"])
            p0, q0 = (sum(x[k] for x in next(iter(table.values())).values()) for k in (0, 1))
            if not p0 or not q0:
                break
            best, gain = None, 0.0
            for m in MEASURES:
                for k, cut in enumerate(bins.get(m, []), 1):
                    above = [sum(x[i] for b, x in table[m].items() if b >= k) for i in (0, 1)]
                    for is_above, (p, q) in ((True, above), (False, (p0 - above[0], q0 - above[1]))):
                        if p >= SUPPORT:
                            g = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + q0)))
                            if g > gain + 1e-9:
                                best, gain = Test(m, cut, is_above), g
            if best is None:
                break
            rule += (best,)
        return rule

    while len(rules) < MAX_RULES:
        rule = grow()
        if not rule:
            break
        tried = [(tally(rule[:k]), rule[:k]) for k in range(1, len(rule) + 1)]
        worth = lambda x: (x[0][False][0] - x[0][False][1]) / max(1, sum(x[0][False]))
        seen, rule = max(tried, key=lambda x: (worth(x), -len(x[1])))
        if any(p < SUPPORT * (1 if side else 0.3) or p < PRECISION * (p + q) for side, (p, q) in seen.items()):
            break
        rules.append(rule)
        left = left & ~_covered(rule, bins)
    discard(cells)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, from 1, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for t in rule:
            test = test & t.on(F.col(t.measure))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """Counts, measures, base_failed, the rule that rejects (0: none) and kept, for every row of docs."""
    values = store(measured(counts(docs, carry)), "measures")
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality")).filter("doc_id is not null and quality in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rules = learn(values.select("doc_id", *MEASURES).join(marks, "doc_id").withColumn("bad", 1 - F.col("quality")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return values.withColumns({"base_failed": failed, "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return judge(docs, labels, carry=True).filter("kept").select("row.*")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
