"""Report sections, in six sheets, and sinks for them."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators import bands, cube, funnel, policy, validation
from scoreloom.plans.pipeline import Run

log = logging.getLogger(__name__)

Sections = dict[str, dict[str, DataFrame]]


def _records(spark, rows: Iterable[tuple[str, str, object]]) -> DataFrame:
    """(section, metric, value, value_num): values as text, and as a number where they are one."""
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    return spark.createDataFrame([(s, m, None if v is None else str(v), number(v)) for s, m, v in rows], "section string, metric string, value string, value_num double")


def overview(run: Run) -> DataFrame:
    """Key figures of a run; a few one-row results come to the driver."""
    counts = run.completed.agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("score_mlt").isNull()).alias("without_score"),
        F.count_if(F.col("sample_group") == "train").alias("train"),
        F.count_if(F.col("sample_group") == "oot").alias("oot"),
        F.min("application_month").alias("first_month"),
        F.max("application_month").alias("last_month"),
    ).first()
    rows: list[tuple[str, str, object]] = [("sample", k, v) for k, v in counts.asDict().items()]
    rows += [("bins", "initial", len(run.edges) - 1), ("bins", "bands", len(run.ranges))]
    if not run.fixed:
        best = run.found.candidates[0]
        rows += [("search", k, getattr(best, k)) for k in ("hard_ok", "primary_inversions", "violations", "iv", "retention", "score")]
        rows.append(("search", "protected_cuts", sorted(run.found.protected)))
    rows += [("policy", k, v) for k, v in run.plan.first().asDict().items()]
    rows.append(("stability", "psi_total", (run.psi.first() or {"psi_total": None})["psi_total"]))
    for r in run.performance.collect():
        rows += [("performance", f"{r['sample_group']} {r['label']} {m}", r[m]) for m in ("auc", "ks")]
    return _records(run.applications.sparkSession, rows)


def flat(prefix: str, value: object) -> list[tuple[str, object]]:
    """Nested records as dotted names."""
    if hasattr(value, "__dataclass_fields__"):
        value = {k: getattr(value, k) for k in value.__dataclass_fields__}
    if isinstance(value, tuple) and value and all(isinstance(x, tuple) and len(x) == 2 for x in value):
        value = dict(value)
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flat(f"{prefix}.{k}" if prefix else str(k), v)]
    return [(prefix, value)]


def config_table(run: Run) -> DataFrame:
    rows = [("settings", k, v) for k, v in flat("", run.settings)]
    rows.append(("bands", "ranges", str(run.ranges)))
    return _records(run.applications.sparkSession, rows)


def metric_dictionary(spark) -> DataFrame:
    """What each figure means."""
    rows = [
        ("n", "rows with an application id", "count"),
        ("cnt_mature", "loans whose label is 0 or 1", "count"),
        ("cnt_bad", "loans whose label is 1", "count"),
        ("cnt_bad_rate", "bad over mature loans", "ratio"),
        ("cnt_bad_rate_ci_low, _high", "Wilson interval of the bad rate, z 1.96", "ratio"),
        ("amt_exposure", "principal of loans whose days past due are known", "amount"),
        ("amt_bad", "remaining principal of loans 30 or more days late", "amount"),
        ("amt_bad_rate", "bad amount over exposure", "ratio"),
        ("cum_...", "the same over this and all safer bands", "as the base figure"),
        ("woe", "log of the smoothed bad share over the smoothed good share", "number"),
        ("iv_component", "share difference times woe; their sum is the information value", "number"),
        ("ks_curve", "distance of bad and good shares gathered from the risky end", "ratio"),
        ("psi_component", "share difference times log share ratio, shares no lower than 1e-6", "number"),
        ("auc", "chance that a bad loan ranks above a good one, ties half", "ratio"),
        ("ks", "largest distance of the two score distributions, ties together", "ratio"),
        ("actual_...", "what history shows, by distinct applications", "count or ratio"),
        ("estimated_...", "what the thresholds would do", "count or ratio"),
    ]
    return spark.createDataFrame(rows, "metric string, meaning string, unit string")


def online_rules(spark) -> DataFrame:
    """How the thresholds are applied to live scores; policy.decide() does it."""
    rows = [
        (1, "a missing, NaN or infinite score is rejected"),
        (2, "intervals are open on the left and closed on the right"),
        (3, "a score at a threshold belongs to the milder decision"),
        (4, "scores are compared unrounded; if they must be rounded, only down"),
        (5, "bands' live shares are watched by the stability index"),
    ]
    return spark.createDataFrame(rows, "rule int, text string")


def sections(run: Run) -> Sections:
    """All tables by sheet and name."""
    spark, p = run.applications.sparkSession, run.settings.policy
    oot = cube.bands(run.cube.filter("sample_group = 'oot'"), run.ranges, ordering=run.ordering)
    out: Sections = {
        "01_overview": {"overview": overview(run)},
        "02_bins": {"process": bands.process_table(bands.derived(run.train_sums, "bin_order", ordering=run.ordering), run.ranges, run.settings.search)},
        "03_bands": {"bands": run.band_report()},
        "04_policy": {
            "actual_funnel": funnel.by_group(run.completed),
            "estimated_flow": run.flow,
            "threshold_selection": policy.selection(run.curve, run.plan, p),
            "plan": run.plan,
            "sensitivity": policy.sensitivity(run.curve, run.plan),
            "segments": policy.segments(run.scored, run.plan, ordering=run.ordering),
        },
        "05_validation": {
            "comparison": validation.compare(run.train_bands, oot, run.band_edges),
            "performance": run.performance,
            "performance_wide": validation.performance_wide(run.performance),
            "psi": run.psi,
            "monotonicity": validation.monotonicity(run.both_bands, ordering=run.ordering),
            "monthly_summary": validation.monthly_summary(run.monthly),
            "monthly": run.monthly,
        },
        "06_reference": {"config": config_table(run), "rules": online_rules(spark), "dictionary": metric_dictionary(spark)},
    }
    if not run.fixed:
        out["02_bins"] |= {"candidates": run.candidates(), "steps": run.steps()}
    return out


def write(tables: Sections, folder: str, kind: str = "parquet") -> list[str]:
    """Each section as a table below folder/sheet/name; kind is any writer's name."""
    written = []
    for sheet, parts in tables.items():
        for name, df in parts.items():
            path = f"{folder}/{sheet}/{name}"
            (df.write.mode("overwrite").option("header", True) if kind == "csv" else df.write.mode("overwrite")).format(kind).save(path)
            written.append(path)
            log.info("wrote %s", path)
    return written


def write_workbook(tables: Sections, path: str, most_rows: int = 10_000) -> bool:
    """One workbook with a sheet for each group of sections, if openpyxl is there; sections above most_rows fail."""
    try:
        from openpyxl import Workbook
        from openpyxl.styles import Font
    except ModuleNotFoundError:
        log.warning("openpyxl is not installed; no workbook")
        return False
    book = Workbook()
    book.remove(book.active)
    for sheet, parts in tables.items():
        page = book.create_sheet(sheet[:31])
        page.freeze_panes = "A2"
        for df in parts.values():
            rows = df.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{sheet}: more than {most_rows} rows")
            if rows:
                page.append(df.columns)
                for cell in page[page.max_row]:
                    cell.font = Font(bold=True)
                    is_share = any(x in str(cell.value) for x in ("rate", "pct", "share"))
                    page.column_dimensions[cell.column_letter].width = min(42, max(10, len(str(cell.value)) + 2))
                    cell.number_format = "0.00%" if is_share else "General"
                for r in rows:
                    page.append([None if isinstance(v, float) and v != v else (str(v) if isinstance(v, (list, dict)) else v) for v in r])
                page.append([])
    book.save(path)
    return True
