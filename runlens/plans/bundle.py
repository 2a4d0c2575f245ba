"""All reports of one table, and reports as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import duration_place
from runlens.operators.measures import ROLLUPS
from runlens.plans.reports import REPORTS, latest_session_tests
from runlens.plans.rollups import days_of, held_days, pick, read_cells, refresh_rollups
from runlens.plans.rollups import rolled as _rollups
from runlens.session import new_folder, staging

__all__ = ["refresh_rollups", "report_bundle", "report_json", "reports"]

# The rollup a report is read off, where not the daily one.
ROLLUP_OF = {
    "top_flakes": "test",
    "devices": "device",
    "sessions": "session",
    "latest_session": "session",
}
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def report_json(report: DataFrame) -> DataFrame:
    """One JSON text per report row, with its NULLs."""
    return report.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("payload"))


def reports(runs: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Every report, read off the rollups in the folder.

    The runs themselves are read for the newest session only, and of these only
    the days it spans. Sessions are looked for from the newest day back.
    """
    spark = runs.sparkSession
    held = held_days(spark, folder)
    cells, days = read_cells(spark, folder, held), days_of(held)
    rolled = {name: pick(cells, name, True) for name in ROLLUPS}
    made = {
        name: report(rolled[ROLLUP_OF.get(name, "daily")], **({"days": days} if "session" in name else {}))
        for name, report in REPORTS.items()
    }
    made["latest_session_tests"] = latest_session_tests(runs, rolled["session"], days)
    return made


# Sort keys of reports in long form: all ascend, and the columns are alike for every report.

LAST = 2**62


def _ratio() -> Column:
    return -(F.col("fail_count").cast("double") / F.col("total"))


def _day(name: str) -> Column:
    """Days as numbers, no day first."""
    return F.coalesce(F.unix_date(name).cast("bigint"), F.lit(-LAST))


def _since(name: str) -> Column:
    """Moments as numbers, none first."""
    return F.coalesce(F.unix_micros(F.col(name).cast("timestamp")), F.lit(-LAST))


def _first(name: str) -> Column:
    """Texts, NULL first."""
    return F.coalesce(F.concat(F.lit("1"), F.col(name)), F.lit("0"))


def _last(name: str) -> Column:
    """Texts, NULL last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(name)), F.lit("1"))


KEYS = {
    "flake_rate": lambda: {"n1": _day("day")},
    "breakdown": lambda: {"n1": -F.col("count"), "s1": _first("classification")},
    "heatmap": lambda: {"n1": _day("day"), "s1": _first("screen")},
    "top_flakes": lambda: {"ratio": _ratio(), "n1": -F.col("total"), "s1": _last("test_name"), "s2": _last("platform")},
    "devices": lambda: {"ratio": _ratio(), "n1": -F.col("total"), "s1": _last("device_id")},
    "by_action": lambda: {"ratio": -F.col("rate"), "s1": _first("action_type")},
    "by_platform": lambda: {"ratio": -F.col("fail_rate"), "s1": _first("platform")},
    "volume": lambda: {"n1": _day("day")},
    "duration_dist": lambda: {"n1": duration_place(F.col("bucket"))},
    "class_trend": lambda: {"n1": _day("day"), "s1": _first("classification")},
    "sessions": lambda: {"n1": F.coalesce(-F.unix_micros(F.col("last_run").cast("timestamp")), F.lit(LAST)), "s1": _first("session_id")},
    "latest_session_tests": lambda: {"n1": _since("run_at"), "n2": F.col("load_id"), "n3": F.col("id")},
}
KEY_TYPES = {"ratio": "double", "n1": "bigint", "n2": "bigint", "n3": "bigint", "s1": "string", "s2": "string"}


def _long(name: str, report: DataFrame) -> DataFrame:
    """A report's rows as (report, its sort key, payload)."""
    keys = {k: c for k, c in KEYS.get(name, dict)().items() if k != "n2" or "load_id" in report.columns}
    key = [keys.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in KEY_TYPES.items()]
    payload = F.to_json(F.struct(*report.columns), JSON_OPTIONS).alias("payload")
    return report.select(F.lit(name).alias("report"), *key, payload)


def report_bundle(runs: DataFrame, folder: str | None = None, out: str | None = None) -> DataFrame:
    """All reports as rows of (report, position, payload), written to ``out``, by default a new folder.

    ``position`` ascends in a report's order. The reports are read off the rollups
    in a folder; without one, off rollups made for this use and removed at its end. Each rollup is read
    once and kept in memory for its reports, whose rows are ordered together by one exchange.
    """
    spark = runs.sparkSession
    out = out or new_folder(spark, "bundle")
    with staging(spark, "rollups") as staged:
        if folder is None:
            cells = _rollups(runs, by_day=False)
            cells.write.partitionBy("rollup").parquet(staged)
            cells, days = spark.read.schema(cells.schema).parquet(staged), None
        else:
            held = held_days(spark, folder)
            cells, days = read_cells(spark, folder, held), days_of(held)
        kept = {name: pick(cells, name, folder is not None).persist() for name in ROLLUPS}
        try:
            made = {}
            for name, report in REPORTS.items():
                of = kept[ROLLUP_OF.get(name, "daily")]
                if "session" in name:
                    made[name] = report(of, days=days)
                else:
                    made[name] = report(of, **({} if name in ("stats", "flake_rate", "top_flakes") else {"sort": False}))
            made["latest_session_tests"] = latest_session_tests(runs, kept["session"], days, sort=False)
            rows = reduce(DataFrame.unionAll, [_long(name, df) for name, df in made.items()])
            order = ["report", *KEY_TYPES]
            ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
            placed = ordered.select("report", F.monotonically_increasing_id().alias("position"), "payload")
            placed.write.parquet(out)
        finally:
            for df in kept.values():
                df.unpersist()
    return spark.read.schema(placed.schema).parquet(out)
