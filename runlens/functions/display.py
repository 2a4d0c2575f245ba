"""Report values as a reader sees them: bands, clipped text, whole percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.scalars import pct1_half_up

MISSING = "—"

# Lower bounds (exclusive) of the bands, and the last band.
RATE_BANDS = [(20, "high"), (10, "medium")], "low"
BAR_BANDS = [(50, "red"), (25, "yellow"), (10, "orange")], "green"
# Lower bounds (inclusive) of a session's pass rate.
PASS_BANDS = [(90, "good"), (70, "fair")], "poor"
# Upper bounds (exclusive) of the heat levels after "none".
HEAT_BANDS = [(10, "low"), (20, "mild"), (35, "warm"), (50, "hot")], "severe"


def _band_above(value: Column, bands: tuple, inclusive: bool) -> Column:
    steps, label = bands[0], F.lit(bands[1])
    for bound, name in reversed(steps):
        reached = value >= bound if inclusive else value > bound
        label = F.when(reached, name).otherwise(label)
    return label


def rate_band(rate: Column) -> Column:
    """Band of an overall failure percentage."""
    return _band_above(rate, RATE_BANDS, inclusive=False)


def bar_band(pct: Column) -> Column:
    """Band of a table row's failure percentage."""
    return _band_above(pct, BAR_BANDS, inclusive=False)


def pass_band(pct: Column) -> Column:
    """Band of a session's pass percentage."""
    return _band_above(pct, PASS_BANDS, inclusive=True)


def heat_band(rate: Column) -> Column:
    """Band of a heatmap cell; an absent cell has none."""
    steps, label = HEAT_BANDS[0], F.lit(HEAT_BANDS[1])
    for bound, name in reversed(steps):
        label = F.when(rate < bound, name).otherwise(label)
    return F.when(rate.isNull(), None).when(rate == 0, "none").otherwise(label)


def clip(text: Column, chars: int) -> Column:
    """At most the first ``chars`` characters, a dash for missing or empty text."""
    return F.when(text.isNull() | (text == ""), MISSING).otherwise(
        F.substring(text, 1, chars)
    )


def session_label(session_id: Column) -> Column:
    return F.substring(session_id, 1, 30)


def device_label(device_id: Column) -> Column:
    return clip(device_id, 25)


def minute_label(moment: Column) -> Column:
    """A time to the minute."""
    return clip(F.replace(moment.cast("string"), F.lit("T"), F.lit(" ")), 16)


def day_label(day: Column) -> Column:
    """A day as month and day."""
    return F.date_format(day, "MM-dd")


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.when(whole > 0, whole.cast("double")) * F.lit(100.0)


def rate_text(part: Column, whole: Column) -> Column:
    """A percentage to one decimal, by its exact binary value; NULL for an empty whole."""
    return pct1_half_up(part, whole)


def whole_pct(part: Column, whole: Column) -> Column:
    """A percentage as a whole number; NULL for an empty whole."""
    return F.round(_share(part, whole)).cast("bigint")


def bar_pct(fail_count: Column, total: Column) -> Column:
    """Width of a table row's bar, at most 100."""
    return F.least(F.lit(100).cast("bigint"), whole_pct(fail_count, total))


def session_pct(passed: Column, total: Column) -> Column:
    """A session's pass percentage, 0 for an empty one."""
    return F.coalesce(whole_pct(passed, total), F.lit(0).cast("bigint"))


def issue_label(common_classification: Column) -> Column:
    return F.coalesce(F.nullif(common_classification, F.lit("")), F.lit("UNKNOWN"))


def text_label(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
