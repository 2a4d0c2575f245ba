"""Column expressions over single runs and over report counts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.schema import API_STEP, PASSED

# Keywords that decide an action's kind, in order of precedence.
ACTION_KEYWORDS = [
    ("fill", ["fill"]),
    ("tap", ["tap", "click"]),
    ("swipe", ["swipe", "scroll"]),
    ("press", ["press"]),
]

# Upper bounds (exclusive, in ms) and labels of the duration bands.
DURATION_BANDS = [
    (5000, "0-5s"),
    (15000, "5-15s"),
    (30000, "15-30s"),
    (60000, "30-60s"),
    (120000, "60-120s"),
]
LAST_DURATION_BAND = "120s+"

# ISO-8601 text as it usually comes, and in every form that is read: day, clock,
# seconds, zone.
FULL_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
ISO_TIME = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?)?(?: *([Zz]|[+-]\d{2}:\d{2}))?$"
)


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words."""
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def first_present(array: Column) -> Column:
    """First element that is not NULL; NULL when there is none."""
    return F.get(F.filter(array, lambda x: x.isNotNull()), F.lit(0))


def _action_kind(text: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, words in reversed(ACTION_KEYWORDS):
        kind = F.when(any_of(text, words), name).otherwise(kind)
    return kind


def action_type(actions: Column) -> Column:
    """Kind of the latest action that has a known kind, else ``other``."""
    latest_first = F.transform(F.reverse(actions), F.lower)
    return F.coalesce(first_present(F.transform(latest_first, _action_kind)), F.lit("other"))


def annotation_value(annotations: Column, kind: str) -> Column:
    """Description of the first annotation of a kind, else the empty string."""
    matches = F.filter(annotations, lambda a: a["type"] == kind)
    return F.coalesce(F.get(matches, F.lit(0))["description"], F.lit(""))


def platform_fallback(platform: Column, project: Column) -> Column:
    """The annotated platform, else the project's name, else the empty string."""
    return F.coalesce(F.nullif(platform, F.lit("")), project, F.lit(""))


def utc_time(text: Column) -> Column:
    """ISO-8601 text as UTC wall-clock time; text without a zone is UTC already.

    The clock is counted from the epoch, not read off the session's time zone.
    """
    def part(group: int, default: str) -> Column:
        found = F.regexp_extract(text, ISO_TIME, group)
        return F.when(found == "", default).otherwise(found)

    spelled_out = F.concat(
        part(1, ""), F.lit("T"), part(2, "00:00"), part(3, ":00"), F.upper(part(4, "Z"))
    )
    full = F.when(text.rlike(FULL_TIME), text).when(text.rlike(ISO_TIME), spelled_out)
    micros = F.unix_micros(full.try_cast("timestamp")).cast("decimal(18,0)")
    seconds = (micros * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    none = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        none, none, none, seconds
    )


def run_day(text: Column) -> Column:
    """UTC calendar day of ISO-8601 text; NULL when it cannot be read."""
    return utc_time(text).cast("date")


def is_failed(result: Column) -> Column:
    """Every result but a pass is a failure; an unknown result is neither."""
    return result != PASSED


def fail_flag(result: Column) -> Column:
    return F.when(is_failed(result), 1).otherwise(0)


def pass_flag(result: Column) -> Column:
    return F.when(result == PASSED, 1).otherwise(0)


def is_present(dimension: Column) -> Column:
    """Neither NULL nor empty."""
    return dimension.isNotNull() & (dimension != "")


def is_api_step(category: Column) -> Column:
    return category == API_STEP


def duration_bucket(duration_ms: Column) -> Column:
    """Label of a duration's band; an unknown duration is in the last one."""
    band = F.lit(LAST_DURATION_BAND)
    for bound, label in reversed(DURATION_BANDS):
        band = F.when(duration_ms < bound, label).otherwise(band)
    return band


def duration_place(band: Column) -> Column:
    """The place of a band's label, shortest first."""
    labels = [label for _, label in DURATION_BANDS]
    return F.array_position(F.array(*map(F.lit, [*labels, LAST_DURATION_BAND])), band)


def class_label(classification: Column) -> Column:
    return F.coalesce(classification, F.lit("UNCLASSIFIED"))


def pct1(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, ties away from zero; NULL for an empty whole."""
    return F.when(
        whole != 0, F.round(part.cast("double") * F.lit(100.0) / whole.cast("double"), 1)
    )


def _tenths(x: Column, tie_up) -> Column:
    """A value >= 0 to one decimal, by its exact binary value.

    Ten times the value is formed as 8x + 2x, whose rounding error is recovered
    exactly, so a value that only looks like a tie is told apart from a real
    one. ``tie_up`` says of a tie's lower neighbour whether to go above it.
    """
    big, small = x * F.lit(8.0), x * F.lit(2.0)
    total = big + small
    kept = total - big
    error = (big - (total - kept)) + (small - kept)
    below = F.floor(total)
    rest = total - below
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & tie_up(below))))
    return (below + F.when(up, 1).otherwise(0)).cast("double") / F.lit(10.0)


def _percent(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.when(whole != 0, whole.cast("double")) * F.lit(100.0)


def pct1_half_even(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, exact ties to the even neighbour."""
    return _tenths(_percent(part, whole), lambda below: below % 2 == 1)


def pct1_half_up(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, exact ties upwards: as fixed-point text shows it."""
    return _tenths(_percent(part, whole), lambda below: F.lit(True))


def whole_seconds(total_ms: Column, n: Column) -> Column:
    """Mean of durations given as sum and count, in whole seconds."""
    mean = total_ms.cast("double") / F.when(n != 0, n.cast("double"))
    return F.round(mean / F.lit(1000.0)).cast("bigint")


def avg_seconds(duration_ms: Column) -> Column:
    """Aggregate: mean duration in whole seconds (exact integer sums)."""
    return whole_seconds(F.sum(duration_ms), F.count(duration_ms))


def date_range(first: Column, last: Column) -> Column:
    """``first to last``, the empty string when there is no day."""
    return F.when(
        first.isNotNull() & last.isNotNull(),
        F.concat(first.cast("string"), F.lit(" to "), last.cast("string")),
    ).otherwise("")


def actions_json(actions: Column) -> Column:
    """Actions as JSON text with a space after each comma; missing ones as ``[]``."""
    items = F.transform(
        F.coalesce(actions, F.array().cast("array<string>")), _json_string
    )
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _json_string(text: Column) -> Column:
    """A JSON string in ASCII: any other character is written as its UTF-16 units."""
    listed = F.to_json(F.array(text))
    plain = F.substring(listed, F.lit(2), F.length(listed) - 2)

    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(F.ascii(c) < 128, c).otherwise(F.regexp_replace(units, "(....)", r"\\u$1"))

    spelled = F.array_join(F.transform(F.split(plain, ""), escaped), "")
    return F.when(plain.rlike(r"[^\x00-\x7F]"), spelled).otherwise(plain)


def actions_from_json(text: Column) -> Column:
    return F.from_json(text, "array<string>")
