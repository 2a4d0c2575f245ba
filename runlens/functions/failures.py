"""Failure categories: the question put to a classifier, its reply, and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.scalars import actions_json, strip
from runlens.schema import CLASSES, PASSED

# The text of the question. The four fields are filled per failure.
PROMPT = """You are a test failure classifier. Given a mobile E2E test failure, classify it into exactly one category.

Categories:
- REAL_BUG: the app behavior is wrong (element missing, wrong UI state, crash, assertion failure)
- TIMEOUT_FLAKE: action timed out but the element typically appears eventually (race condition, slow render)
- DEVICE_FLAKE: device/emulator issue (connection lost, ANR dialog, memory pressure, "could not verify foreground")
- LOCATOR_FLAKE: element found but not visible/interactable, scrollIntoViewIfNeeded failed, stale element
- UNKNOWN: can't determine from the given information

Reply with ONLY the category name and a one-sentence reason separated by "|".
Example: "TIMEOUT_FLAKE|actionTimeout exceeded on fill, element appeared on retry"

---
Test: {test_name}
Platform: {platform}
Error: {error_message}
Last actions: {last_actions}
"""

# How much of an error the question quotes, and how much of an
# unreadable reply the reason quotes.
ERROR_CHARS = 2000
REPLY_CHARS = 200
UNREADABLE = "Could not parse: "

# Patterns of error text per category, in order of precedence.
RULES = [
    (r"timeout .*exceeded|timed out", "TIMEOUT_FLAKE", "an action or the test ran out of time"),
    (
        r"could not verify foreground|method not found|connection lost|\banr\b|memory pressure",
        "DEVICE_FLAKE",
        "the device or emulator failed",
    ),
    (
        r"not visible|not interactable|scrollintoviewifneeded|stale|detached|expected 1, but received 0",
        "LOCATOR_FLAKE",
        "the element could not be reached",
    ),
    (r"expecterror|assert|crash", "REAL_BUG", "the application did not behave as expected"),
]
NO_RULE = ("UNKNOWN", "no rule matches the error")


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def failure_prompt(
    test_name: Column,
    platform: Column,
    error: Column,
    actions: Column,
    error_chars: int | None = ERROR_CHARS,
) -> Column:
    """The question about a failure; it quotes ``error_chars`` of the error, None for all."""
    fields = {
        "{test_name}": F.coalesce(test_name, F.lit("")),
        "{platform}": F.coalesce(platform, F.lit("unknown")),
        "{error_message}": _head(F.coalesce(error, F.lit("")), error_chars),
        "{last_actions}": actions_json(actions),
    }
    parts, rest = [], PROMPT
    for mark, value in fields.items():
        text, rest = rest.split(mark)
        parts += [F.lit(text), value]
    return F.concat(*parts, F.lit(rest))


def parse_reply(reply: Column, reply_chars: int | None = REPLY_CHARS) -> Column:
    """``CATEGORY|reason`` as a struct of both; NULL fields without a reply.

    The reason for an unreadable reply quotes ``reply_chars`` of it, None for all.
    """
    text = strip(reply)
    bar = F.locate("|", text)
    category = F.upper(strip(F.substring(text, F.lit(1), bar - 1)))
    known = (bar > 0) & category.isin(CLASSES)
    return F.struct(
        F.when(known, category)
        .when(text.isNotNull(), "UNKNOWN")
        .alias("classification"),
        F.when(known, strip(F.substring(text, bar + 1, F.length(text))))
        .when(
            text.isNotNull(),
            F.concat(F.lit(UNREADABLE), _head(text, reply_chars)),
        )
        .alias("classification_reason"),
    )


def _alternatives() -> list[tuple[str, str, int]]:
    """(pattern, text it matches, place of its rule) of every alternative of the rules.

    What may follow at any distance is looked for from the first part, which alone is matched.
    """
    found = []
    for place, (pattern, _, _) in enumerate(RULES):
        for part in pattern.split("|"):
            first, gap, rest = part.partition(".*")
            found.append((f"{first}(?=.*{rest})" if gap else part, first.replace(r"\b", ""), place))
    return found


def rule_classify(error: Column) -> Column:
    """Category and reason by patterns in the whole error text, which is scanned once.

    Matches take no room, so that none hides another that begins inside it; of the rules
    found the first one counts.
    """
    text = F.lower(F.coalesce(error, F.lit("")))
    alternatives = _alternatives()
    pattern = "(?s)(?=(" + "|".join(p for p, _, _ in alternatives) + "))"
    places = F.create_map(*[F.lit(x) for _, match, place in alternatives for x in (match, place)])
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: places[m])
    place = F.coalesce(F.array_min(found), F.lit(len(RULES)))
    outcomes = [(name, why) for _, name, why in RULES] + [NO_RULE]
    return F.element_at(
        F.array(
            *[
                F.struct(F.lit(name).alias("classification"), F.lit(why).alias("classification_reason"))
                for name, why in outcomes
            ]
        ),
        place + 1,
    )


def merge_class(result: Column, found: Column, incoming: Column) -> Column:
    """A pass has no category; a failure takes the found one, else keeps its own.

    ``found`` and ``incoming`` are structs (classification,
    classification_reason); the reason follows the category chosen.
    """
    has_found = found["classification"].isNotNull()

    def pick(field: str) -> Column:
        chosen = F.when(has_found, found[field]).otherwise(incoming[field])
        return F.when(result == PASSED, None).otherwise(chosen).alias(field)

    return F.struct(pick("classification"), pick("classification_reason"))
