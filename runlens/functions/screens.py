"""Which screen of the application a test exercises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.scalars import any_of, first_present

# Screens and the words that name them, in order of precedence.
SCREEN_WORDS = {
    "alert": ["alerts", "alert", "dialog", "modal"],
    "animation": ["animation", "animate", "transition"],
    "calendar": ["calendar", "date", "picker"],
    "form": ["formcontrols", "form", "input", "textfield"],
    "gesture": ["gestures", "gesture", "swipe", "pinch", "pan"],
    "list": ["lists", "list", "scroll", "flatlist"],
    "login": ["login", "register", "signin", "auth", "validation"],
    "media": ["media", "image", "video", "photo"],
    "profile": ["profile", "edit", "save", "logout", "toggle"],
    "signature": ["signature", "draw", "canvas"],
    "home": ["home", "landing", "main"],
}
SEPARATOR = " - "


WORDS = "|".join(word for words in SCREEN_WORDS.values() for word in words)


def _named(word: Column) -> Column:
    """The screen a word names."""
    pairs = [(w, screen) for screen, words in SCREEN_WORDS.items() for w in words]
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), word)


def _mentioned(text: Column) -> Column:
    """First screen, in order, that has a word in the lower-case text."""
    screen = F.lit(None).cast("string")
    for name, words in reversed(SCREEN_WORDS.items()):
        screen = F.when(any_of(text, words), name).otherwise(screen)
    return screen


def screen_of(test_name: Column, actions: Column) -> Column:
    """The screen named by the title's prefix, the title, or an action.

    Alternatives of a pattern are tried in order, so the word a prefix starts
    with is found in one match.
    """
    prefix = F.when(
        F.contains(test_name, F.lit(SEPARATOR)),
        F.lower(F.substring_index(test_name, SEPARATOR, 1)),
    )
    first_word = F.regexp_extract(prefix, rf"(?U)^\s*({WORDS})", 1)
    only_word = F.regexp_extract(prefix, r"(?U)^\s*([a-z]+)\s*$", 1)
    lowered = F.transform(actions, F.lower)
    return F.coalesce(
        _named(first_word),
        F.nullif(only_word, F.lit("")),
        _mentioned(F.lower(test_name)),
        first_present(F.transform(lowered, _mentioned)),
        F.lit("unknown"),
    )
