"""Personal data in texts: patterns propose spans, checksums confirm them, context scores them.

Spark expressions only. Each kind has a pattern; its leftmost non-overlapping matches are
found by splitting the text at them, so a match's place is the length of what stands
before it. A validator then drops matches, without trying shorter ones (but see iban):

    email  a name, @, and a domain with a dot
    ip     four numbers of at most 255
    card   16 to 19 digits that pass Luhn's test
    phone  + and 8 to 15 digits
    iban   a country's account number of 15 to 34 characters whose remainder by 97 is 1;
           the longest such run of whole words from a country and two digits on
    ssn    three, two and four digits, none of the groups zero

The first four are *base* kinds: what their validators confirm is always reported. Every
span has a score, the kind's own plus a bonus for each word nearby, before or after it,
that speaks for the kind; other kinds need ``LEAST`` to be reported. Places are code points, ends exclusive.
Null counts as an empty text. Every row is judged for itself; nothing is shuffled.

The patterns take runs of characters whole (possessive quantifiers) and start only where
a run starts, so long runs cost one pass. Matches are worked on with what stands right before and
behind them, in blocks, so a text of a hundred thousand matches costs a hundred thousand times one. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.expressions import bound, gathered

LEAST = 0.6
#: Characters before and after a span that are searched for context words, and what each found word adds.
NEAR = 40
BONUS = 0.2
IBAN_MOST = 34
#: Characters behind a match that an account number and its context may take, and the fewest a match has.
AHEAD, SHORTEST = 2 * IBAN_MOST + NEAR, 4


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test that texts with a match pass
    score: float
    words: tuple[str, ...] = field(default=())
    base: bool = True


_NAME = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@", 0.9, ("mail", "contact", "@")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]", 0.7, ("ip", "host", "server", "address")),
    # a maximal run of digits with single blanks or hyphens, of 16 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", 0.8, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, ("phone", "tel", "call", "mobile")),
    # the head of an account number only, so that one that fails hides none that starts inside it
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})", r"[A-Z]{2}[0-9]{2}", 0.7, ("iban", "account", "bank"), False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 0.45, ("ssn", "social security"), False),
)
BASE = tuple(k.name for k in KINDS if k.base)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters moved to the end and letters as 10 to 35."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    plain = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        letter = value >= 65
        return F.when(letter, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97)

    return F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.lit(0), add)


def _account(after: Column) -> Column:
    """The longest account number that a text begins with and that ends where a word ends; empty if none passes its test."""
    after = F.left(after, F.lit(2 * IBAN_MOST))  # with blanks between, and the next character
    run = F.regexp_extract(after, "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", 0)
    parts = F.transform(F.sequence(F.lit(15), F.greatest(F.length(run), F.lit(15))), lambda n: F.substr(after, F.lit(1), n + 1))
    # each prefix comes with the character after it, if there is one
    ends = F.transform(parts, lambda p: F.regexp_extract(p, "^([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})[^A-Za-z0-9]?$", 1))
    whole = F.filter(ends, lambda p: (p != "") & ~F.substr(after, F.length(p) + 1, F.lit(1)).rlike("[A-Za-z0-9]"))
    good = F.filter(F.array_distinct(whole), lambda p: _mod97(p) == 1)
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(""))


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern passes its test."""
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", _digits(match)),
        "phone": n.between(8, 15),
        "iban": match != "",
        "ssn": ~match.rlike("^000|-00-|0000$"),
    }[kind]


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _matches(text: Column, kind: Kind) -> Column:
    """Matches of a kind in order: array of (rest: what stands before it since the last one, match, next: what follows)."""

    def paired(found: Column) -> Column:
        pieces = F.flatten(F.zip_with(found["rest"], found["match"], lambda r, m: F.array(r, F.coalesce(m, F.lit("")))))
        heads = F.transform(pieces, lambda p: F.left(p, F.lit(AHEAD)))

        def with_next(heads: Column) -> Column:
            def pair(match: Column, i: Column) -> Column:
                following = F.slice(heads, 2 * i + 3, F.lit(2 * (AHEAD // SHORTEST + 1)))
                ahead = F.left(F.array_join(following, ""), F.lit(AHEAD))
                return F.struct(F.get(found["rest"], i).alias("rest"), match.alias("match"), ahead.alias("next"))

            return F.transform(found["match"], pair)

        return bound(heads, with_next)

    rest = F.split(text, kind.pattern, -1)
    match = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return bound(F.struct(rest.alias("rest"), match.alias("match")), paired)


def _found(text: Column, kind: Kind) -> Column:
    """All matches of a kind that pass its test: array of (kind, start, end, score)."""

    def step(state: dict[str, Column], pair: Column):
        start = state["at"] + F.length(pair["rest"])
        before = F.right(F.concat(state["tail"], pair["rest"]), F.lit(NEAR))
        match = _account(F.concat(pair["match"], pair["next"])) if kind.name == "iban" else pair["match"]
        end = start + F.length(match)
        beyond = F.length(match) - F.length(pair["match"])
        near = F.lower(F.concat_ws("\n", before, F.substr(pair["next"], beyond + 1, F.lit(NEAR))))
        score = F.lit(kind.score)
        for word in kind.words:
            score = score + F.when(F.contains(near, F.lit(word)), BONUS).otherwise(0.0)
        score = F.round(F.least(score, F.lit(1.0)), 2)
        good = (start >= state["until"]) & valid(kind.name, match)
        if not kind.base:
            good = good & (score >= LEAST)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        after = {
            "at": start + F.length(pair["match"]),
            "until": F.when(good, end).otherwise(state["until"]),
            "tail": F.right(F.concat(before, pair["match"]), F.lit(NEAR)),
        }
        return after, F.when(good, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    start = {"at": F.lit(0), "until": F.lit(0), "tail": F.lit("")}
    return F.when(text.rlike(kind.hint), gathered(_matches(text, kind), start, step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def personal_data(docs: DataFrame) -> DataFrame:
    """The documents with ``spans``: array of (kind, start, end, score), by kind and then by place.

    A column of that name is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("spans", F.concat(*[_found(text, k) for k in KINDS]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
