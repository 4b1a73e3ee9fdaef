"""Detection rules: which strings count as which entity, and how sure we are."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.functions.regex import digits_of, jvm_regex
from spanveil.functions.spans import find_ranked


# Cheap conditions on a text, shared by rules.  Each is looked at once per text.
GATES: dict[str, Callable[[Column], Column]] = {
    "at": lambda text: text.contains("@"),
    "plus": lambda text: text.contains("+"),
    "dash": lambda text: text.contains("-"),
    "underscore": lambda text: text.contains("_"),
    "digits": lambda text: text.rlike(r"\p{Nd}{4}"),
    "digit": lambda text: text.rlike(r"\p{Nd}"),
    "dot": lambda text: text.contains("."),
    "dotted": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "zero": lambda text: text.contains("0"),
    "addr": lambda text: text.rlike("(?i)addr"),
}


@dataclass(frozen=True)
class Pattern:
    """A JVM regex that never matches an empty string.

    ``needs`` names the gate that every text with a match passes.
    """

    regex: str
    needs: str | None = None


@dataclass(frozen=True)
class Rule:
    """One entity type found by patterns.

    ``rank`` orders rules for ties, and rules of equal rank go in the order of
    the list.  ``keep`` is a further test of a match and ``mask`` hides a value
    (else the default mask of the entity type is used).  Patterns of a rule that
    match at the same offsets count once.
    """

    entity_type: str
    rank: int
    confidence: float
    patterns: tuple[Pattern, ...]
    keep: Callable[[Column], Column] | None = None
    mask: Callable[[Column], Column] | None = None


def gate(
    text: Column, needs: str | None, gates: Mapping[str, Column] | None = None
) -> Column | None:
    """The condition for a gate name, taken from ``gates`` if it is there."""
    if needs is None:
        return None
    return gates[needs] if gates and needs in gates else GATES[needs](text)


# Rules of one rank that a list may hold.
_PER_RANK = 1000


def order_number(rank: int, place: int = 0) -> int:
    """What spans are ordered by: the rank, then the place in the list, from 1.

    It tells rules apart, also those of equal rank; place 0 is of what is found
    without a rule, addresses and the spans of a model.
    """
    return rank * _PER_RANK + place


def check_rules(rules: Sequence[Rule]) -> None:
    """Refuse lists that would give wrong spans."""
    if len(set(rules)) < len(rules):
        raise ValueError("a rule is listed twice")
    if len(rules) >= _PER_RANK:
        raise ValueError(f"at most {_PER_RANK - 1} rules")
    for regex in {p.regex for r in rules for p in r.patterns} - _BUILT_IN:
        if _matches_nothing(regex):
            raise ValueError(f"the pattern {regex!r} matches an empty text")


def _matches_nothing(regex: str) -> bool:
    """Whether a JVM regex matches the empty text; asked of the JVM, without a job."""
    session = SparkSession.getActiveSession()
    if session is None:
        return False
    pattern = session.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
    return bool(pattern.matcher("").find())


def rule_spans(
    text: Column, rules: Sequence[Rule], gates: Mapping[str, Column] | None = None
) -> Column:
    """``array<RANKED>`` of all rules, in order of rank; repeats are still in."""
    check_rules(rules)
    numbered = [(order_number(r.rank, i), r) for i, r in enumerate(rules, 1)]
    numbered.sort(key=lambda pair: pair[0])
    searches = [
        (gate(text, pattern.needs, gates), pattern.regex, number, r.entity_type, r.confidence)
        for number, r in numbered
        for pattern in r.patterns
    ]
    found = find_ranked(text, searches)
    tests = [(number, r) for number, r in numbered if r.keep is not None]
    if not tests:
        return found

    def kept(span: Column) -> Column:
        test = F.when(F.lit(False), False)
        for number, r in tests:
            test = test.when(span["rank"] == number, r.keep(span["text"]))
        return test.otherwise(True)

    return F.filter(found, kept)


# Shorter runs are tried from each of their word edges.
_LONG_RUN = 64


def _before_at(pattern: str, ignore_case: bool = False) -> Pattern:
    r"""A pattern ``\b[...]+@...`` that is tried once in a long run of ``[...]``.

    Whether it matches from an edge in a run depends on what follows the run
    only, so if it fails from the first edge it fails from all.  A long run is
    then matched as a whole, to go on behind it, and is no hit: it has no "@".
    """
    letters, rest = pattern.removeprefix(r"\b").split("+@", 1)
    once = rf"\b(?:{letters}++@{rest}|{letters}{{{_LONG_RUN},}}+)"
    return Pattern(jvm_regex(once, ignore_case=ignore_case), "at")


def _has_at(match: Column) -> Column:
    return match.contains("@")


def _is_upi(match: Column) -> Column:
    lowered = F.lower(match)
    test = lowered.contains(V.UPI_HANDLES[0])
    for handle in V.UPI_HANDLES[1:]:
        test = test | lowered.contains(handle)
    return test


def _starts(first: str, regex: str) -> str:
    """Try a match only where ``first`` fits; look-behinds are slow to fail."""
    return f"(?={first})" + regex


def _digits_first(pattern: str, edges: str = "()", ignore_case: bool = False) -> Pattern:
    regex = jvm_regex(pattern, edges=edges, ignore_case=ignore_case)
    return Pattern(_starts(r"\p{Nd}", regex), "digits")


def _any_case(pattern: str, needs: str) -> Pattern:
    return Pattern(jvm_regex(pattern, edges="()", ignore_case=True), needs)


STRUCTURED_RULES = (
    Rule("EMAIL", 1, 0.95, (_before_at(V.EMAIL),), keep=_has_at),
    Rule(
        "PHONE",
        2,
        0.90,
        (
            Pattern(_starts("[+0-9]", jvm_regex(V.PHONE_INDIAN_MOBILE, edges=")")), "digits"),
            Pattern(jvm_regex(V.PHONE_INDIAN_SPACED), "plus"),
            Pattern(jvm_regex(V.PHONE_INTERNATIONAL), "plus"),
        ),
    ),
    Rule(
        "AADHAAR",
        3,
        0.98,
        (_digits_first(V.AADHAAR),),
        keep=lambda m: F.length(digits_of(m)) == 12,
    ),
    Rule(
        "PAN",
        4,
        0.98,
        (Pattern(_starts("[A-Z]{5}[0-9]", jvm_regex(V.PAN, edges="()")), "digits"),),
    ),
    Rule(
        "IP_ADDRESS",
        5,
        0.95,
        (Pattern(_starts("[0-9]", jvm_regex(V.IP_ADDRESS, edges="()")), "dotted"),),
    ),
    Rule(
        "CREDIT_CARD",
        6,
        0.85,
        (_digits_first(V.CREDIT_CARD),),
        keep=lambda m: F.length(digits_of(m)).between(13, 19),
    ),
    Rule(
        "DOB",
        7,
        0.80,
        (
            _digits_first(V.DATE_DAY_FIRST),
            _digits_first(V.DATE_YEAR_FIRST),
            _digits_first(V.DATE_MONTH_NAME, ignore_case=True),
        ),
    ),
    Rule(
        "PASSPORT",
        8,
        0.90,
        (Pattern(_starts(r"[A-Z]\p{Nd}", jvm_regex(V.PASSPORT, edges="()")), "digits"),),
    ),
    Rule("BANK_ACCOUNT", 9, 0.85, (_digits_first(V.BANK_ACCOUNT),)),
    Rule("IFSC", 10, 0.95, (Pattern(_starts("[A-Z]{4}0", jvm_regex(V.IFSC, edges="()")), "zero"),)),
    Rule("UPI", 11, 0.90, (_before_at(V.UPI),), keep=_is_upi),
    Rule("DEVICE_ID", 12, 0.95, (_any_case(V.DEVICE_ID, "dash"),)),
    Rule("FINGERPRINT", 13, 0.98, (_any_case(V.FINGERPRINT, "underscore"),)),
    Rule("FACE_TEMPLATE", 14, 0.98, (_any_case(V.FACE_TEMPLATE, "underscore"),)),
)

ADDRESS_RANK = 15
ADDRESS_CONFIDENCE = 0.75
MODEL_RANK = 100

# The basic profile: own names, certain about everything, overlaps stay.
BASIC_RULES = (
    Rule("email", 1, 1.0, (_before_at(V.EMAIL, ignore_case=True),), keep=_has_at),
    Rule("phone", 2, 1.0, (Pattern(_starts("[+0-9]", jvm_regex(V.BASIC_PHONE)), "digits"),)),
    Rule("aadhaar", 3, 1.0, (_digits_first(V.BASIC_AADHAAR, edges="()()"),)),
    Rule("pan", 4, 1.0, (_any_case(V.PAN, "digits"),)),
    Rule("ip", 5, 1.0, (Pattern(_starts("[0-9]", jvm_regex(V.BASIC_IP, edges="()")), "dot"),)),
    Rule("credit_card", 6, 1.0, (_digits_first(V.CREDIT_CARD),)),
)

_BUILT_IN = frozenset(p.regex for r in STRUCTURED_RULES + BASIC_RULES for p in r.patterns)


def rule(entity_type: str) -> Rule:
    """A built-in rule by entity type; lower-case names are the basic profile."""
    for candidate in STRUCTURED_RULES + BASIC_RULES:
        if candidate.entity_type == entity_type:
            return candidate
    raise KeyError(entity_type)
