"""From Python ``re`` patterns to JVM regexes that match the same strings.

Python ``str`` patterns are Unicode aware; the JVM's short classes are not, and
its ``(?U)`` flag disagrees with Python on combining marks and on the four
information separators.  The short classes are therefore spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"

_AT_START = f"(?<!{WORD})"
_AT_END = f"(?!{WORD})"
_AT_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def jvm_regex(pattern: str, *, ignore_case: bool = False, edges: str = "") -> str:
    """Rewrite a Python pattern for the JVM.

    ``edges`` may state, for each ``\\b`` in turn, that it stands before ``(``
    or after ``)`` something that can only be a word character there; that
    boundary is then a single look-around.
    """
    known = {"(": _AT_START, ")": _AT_END}
    out, *rest = pattern.split(r"\b")
    for i, piece in enumerate(rest):
        out += known.get(edges[i : i + 1], _AT_EDGE) + piece
    out = out.replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE).replace("$", r"(?=\n?\z)")
    return ("(?iu)" if ignore_case else "") + out


# Letters that equal an ASCII letter when case is ignored, besides its other case.
_EXTRA_CASES = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def alternation(words: list[str]) -> str:
    """A case-insensitive group for a word list, branching on the first letter.

    Words with different first letters exclude each other, so grouping by
    letter keeps the outcome of trying the words in list order.  The look-ahead
    spares the engine a trial per word at every position of the text.
    """
    by_letter: dict[str, list[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], []).append(word[1:])
    first = "".join(x + x.upper() + _EXTRA_CASES.get(x, "") for x in by_letter)
    branches = [f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items()]
    return f"(?=[{first}])(?iu:{'|'.join(branches)})"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space on both sides."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def words_of(text: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{Nd}²³¹⁰⁴-⁹₀-₉]", "")
