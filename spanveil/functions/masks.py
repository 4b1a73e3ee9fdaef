"""Replacements for one value: mask, redact or tokenize."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.fixed_values import MODES
from spanveil.functions.regex import digits_of, words_of
from spanveil.functions.tokens import stable_token


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def _from(text: Column, start: int | Column) -> Column:
    return text.substr(F.lit(start) if isinstance(start, int) else start, F.length(text))


def _hide_all_but(text: Column, first: int = 0, last: int = 0) -> Column:
    """Star the middle, keep both ends; star everything in a shorter text."""
    n = F.length(text)
    kept = F.concat(
        F.left(text, F.lit(first)), stars(n - first - last), F.right(text, F.lit(last))
    )
    return F.when(n >= first + last, kept).otherwise(stars(n))


def _local_and_domain(text: Column) -> tuple[Column, Column]:
    return F.substring_index(text, "@", 1), _from(text, F.instr(text, "@") + 1)


def mask_email(text: Column) -> Column:
    local, domain = _local_and_domain(text)
    first = F.when(F.length(local) > 1, F.left(local, F.lit(1))).otherwise("")
    return F.when(text.contains("@"), F.concat(first, F.lit("***@"), domain)).otherwise("***")


def mask_phone(text: Column) -> Column:
    return _hide_all_but(digits_of(text), last=4)


def mask_aadhaar(text: Column) -> Column:
    digits = digits_of(text)
    n = F.length(digits)
    return F.when(n == 12, _hide_all_but(digits, last=4)).otherwise(stars(n))


def mask_pan(text: Column) -> Column:
    kept = F.concat(F.left(text, F.lit(2)), F.lit("******"), F.right(text, F.lit(1)))
    return F.when(F.length(text) >= 3, kept).otherwise("***")


def mask_ip(text: Column) -> Column:
    parts = F.split(text, r"\.", -1)
    return F.when(F.size(parts) == 4, F.concat(parts[0], F.lit(".***.***.***"))).otherwise(
        "***.***.***.***"
    )


def mask_card(text: Column) -> Column:
    digits = digits_of(text)
    last = F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise("****")
    return F.concat(F.lit("****-****-****-"), last)


def _mask_name_part(part: Column) -> Column:
    return F.when(F.length(part) > 1, _hide_all_but(part, first=1)).otherwise("*")


def mask_person(text: Column) -> Column:
    return F.array_join(F.transform(words_of(text), _mask_name_part), " ")


def mask_date(text: Column) -> Column:
    parts = words_of(text)
    return F.when(
        F.size(parts) >= 3, F.concat(F.lit("** "), F.get(parts, 1), F.lit(" ****"))
    ).otherwise("**/**/****")


def mask_passport(text: Column) -> Column:
    return F.when(F.length(text) >= 1, _hide_all_but(text, first=1)).otherwise("********")


def mask_account(text: Column) -> Column:
    return _hide_all_but(text, last=4)


def mask_ifsc(text: Column) -> Column:
    return _hide_all_but(text, first=5)


def mask_upi(text: Column) -> Column:
    local, domain = _local_and_domain(text)
    first = F.when(F.length(local) > 2, F.left(local, F.lit(2))).otherwise("")
    return F.when(text.contains("@"), F.concat(first, F.lit("****@"), domain)).otherwise("****")


def _star_after(text: Column, head: Column) -> Column:
    return F.concat(head, stars(F.length(text) - F.length(head)))


def mask_device(text: Column) -> Column:
    head = F.concat(F.substring_index(text, "-", 1), F.lit("-"))
    return F.when(text.contains("-"), _star_after(text, head)).otherwise("****")


def mask_biometric(text: Column) -> Column:
    head = F.regexp_extract(text, r"(?s)\A(.*_)", 1)
    return F.when(text.contains("_"), _star_after(text, head)).otherwise("****")


def _mask_address_word(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(digits_of(word) == word, _hide_all_but(word, first=1))
        .when(n > 5, _hide_all_but(word, first=2))
        .when(n > 3, _hide_all_but(word, first=1))
        .otherwise(stars(n))
    )


def mask_address(text: Column) -> Column:
    return F.array_join(F.transform(words_of(text), _mask_address_word), " ")


def mask_other(text: Column) -> Column:
    kept = F.concat(F.left(text, F.lit(2)), F.lit("***"), F.right(text, F.lit(2)))
    return F.when(F.length(text) > 4, kept).otherwise("***")


MASKS = {
    "EMAIL": mask_email,
    "PHONE": mask_phone,
    "AADHAAR": mask_aadhaar,
    "PAN": mask_pan,
    "IP_ADDRESS": mask_ip,
    "CREDIT_CARD": mask_card,
    "PERSON_NAME": mask_person,
    "DOB": mask_date,
    "PASSPORT": mask_passport,
    "BANK_ACCOUNT": mask_account,
    "IFSC": mask_ifsc,
    "UPI": mask_upi,
    "DEVICE_ID": mask_device,
    "FINGERPRINT": mask_biometric,
    "FACE_TEMPLATE": mask_biometric,
    "ADDRESS": mask_address,
}


def mask(text: Column, entity_type: Column, extra: dict | None = None) -> Column:
    """Partly hide a value, in the way its entity type asks for.

    ``extra`` maps further entity types to functions from column to column.
    """
    choice = None
    for name, hide in {**MASKS, **(extra or {})}.items():
        branch = entity_type == name
        choice = F.when(branch, hide(text)) if choice is None else choice.when(branch, hide(text))
    return choice.otherwise(mask_other(text))


def redact(entity_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), entity_type, F.lit("]"))


def tokenize(text: Column, key: str) -> Column:
    return F.concat(F.lit("["), stable_token(text, key), F.lit("]"))


def check_mode(mode: str, key: str | None) -> None:
    if mode not in MODES:
        raise ValueError(f"invalid mode {mode!r}; use one of {', '.join(MODES)}")
    if mode == "tokenize" and not key:
        raise ValueError("mode 'tokenize' needs a token key")


def replacement(
    text: Column,
    entity_type: Column,
    mode: str,
    key: str | None = None,
    extra: dict | None = None,
) -> Column:
    """The text to put in place of a detected value."""
    check_mode(mode, key)
    if mode == "redact":
        return redact(entity_type)
    if mode == "tokenize":
        return tokenize(text, key)
    return mask(text, entity_type, extra)
