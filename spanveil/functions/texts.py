"""Scalar expressions on texts, bytes, file names and request headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.functions.regex import strip

# Stands for a genuine U+FFFD while invalid bytes are turned into U+FFFD and dropped.
_KEPT = "﷐﷑﷒"


def decode_lenient(content: Column) -> Column:
    """UTF-8 text without the bytes that are not UTF-8."""
    text = content.cast("string")
    marked = F.replace(text, F.lit("�"), F.lit(_KEPT))
    dropped = F.replace(F.make_valid_utf8(marked), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(dropped, F.lit(_KEPT), F.lit("�"))
    )


def decode_strict(content: Column) -> Column:
    """UTF-8 text, or an empty text if any byte is wrong."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise("")


def extract_text(content: Column, file_type: Column) -> Column:
    return F.when(file_type.isin(V.TEXT_FILE_TYPES), decode_lenient(content)).otherwise(
        decode_strict(content)
    )


def extension_of(filename: Column) -> Column:
    """Lower-case last suffix without its dot; empty for ``name`` and ``.name``."""
    return F.lower(F.regexp_extract(filename, r"[^/]\.([^./]+)/*\z", 1))


def file_type_of(filename: Column) -> Column:
    extension = extension_of(filename)
    choice = F.when(F.lit(False), "")
    for suffix, name in V.FILE_TYPES.items():
        choice = choice.when(extension == suffix, name)
    return choice.otherwise("unknown")


def reject_reason(filename: Column, size: Column, limit: int = V.MAX_FILE_SIZE) -> Column:
    """Why a file is refused; null if it is admitted."""
    return F.when(
        ~extension_of(filename).isin(list(V.FILE_TYPES)), "File type not allowed"
    ).when(size > limit, "File too large")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def preview(text: Column, length: int = V.PREVIEW_LENGTH) -> tuple[Column, Column]:
    """(first characters, whether there are more)."""
    return text.substr(1, length), F.length(text) > length


def preview_bytes(content: Column, length: int = V.PREVIEW_LENGTH) -> tuple[Column, Column]:
    """As ``preview``, with a fixed message for content that is not text."""
    text = content.cast("string")
    shown, more = preview(text, length)
    valid = F.is_valid_utf8(text)
    return (
        F.when(valid, shown).otherwise(V.PREVIEW_BINARY_MESSAGE),
        F.when(valid, more).otherwise(False),
    )


def shorten(text: Column, length: int = V.DISPLAY_LENGTH) -> Column:
    return F.when(F.length(text) > length, F.concat(text.substr(1, length), F.lit("..."))).otherwise(
        text
    )


def nonblank_lines(text: Column) -> Column:
    """The stripped lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda line: line != "")


def client_ip(forwarded_for: Column, real_ip: Column, host: Column) -> Column:
    """First forwarded address, else the real-IP header, else the peer."""
    return (
        F.when(F.length(forwarded_for) > 0, strip(F.get(F.split(forwarded_for, ",", -1), 0)))
        .when(F.length(real_ip) > 0, real_ip)
        .otherwise(host)
    )


def display_time(timestamp: Column) -> Column:
    """Second precision, ``N/A`` if missing."""
    return F.coalesce(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("N/A"))
