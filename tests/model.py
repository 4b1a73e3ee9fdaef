"""The semantics once more, in plain Python: slow, obvious, on one text at a time."""

from __future__ import annotations

import re

from spanveil.functions import fixed_values as V

I = re.IGNORECASE
MAIN = [
    ("EMAIL", 0.95, [(V.EMAIL, 0)]),
    ("PHONE", 0.90, [(p, 0) for p in (V.PHONE_INDIAN_MOBILE, V.PHONE_INDIAN_SPACED, V.PHONE_INTERNATIONAL)]),
    ("AADHAAR", 0.98, [(V.AADHAAR, 0)]),
    ("PAN", 0.98, [(V.PAN, 0)]),
    ("IP_ADDRESS", 0.95, [(V.IP_ADDRESS, 0)]),
    ("CREDIT_CARD", 0.85, [(V.CREDIT_CARD, 0)]),
    ("DOB", 0.80, [(V.DATE_DAY_FIRST, 0), (V.DATE_YEAR_FIRST, 0), (V.DATE_MONTH_NAME, I)]),
    ("PASSPORT", 0.90, [(V.PASSPORT, 0)]),
    ("BANK_ACCOUNT", 0.85, [(V.BANK_ACCOUNT, 0)]),
    ("IFSC", 0.95, [(V.IFSC, 0)]),
    ("UPI", 0.90, [(V.UPI, 0)]),
    ("DEVICE_ID", 0.95, [(V.DEVICE_ID, I)]),
    ("FINGERPRINT", 0.98, [(V.FINGERPRINT, I)]),
    ("FACE_TEMPLATE", 0.98, [(V.FACE_TEMPLATE, I)]),
]
BASIC = [
    ("email", 1.0, [(V.EMAIL, I)]),
    ("phone", 1.0, [(V.BASIC_PHONE, I)]),
    ("aadhaar", 1.0, [(V.BASIC_AADHAAR, 0)]),
    ("pan", 1.0, [(V.PAN, I)]),
    ("ip", 1.0, [(V.BASIC_IP, 0)]),
    ("credit_card", 1.0, [(V.CREDIT_CARD, 0)]),
]
PREFIX = "(?:" + "|".join(V.ADDRESS_PREFIX_WORDS) + ")" + V.ADDRESS_PREFIX_TAIL
STREET = V.STREET_HEAD + "(?:" + "|".join(V.STREET_WORDS) + ")"
UNIT = "(?:" + "|".join(V.UNIT_WORDS) + ")" + V.UNIT_TAIL
CITY = "(?:" + "|".join(V.CITIES) + ")" + V.CITY_TAIL


def _fits(text: str) -> bool:
    return V.ADDRESS_MIN_LENGTH <= len(text) <= V.ADDRESS_MAX_LENGTH


def _street(text: str, found: re.Match) -> tuple:
    start = max(0, found.start() - V.STREET_CONTEXT_BEFORE)
    words = text[start : found.end() + V.STREET_CONTEXT_AFTER].strip()
    for delimiter in V.STREET_DELIMITERS:
        at = words.lower().find(delimiter)
        if at > V.STREET_CUT_AFTER:
            words = words[:at].strip()
    return start, start + len(words), words


def addresses(text: str) -> list[tuple]:
    kept = [
        (*m.span(1), m[1].strip()) for m in re.finditer(PREFIX, text, I) if _fits(m[1].strip())
    ]
    later = [s for s in (_street(text, m) for m in re.finditer(STREET, text, I)) if _fits(s[2])]
    later += [(*m.span(), m[0].strip()) for m in re.finditer(UNIT, text, I) if _fits(m[0].strip())]
    later += [(*m.span(), m[0].strip()) for m in re.finditer(CITY, text, I)]
    for s, e, value in later:
        if all(not (a <= s < b) and not (a < e <= b) for a, b, _ in kept):
            kept.append((s, e, value))
    return kept


def raw(text: str, rules=MAIN, with_addresses: bool = True) -> list[tuple]:
    """(entity, start, end, text, confidence), rule by rule."""
    out = []
    for entity, confidence, patterns in rules:
        seen = set()
        for pattern, flags in patterns:
            for m in re.finditer(pattern, text, flags):
                lowered = m[0].lower()
                if entity == "UPI" and not any(h in lowered for h in V.UPI_HANDLES):
                    continue
                if m.span() not in seen:
                    seen.add(m.span())
                    out.append((entity, *m.span(), m[0], confidence))
    if with_addresses:
        out += [("ADDRESS", s, e, value, 0.75) for s, e, value in addresses(text)]
    return out


def detect(text: str) -> list[tuple]:
    """Compare each span with every kept one."""
    kept: list[tuple] = []
    for new in sorted(raw(text), key=lambda d: (d[1], -d[2])):
        rivals = [i for i, old in enumerate(kept) if new[1] < old[2] and old[1] < new[2]]
        if not rivals:
            kept.append(new)
        elif (new[2] - new[1], new[4]) > (kept[rivals[0]][2] - kept[rivals[0]][1], kept[rivals[0]][4]):
            kept[rivals[0]] = new
    return sorted(kept, key=lambda d: d[1])


def detect_basic(text: str) -> list[tuple]:
    return sorted(raw(text, BASIC, False), key=lambda d: d[1])


def _backwards(text: str, spans: list[tuple], new) -> str:
    for span in reversed(spans):
        text = text[: span[1]] + new(text[span[1] : span[2]], span) + text[span[2] :]
    return text


def redact(text: str) -> str:
    return _backwards(text, detect(text), lambda _, span: f"[REDACTED_{span[0]}]")


def redact_basic(text: str) -> str:
    return _backwards(text, detect_basic(text), lambda _, span: f"[REDACTED_{span[0].upper()}]")


def mask_basic(text: str) -> str:
    return _backwards(text, detect_basic(text), lambda _, span: "*" * (span[2] - span[1]))


def redact_sql_literals(text: str) -> str:
    return re.sub(V.SQL_LITERAL, lambda m: "'" + redact(m[0][1:-1]) + "'", text)


def redact_segments(segments: list[str], fallback: bool = False) -> list[str]:
    found = sorted(detect("\n".join(segments)), key=lambda d: d[1], reverse=True)
    swaps = [(d[3], (d[3].split() or [""])[0], f"[REDACTED_{d[0]}]") for d in found]
    out = []
    for segment in segments:
        if not fallback:
            for value, _, new in swaps:
                segment = segment.replace(value, new)
            out.append(segment)
            continue
        # Pieces are texts, or replacements as 1-tuples, which are not searched again.
        pieces: list = [segment]
        needles = [(v, new) for v, _, new in swaps if v in segment]
        needles += [(w, new) for v, w, new in swaps if v not in segment and w]
        for needle, new in needles:
            cut: list = []
            for piece in pieces:
                if isinstance(piece, tuple):
                    cut.append(piece)
                    continue
                for i, part in enumerate(piece.split(needle)):
                    cut += [(new,), part] if i else [part]
            pieces = cut
        out.append("".join(p[0] if isinstance(p, tuple) else p for p in pieces))
    return out
