"""The recognizers and the overlap fold in plain Python, text by text.

For table functions in SQL, and as a second computation that tests hold the column expressions against.  Entities are
dicts with the fields of ENTITY; positions are bytes, ends exclusive.
"""

from __future__ import annotations

import base64
import json
import math
import re

from quillmask.functions import fixed

_SECRET = "|".join(re.escape(p) + form for p, form in sorted(fixed.SECRETS.items(), key=lambda x: -len(x[0])))
_ARMOUR = "|".join(sorted(fixed.ARMOUR, key=len, reverse=True))
_NEVER = "^(?:" + "|".join(fixed.NEVER) + ")$"
_GAP = "[ \t\n\f\r]"


def luhn_ok(number: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return len(number) >= 2 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def mod97_ok(iban: str) -> bool:
    text = iban.upper()
    return len(text) >= 5 and re.fullmatch("[A-Z0-9]+", text) is not None and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def entropy(text: str) -> float:
    """Shannon entropy with shares in whole 256ths, rounded down; 0 for one symbol."""
    counts = [text.count(c) for c in sorted(set(text))]
    return sum(-k / len(text) * math.log2(k * 256 // len(text) / 256) for k in counts if k * 256 // len(text)) if len(counts) > 1 else 0.0


def _email(text: str):
    for m in re.finditer(fixed.EMAIL, text):
        value, after = m[0], text[m.end() : m.end() + 1]
        local, domain = value.split("@", 1)[0], value.rsplit("@", 1)[1].lower()
        wrong = re.match("[A-Za-z0-9.@-]", after) or len(value.encode()) > 254 or not 1 <= len(local) <= 64 or re.search("^-|-$|--", domain) or ".." in value
        if not wrong and domain != "localhost" and local.split("+", 1)[0].lower() not in fixed.NO_ADDRESS:
            yield "EMAIL", "regex", 0.95 if value.rsplit(".", 1)[1].lower() in fixed.TLDS else 0.90, m.start(), m.end(), value


def phone_score(text: str) -> float:
    digits = re.sub("[^0-9]", "", text)
    steps = [int(b) - int(a) for a, b in zip(digits, digits[1:])]
    if not 7 <= len(digits) <= 15:
        return 0.50
    if len(set(digits)) == 1:
        return 0.55
    return 0.60 if any(a == b and a in (1, -1) for a, b in zip(steps, steps[1:])) else 0.85


def _phone(text: str):
    seen = set()
    for pattern in fixed.PHONES:
        for m in re.finditer(pattern, text):
            if m.span() not in seen:
                seen.add(m.span())
                if phone_score(m[0]) >= 0.55:
                    yield "PHONE", "regex", phone_score(m[0]), m.start(), m.end(), m[0]


def _iban(text: str):
    for pattern in fixed.IBANS:
        for m in re.finditer(pattern, text):
            if mod97_ok(m[0]):
                yield "IBAN", "mod97", 0.95, m.start(), m.end(), m[0]


def _card(text: str):
    for m in re.finditer(fixed.CARD, text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and any(lo <= len(digits) <= hi and re.match(p, digits) for p, lo, hi in fixed.ISSUERS):
            yield "CREDIT_CARD", "luhn", 0.95 if luhn_ok(digits) else 0.85, m.start(), m.end(), m[0]


def _jwt(text: str):
    for m in re.finditer(fixed.JWT, text):
        if len(m[0]) <= fixed.JWT_LONGEST and not re.match("[A-Za-z0-9_.-]", text[m.end() : m.end() + 1]):
            header = m[0].split(".")[0]
            try:
                body = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
            except ValueError:
                continue
            if body is None or isinstance(body, dict):
                yield "JWT", "structural", 0.90 if body and "alg" in body else 0.80, m.start(), m.end(), m[0]


def _window(text: str, at: int) -> str:
    return text[:at].encode()[-2000:].decode("utf-8", "replace")


def _secret_prefix(text: str):
    for m in re.finditer(_SECRET, text):
        before = _window(text, m.start())
        if "http://" not in before and "https://" not in before:
            yield "SECRET", "prefix", 0.70 if re.fullmatch("sk-[A-Za-z0-9]+", m[0]) else 0.85, m.start(), m.end(), m[0]


def _secret_entropy(text: str):
    if not any(k in text.lower() for k in fixed.KEYWORDS):
        return
    layers = (
        (fixed.BASE64, 0, lambda h: 0.80 if h >= 4.5 else 0.70 if h >= 3.5 else 0.0),
        (fixed.HEX, 0, lambda h: 0.65 if h >= 3.0 else 0.0),
        (fixed.BEARER, 1, lambda h: 0.50),
        (fixed.PAIR, 1, lambda h: 0.60 if h >= 3.5 else 0.0),
    )
    seen = set()
    for pattern, group, score in layers:
        for m in re.finditer(pattern, text, re.A):
            value, span = m[group], m.span(group)
            tail = re.split(_GAP, _window(text, span[0]))[-1]
            if span not in seen and not re.search(_NEVER, value) and not re.search(fixed.IN_URL, tail) and score(entropy(value)) > 0:
                seen.add(span)
                yield "SECRET", "entropy", score(entropy(value)), *span, value


def _private_key(text: str):
    ends = [(m[1], m.start(), m.end()) for m in re.finditer(f"-----END ({_ARMOUR})-----", text)]
    for m in re.finditer(f"-----BEGIN ({_ARMOUR})-----", text):
        end = next((e for e in ends if e[0] == m[1] and e[1] >= m.end()), None)
        if end:
            body = re.sub("[ \t\r\n]", "", text[m.end() : end[1]])
            good = len(body) >= 40 and re.fullmatch("[A-Za-z0-9+/]+={0,2}", body)
            yield "PRIVATE_KEY", "pem_armor", fixed.ARMOUR[m[1]] if good else 0.70, m.start(), end[2], text[m.start() : end[2]]


def infer_name(email: str) -> tuple[str, float] | None:
    local = email.split("@", 1)[0].split("+", 1)[0]
    parts = local.split(".") if "." in local else local.split("_") if "_" in local else []
    bad = lambda p: not p or not re.match("[A-Za-z]", p) or (len(p) > 1 and p.lower() in fixed.ROLES)
    if not parts or local.lower() in fixed.ROLES or any(map(bad, parts)):
        return None
    return " ".join(p[:1].upper() + p[1:].lower() for p in parts), 0.55 if any(len(p) == 1 for p in parts) else 0.70


def _names(emails):
    for _, _, _, start, end, value in emails:
        if found := infer_name(value):
            yield "NAME", "email_inference", found[1], start, end, found[0]


_ORDER = (_email, _phone, _iban, _card, _jwt, _secret_prefix, _secret_entropy, _private_key)


def raw_entities(text: str | None) -> list[dict]:
    """All entities of a text, names included, in the order of recognizers."""
    found, text = [], text or ""
    lists = [list(f(text)) for f in _ORDER]
    for k, entities in enumerate([*lists, list(_names(lists[0]))]):
        found += [(k, *e) for e in entities]
    places = sorted({p for e in found for p in e[4:6]})
    at, place, offset = {}, 0, 0
    for p in places:  # characters to bytes
        offset, place = offset + len(text[place:p].encode()), p
        at[p] = offset
    return [{"type": t, "source": s, "confidence": c, "start": at[a], "end": at[b], "value": v, "ord": k} for k, t, s, c, a, b, v in found]


def resolve(entities: list[dict]) -> list[dict]:
    """The greedy fold over entities in order of start, longer first."""
    rank = fixed.TYPES.index
    kept: list[dict] = []
    for e in sorted(entities, key=lambda e: (e["start"], -e["end"], e["ord"])):
        if not kept or kept[-1]["end"] <= e["start"]:
            kept.append(e)
            continue
        best = lambda x: (-x["confidence"], rank(x["type"]), x["start"] - x["end"])
        if best(e) < best(kept[-1]):
            kept[-1] = e
    return kept


def detect(text: str | None) -> list[dict]:
    return resolve(raw_entities(text))
