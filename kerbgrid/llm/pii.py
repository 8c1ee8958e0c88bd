"""Personal data by anchor expansion.

An Aho-Corasick machine finds anchors in one pass: at-signs, schemes, identifier cues, dots, plus signs
and digits. From each anchor a deterministic local parser expands left and right and validates what it
has. Base kinds: email (from @), ip (from a dot: the chain of digit runs around it, four at a time), card
(from the first digit of a run), phone (from +). Added kinds: url (from ://), account (an identifier after
a cue such as iban or ssn, validated).

Per kind, spans are leftmost and do not overlap; a candidate that fails its validation is dropped
and its characters stay used up, so each parser reads a character a bounded number of times and very long
texts, which are parsed whole, take linear time. Offsets are code points, end exclusive. Null and empty
texts have no spans. Equal rows give equal results; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import map_rows, only

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Anchors of the machine and what they announce.
ANCHORS = {"@": "email", ".": "ip", "+": "phone", "://": "url", "iban": "account", "ssn": "account", "account": "account", "passport": "account"} | dict.fromkeys("0123456789", "card")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"(?:https?|ftp|ssh|wss?)\Z", re.I | re.A)
_URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_CUE_END = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|id))?[\s:#=]{1,3}", re.I | re.A)
_ACCOUNT = re.compile(r"[A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33}", re.A)
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", re.A)
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def machine():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def _ascii_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def parse(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then kind as listed in KINDS."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    used = dict.fromkeys(KINDS, 0)
    for last, (width, kind) in anchors.iter(_ascii_lower(text)):
        after, before = last + 1, last + 1 - width
        if before < used[kind]:
            continue
        if kind == "card":
            m = _CARD.match(text, before)
            used[kind] = m.end()
            if m.end() - before < 12 or not (12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits)):
                continue
            start, end = before, m.end()
        elif kind == "ip":
            start = before
            while start > used[kind] and text[start - 1] in _DIGITS:
                start -= 1
            if start == before or text[after : after + 1] not in _DIGITS:
                continue
            m = _CHAIN.match(text, start)
            used[kind] = m.end()
            runs, at = m[0].split("."), start
            for k in range(0, len(runs) - 3, 4):
                four = runs[k : k + 4]
                to = at + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    out.append((at, KINDS.index(kind), to))
                at = to + 1
            continue
        elif kind == "email":
            start = before
            while start > used[kind] and text[start - 1] in _LOCAL:
                start -= 1
            if start == before or not (m := _DOMAIN.match(text, after)):
                continue
            end = m.end()
        elif kind == "phone":
            if not (m := _PHONE.match(text, before)):
                continue
            start, end = before, m.end()
            used[kind] = end
            if not 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                continue
        elif kind == "url":
            if not (m := _SCHEME.search(text, max(used[kind], before - 5), before)) or not (tail := _URL.match(text, after)):
                continue
            start, end = m.start(), tail.end()
            while text[end - 1] in ".,;:!?)" and end > after + 1:
                end -= 1
        else:
            if before and text[before - 1].isalnum() or not (m := _CUE_END.match(text, after)):
                continue
            start, word = m.end(), text[before:after].lower()
            if word == "ssn":
                m = _SSN.match(text, start)
            elif word == "iban":
                m = _IBAN.match(text, start)
                m = m if m and iban_ok(m[0]) else None
            else:
                m = _ACCOUNT.match(text, start)
                m = m if m and sum(map(str.isdigit, m[0])) >= 6 and not re.search("[a-z]{2}", m[0]) else None
            if not m:
                continue
            end = m.end()
        used[kind] = end
        out.append((start, KINDS.index(kind), end))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and spans array<struct<kind,start,end>>."""

    def make() -> Callable:
        anchors = machine()
        return lambda columns: ((k, parse(t, anchors)) for k, t in zip(*columns))

    return map_rows(only(docs, **{key: "long", text: "string"}), f"{key} long, spans array<struct<kind:string,start:long,end:long>>", make)


def personal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = personal_spans(docs)
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, one), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
