"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over the text once and reports anchors: at-signs, schemes,
plus signs, digits and identifier cues. At each anchor a local parser expands to the left and
right and checks what it found; text without anchors costs the one pass alone.

The base kinds (email, ip, card, phone) are those of a leftmost, non-overlapping search per kind
whose matches are dropped where a check fails. The method adds url spans (at schemes) and
account spans, after a cue that stands as a word of its own in any letter case: an IBAN has its
country, length and mod-97 check, a social security number its shape and number ranges, other
numbers five characters with digits for at least half of them, and a secret (token, password, key)
an explicit sign of assignment or the look of a key.

Defined results: null counts as empty; a text without spans has the digest of the empty string
and empty spans; very long texts are read whole, in one pass; offsets are code points, end
exclusive; spans of different kinds may overlap; empty tables give no rows; repeated rows give
equal rows; columns other than the text are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlift.llm.common import table

KINDS = ("email", "ip", "card", "phone", "url", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
URL_REST = re.compile(r"[^\s<>\"'`|\\^{}]+")
HOST = re.compile(r"(?:[^/?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[\w-]+(?:\.[\w-]+)+|localhost)(?::[0-9]+)?(?=[/?#]|$)")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z])")
VALUE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9]|[_./+=~-](?=[A-Za-z0-9])){4,127}(?![A-Za-z0-9])")
#: What may stand between a cue and its value: a word for number, and one of a sign of assignment, a quote or a space.
BETWEEN = re.compile(r"(?:[\s_-]?(?:id|no|nr|number|num)\b\.?)?(?:[\"']?\s{0,3}(?P<sign>:=|=>|[:=#]|\bis\b)\s{0,3}[\"']?|\s{1,3}(?P<quote>[\"'])?)", re.I)
#: The words that announce an identifier, by how it is checked.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security number", "social security no"),
    "number": ("account", "acct", "passport", "license", "licence", "customer id", "user id", "member id"),
    "secret": ("api_key", "apikey", "api-key", "api key", "access_key", "secret_key", "token", "secret", "password", "passwd"),
}
#: A to Z alone: places in the text stay what they are.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", ":"), *((d, "0") for d in "0123456789")]:
        found.add_word(word, (kind, 1))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """An IBAN at the place: the longest run of groups whose check holds."""
    m = IBAN.match(text, at)
    end = m.end() if m else at
    while m and end - at >= 15:
        digits = text[at:end].replace(" ", "").upper()
        if text[end - 1] != " " and 15 <= len(digits) <= 34 and not (end < len(text) and text[end].isalnum()) and int("".join(str(int(c, 36)) for c in digits[4:] + digits[:4])) % 97 == 1:
            return at, end
        end -= 1
    return None


def account(text: str, start: int, at: int, kind: str) -> tuple[int, int] | None:
    """The identifier after a cue that spans [start, at), if it is one."""
    if start and (text[start - 1].isalnum()):
        return None
    m = BETWEEN.match(text, at)
    if not m:
        return None
    place = m.end()
    if kind == "iban":
        return _iban(text, place)
    if kind == "ssn":
        return x.span() if (x := SSN.match(text, place)) else None
    if not (x := VALUE.match(text, place)):
        return None
    value = x.group()
    digits = sum(map(str.isdigit, value))
    named = m["sign"] or m["quote"]
    if kind == "number":
        good = 2 * digits >= len(value)
    else:
        good = digits > 0 and (named or len(value) >= 16 and digits >= 4 and digits < len(value))
    return x.span() if good else None


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind, in order of KINDS and then of start."""
    email, ip, card, phone, url, accounts = out = [[] for _ in KINDS]
    email_end = ip_end = card_end = phone_end = url_end = account_end = run_end = run_stop = 0
    low = text.translate(ASCII_LOWER)
    for at, (kind, size) in anchors().iter(low):
        if kind == "0":
            if at >= card_end:
                m = CARD.match(text, at)
                card_end = m.end() if m else at + 1
                if m and card_end - at >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        card.append(m.span())
            if at >= ip_end:
                m = IP.match(text, at)
                ip_end = m.end() if m else DIGITS.match(text, at).end()
                if m and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                    ip.append(m.span())
        elif kind == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                email.append((start, email_end))
        elif kind == "+":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                    phone.append(m.span())
        elif kind == ":":
            start = colon = at - 2
            while start > url_end and text[start - 1] in SCHEME:
                start -= 1
            while start < colon and not text[start].isalpha():
                start += 1
            if start < colon and at + 1 >= run_end:
                # The run of URL characters and where its closing marks begin hold for all schemes inside it.
                m = URL_REST.match(text, at + 1)
                run_end = m.end() if m else at + 1
                run_stop = at + 1 + len(text[at + 1 : run_end].rstrip(".,;:!?)]*_~"))
            if start < colon and at + 1 < run_stop and HOST.match(text, at + 1, run_stop):
                url_end = run_stop
                url.append((start, url_end))
        elif at + 1 >= account_end and (span := account(text, at + 1 - size, at + 1, kind)) and span[0] >= account_end:
            account_end = span[1]
            accounts.append(span)
    return out


def _joined(spans: list[list[tuple[int, int]]], kinds: int) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k in range(kinds) for a, b in spans[k])


def spans_of(text: Column) -> Column:
    """struct(n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account)."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = find(t or "")
                rows.append((*(len(x) for x in s[:4]), hashlib.sha256(_joined(s, 4).encode()).hexdigest(), _joined(s, len(KINDS)), len(s[4]), len(s[5])))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account"])

    return spans(text)


def redact(text: str) -> list[tuple[int, int, str]]:
    """Edits that put <kind> in the place of each span, from left to right; of overlapping spans the first counts."""
    edits, end = [], 0
    for a, b, kind in sorted((a, b, KINDS[k]) for k, spans in enumerate(find(text)) for a, b in spans):
        if a >= end:
            edits.append((a, b, f"<{kind}>"))
            end = b
    return edits


def op5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", spans_of(F.col("text")).alias("p")).select("doc_id", "p.*")
