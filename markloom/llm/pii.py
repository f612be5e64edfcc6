"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: the at-sign, `://` of schemes, a plus before a digit, a dot or a
separator between digits, the country and check digit of an IBAN, and the cue words of account numbers and secrets. Around each anchor a local parser, deterministic and
never going back over what it has read, expands to the boundaries of the value and validates it: the parts of an email
address, the four numbers of an IP address, the Luhn sum of a card number, the digits of a phone number, the ISO 7064
check of an IBAN, the host of a web address. Parsers move forward only, so a text is read in time linear in its length.

Base kinds (email, ip, card, phone) are those of the regular expressions in BASE, leftmost and without overlap within a
kind. The method adds `account` (an IBAN of its country's length with a right check, whatever stands around it, or digits
after a cue such as "account no"), `url`, and `secret` (a value of 16 characters or more, a digit among them, that is
assigned to a name such as token or password).

Defined cases: a null or empty text has no spans; repeated rows give equal results; an empty table gives no rows; spans
of different kinds may overlap (`mask` merges them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go

#: Texts that `mask` gives back at once. It bounds memory.
MASKED = 500
#: The base kinds, as a specification; the tests compare the parsers with these.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "account", "url", "secret")
#: Cues of account numbers, lower case.
CUES = ("account no", "account number", "account:", "acct", "iban", "kontonummer", "konto-nr", "número de cuenta", "cuenta no", "numéro de compte", "compte no")
#: Names that secrets are assigned to, lower case.
SECRETS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "private_key", "auth_key")
#: Characters of an IBAN by country. Fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = frozenset("0123456789")
_LOCAL = frozenset(_LETTERS + "0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]*+")
_LABELS = re.compile(r"(?:\.[A-Za-z0-9-]++)++")
_NUMBER = re.compile(r"[0-9]*+")
_PHONE = re.compile(r"[\x20().0-9-]*+")
_CAPITALS = frozenset(_LETTERS[:26] + "0123456789")
_ASSIGNED = re.compile(r"[\"']?[\x20\t]{0,4}+[:=][\x20\t]{0,4}+[\"']?([A-Za-z0-9_+/.=~-]++)")
_GAP = re.compile(r"[\x20:#.=\-]{0,4}+")
_ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_HOST = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:@\[\]-]++(?:[/?#][^\x00-\x20\"<>\\^`{|}\x7f]*+)?+")


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    anchors = {"@": "email", "://": "url"} | {f"+{d}": "phone" for d in _DIGITS} | {f"{c}{d}": "ip" for c in "." for d in _DIGITS}
    anchors |= {f"{c}{s}{d}": "card" for c in _DIGITS for d in _DIGITS for s in ("", " ", "-")}
    anchors |= {form: "account" for cue in CUES for form in (cue, cue.upper(), cue.capitalize(), cue.title())}
    anchors |= {f"{country}{d}": "iban" for country in IBAN_LENGTHS for d in _DIGITS}
    anchors |= {form: "secret" for cue in SECRETS for form in (cue, cue.upper(), cue.capitalize(), cue.title())}
    for word, kind in anchors.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _iban_end(text: str, start: int) -> int:
    """Where the IBAN that begins here ends, by its country's length, single spaces allowed between; 0 if none does."""
    if start and _word(text[start - 1]):
        return 0
    plain, at, length = "", start, IBAN_LENGTHS[text[start : start + 2]]
    while len(plain) < length:
        c = text[at : at + 1]
        if c == " " and plain and text[at - 1] != " ":
            at += 1
        elif c in _CAPITALS:
            plain += c
            at += 1
        else:
            return 0
    right = not _word(text[at : at + 1]) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return at if right else 0


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by kind in the order of KINDS, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys((*KINDS, "iban"), 0)  # where the next value of a kind may begin
    ip_at = 0
    for end, (kind, width) in _automaton().iter(text):
        at = end - width + 1
        if at < done[kind]:
            continue
        if kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1).end()
            labels = _LABELS.match(text, domain)
            if start < at and domain > at + 1 and labels:
                found["email"].append((start, labels.end()))
                done["email"] = labels.end()
        elif kind == "ip":
            start = at
            while start > ip_at and text[start - 1] in _DIGITS:
                start -= 1
            # A chain of numbers and single dots: four at a time, whether or not they are valid.
            edges = [(start, at)] if start < at else []
            place = at
            while text[place : place + 1] == "." and (after := _NUMBER.match(text, place + 1).end()) > place + 1:
                edges.append((place + 1, after))
                place = after
            for k in range(0, len(edges) - 3, 4):
                four = edges[k : k + 4]
                if all(_small(text[a:b]) for a, b in four):
                    found["ip"].append((four[0][0], four[3][1]))
            done["ip"] = ip_at = place
        elif kind == "card":
            start = at
            stop = at + 1
            while True:
                if text[stop : stop + 1] in _DIGITS:
                    stop += 1
                elif text[stop : stop + 1] in (" ", "-") and text[stop + 1 : stop + 2] in _DIGITS:
                    stop += 2
                else:
                    break
            digits = text[start:stop].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append((start, stop))
            done["card"] = stop
        elif kind == "phone":
            run = _PHONE.match(text, at + 2).end()
            while run > at + 3 and text[run - 1] not in _DIGITS:
                run -= 1
            if run > at + 3:
                if 8 <= sum(c in _DIGITS for c in text[at:run]) <= 15:
                    found["phone"].append((at, run))
                done["phone"] = run
        elif kind == "account":
            value = _GAP.match(text, end + 1).end()
            if (m := _ACCOUNT.match(text, value)) and 6 <= sum(c in _DIGITS for c in m[0]) <= 20:
                found["account"].append((value, m.end()))
                done["account"] = m.end()
        elif kind == "iban":
            if at >= done["account"] and (stop := _iban_end(text, at)):
                found["account"].append((at, stop))
                done["account"] = done["iban"] = stop
        elif kind == "secret":
            m = _ASSIGNED.match(text, end + 1)
            if m and len(m[1]) >= 16 and not _DIGITS.isdisjoint(m[1]):
                found["secret"].append(m.span(1))
                done["secret"] = m.end()
        else:
            start = at
            while start > done["url"] and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            m = _HOST.match(text, end + 1)
            if start < at and m:
                stop = m.end()
                while stop > end + 1 and text[stop - 1] in ".,;:!?)]'":
                    stop -= 1
                if stop > end + 1:
                    found["url"].append((start, stop))
                    done["url"] = stop
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def _small(number: str) -> bool:
    plain = number.lstrip("0")
    return len(plain) < 4 and int(plain or 0) <= 255


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans, and how many the method added (but web addresses), of every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                spans = find(t)
                named = [f"{k}:{a}:{b}" for k, a, b in spans]
                base = ",".join(x for x, (k, _, _) in zip(named, spans) if k in BASE)
                rows.append((*(sum(k == kind for k, _, _ in spans) for kind in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(named), *(sum(k == kind for k, _, _ in spans) for kind in ("account", "secret"))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_account", "n_secret"])

    found = F.pandas_udf(run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_account long, n_secret long")
    return docs.select(docs[doc_id].alias("doc_id"), found(docs[text]).alias("_f")).select("doc_id", "_f.*")


def masked(text: str | None, kinds: tuple[str, ...] = (*BASE, "account", "secret")) -> str | None:
    """The text with each span of these kinds replaced by <KIND>; overlapping spans are one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in sorted((x for x in find(text) if x[0] in kinds), key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked in its texts; n_chars, if there, is brought up to date. Same columns and rows."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                for k in range(0, len(texts), MASKED):
                    yield texts.iloc[k : k + MASKED].map(masked, na_action="ignore")
        finally:
            let_go()

    out = docs.withColumn(text, F.pandas_udf(run, "string")(docs[text]))
    return out.withColumn(n_chars, F.length(text).cast("long")) if n_chars in docs.columns else out
