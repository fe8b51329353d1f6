"""Operator 4: personal data by anchor expansion.

One Aho-Corasick automaton runs over each whole text and finds anchors: at-signs, plus-signs, digits,
schemes and identifier cues (words that announce accounts or streets, prefixes of keys). From each
anchor a deterministic local parser expands to the boundaries of the value and validates it. The
cost is linear in the text: each parser skips anchors inside what it has already consumed.

Kinds, in order: email, ip, card, phone (the base kinds, as their fixed patterns define them), then
url, account, ssn, address, secret.

Defined results: a null or empty text has no spans; repeated rows get equal results; an empty
table gives no rows; columns other than doc_id and text are ignored (and kept by redact()).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.words import slices

KINDS = ("email", "ip", "card", "phone", "url", "account", "ssn", "address", "secret")
RANK = {k: i for i, k in enumerate(KINDS)}
N_BASE = 4

# The base patterns, used anchored at their anchor, and the parsers of the other kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![-0-9])")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
URL_RIGHT = re.compile(r"[^\s<>\"'`|{}\\^]+")
ACCOUNT_GAP = re.compile(r"(?:[\s#:=.-]|no\b|nr\b|number|num\b|nummer|numéro|número|is\b){0,12}", re.I)
ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,}")
IBAN_CHAIN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9])+")
#: Lengths of IBANs by country; those of other countries are found by their check digits alone.
IBAN_LENGTHS = dict(zip("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split(), map(int, "24 23 20 16 22 21 28 24 22 18 20 24 18 27 22 23 27 21 28 22 23 26 27 21 20 20 21 27 31 18 15 28 25 24 24 24 19 24 27 26".split()), strict=True))
STREET_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?,?$")
STREET_NAME = re.compile(r"[A-Z][\w'’.-]*")
STREET_NAMES = 4
STREET_RIGHT = re.compile(r"\.?(?:,? (?:Apt|Suite|Ste|Unit|#)\.? ?[0-9A-Za-z-]+)?(?:,? [A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,2},? [A-Z]{2} [0-9]{5}(?:-[0-9]{4})?)?")
STRASSE = re.compile(r" [0-9]{1,4}[a-z]?(?:, [0-9]{5} [A-ZÄÖÜ][a-zäöüß]+)?(?![0-9A-Za-z])")
HEX_TOKEN = re.compile(r"\s*[=:]\s*[\"']([0-9A-Za-z_-]{16,})[\"']")
AWS_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])")
PREFIXED_KEY = re.compile(r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_|sk_test_|whsec_)[0-9A-Za-z-]{10,}")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive", "court", "highway")
STRASSE_CUES = ("straße", "strasse", "platz", "gasse")
KEY_CUES = ("akia", "asia", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "whsec_")
TOKEN_CUES = ("token", "secret", "password", "api_key", "apikey")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("url", ("://",)), ("account", ACCOUNT_CUES), ("street", STREET_CUES), ("strasse", STRASSE_CUES), ("key", KEY_CUES), ("token", TOKEN_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_automaton: list[ahocorasick.Automaton] = []


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_end(text: str, p: int) -> int:
    """Where the IBAN that begins at p ends (groups may be apart by a space or hyphen), or -1: its country's length, else the longest run that passes."""
    m = IBAN_CHAIN.match(text, p, p + 80)  # 34 characters and what is between them
    if m is None:
        return -1
    at = [i for i in range(p, m.end()) if text[i] not in " -"][:34]
    known = IBAN_LENGTHS.get(text[p : p + 2].upper())
    for n in (known,) if known else range(len(at), 14, -1):
        end = at[n - 1] + 1 if n <= len(at) else -1
        if end > 0 and not (text[end : end + 1].isalnum() and text[end : end + 1].isascii()):
            code = "".join(text[i] for i in at[:n]).upper()
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return end
    return -1


def street_start(text: str, p: int) -> int:
    """Where the address begins whose kind of street begins at p: a number, then one to four names, of any length; -1 if there is none."""
    names = 0
    while p and text[p - 1] == " ":
        at = text.rfind(" ", 0, p - 1) + 1
        number = STREET_NUMBER.search(text, max(at - 1, p - 9, 0), p - 1) if names else None
        if number:
            return number.start()
        if names == STREET_NAMES or not STREET_NAME.fullmatch(text, at, p - 1):
            return -1
        names, p = names + 1, at
    return -1


def _folded(text: str) -> str:
    """Lower case with unchanged positions."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind as listed, then end."""
    if not _automaton:
        _automaton.append(automaton())
    out: list[tuple[int, int, str]] = []
    email_from = ip_from = card_from = phone_from = url_from = 0
    for last, (kind, length) in _automaton[0].iter(_folded(text)):
        p, q = last - length + 1, last + 1
        if kind == "0":
            if p >= ip_from:
                m = IP_CHAIN.match(text, p)
                ip_from = m.end()
                if ip_from - p >= 7 and text.count(".", p, ip_from) >= 3:
                    at, parts = p, m[0].split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = at + sum(map(len, four)) + 3
                        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                            out.append((at, end, "ip"))
                        at = end + 1
            if p >= card_from:
                card_from = CARD_CHAIN.match(text, p).end()
                if card_from - p >= 14 and 14 <= len(d := _digits(text[p:card_from])) <= 19 and luhn(d):
                    out.append((p, card_from, "card"))
            if (p == 0 or text[p - 1] not in "-0123456789") and (m := SSN.match(text, p)):
                out.append((p, m.end(), "ssn"))
        elif kind == "@":
            if p >= email_from and (m := DOMAIN.match(text, p)):
                start = p
                while start > email_from and text[start - 1] in LOCAL:
                    start -= 1
                if start < p:
                    email_from = m.end()
                    out.append((start, email_from, "email"))
        elif kind == "+":
            if p >= phone_from and (m := PHONE.match(text, p)):
                phone_from = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((p, phone_from, "phone"))
        elif kind == "url":
            if p >= url_from and (m := URL_RIGHT.match(text, q)):
                start = p
                while start > url_from and text[start - 1] in SCHEME:
                    start -= 1
                while start < p and not text[start].isalpha():
                    start += 1
                end = q + len(m[0].rstrip(".,;:!?)]"))
                if start < p and end > q:
                    url_from = end
                    out.append((start, end, "url"))
        elif kind == "account":
            if p == 0 or not text[p - 1].isalnum():
                start = ACCOUNT_GAP.match(text, q).end()
                end = iban_end(text, start)
                if end < 0 and (m := ACCOUNT.match(text, start)) and len(_digits(m[0])) <= 34:
                    end = m.end()
                if end > 0:
                    out.append((start, end, "account"))
        elif kind == "street":
            if not text[q : q + 1].isalnum() and text[p].isupper() and (start := street_start(text, p)) >= 0:
                out.append((start, STREET_RIGHT.match(text, q).end(), "address"))
        elif kind == "strasse":
            if m := STRASSE.match(text, q):
                start = p
                while start and text[start - 1].isalpha():
                    start -= 1
                if text[start].isupper():
                    out.append((start, m.end(), "address"))
        elif kind == "key":
            if (p == 0 or not text[p - 1].isalnum()) and (m := AWS_KEY.match(text, p) or PREFIXED_KEY.match(text, p)):
                out.append((p, m.end(), "secret"))
        elif m := HEX_TOKEN.match(text, q):
            out.append((m.start(1), m.end(1), "secret"))
    out.sort(key=lambda s: (s[0], RANK[s[2]], s[1]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each run of overlapping spans replaced by the first one's kind, as in [EMAIL]."""
    out, at = [], 0
    reach, kind = -1, ""
    start = 0
    for a, b, k in [*spans, (len(text) + 1, 0, "")]:
        if a >= reach:
            if reach >= 0:
                out += [text[at:start], f"[{kind.upper()}]"]
                at = reach
            start, reach, kind = a, b, k
        else:
            reach = max(reach, b)
    return "".join([*out, text[at:]])


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = find(t or "")
            base = [s for s in spans if RANK[s[2]] < N_BASE]
            n = [sum(s[2] == k for s in base) for k in KINDS[:N_BASE]]
            rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        names = [x.split(" ")[0] for x in REPORT.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, their digest and all spans."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_report, REPORT)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind; n_chars, where there is one, follows."""
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [None if t is None else redacted(t, find(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                old = columns[length].to_pylist()
                columns[length] = pa.array([o if n is None else len(n) for o, n in zip(old, new, strict=True)], columns[length].type)
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
