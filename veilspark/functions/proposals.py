"""Deterministic predicates over values that a model, or a reviewer, proposes; all Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of kinds.
ALLOWED_KINDS = (
    "name", "address", "social security", "ssn", "itin", "tax id", "taxpayer id", "ein", "employer identification", "employer id",
    "account", "routing", "iban", "swift", "sort code", "bank", "institution", "brokerage", "card", "policy", "member", "patient",
    "case number", "claim", "date of birth", "dob", "birth", "phone", "fax", "email", "e-mail", "passport", "licen", "registration",
    "vehicle identification", "plate", "pin", "password", "passcode", "api key", "access code", "token", "secret", "credential",
    "signature", "wallet", "employee id", "student id",
)
EXCLUDED_EXACTLY = ("number", "string", "letter", "code", "date", "title", "label", "caption", "text", "word", "value", "field", "line", "box", "form", "checkbox")
EXCLUDED_KINDS = (
    "money", "amount", "total", "subtotal", "balance", "wage", "salary", "compensation", "percentage", "figure", "currency",
    "form title", "form number", "form code", "document title", "line number", "box number", "line item", "account type",
)
NUMBER_KINDS = ("number", "identifier", " id", "ein", "ssn", "itin", "account")
PARTICLES = ("van", "von", "de", "del", "della", "der", "di", "da", "dos", "du", "la", "le", "bin", "binte", "ibn", "al", "el", "mac", "mc", "of", "and", "the", "for")
MONEY = r"^[()$£€\-+ ]*[0-9][0-9,. ]*[)%]?$"
CAPTION = r"(?i)^(?:(?:box|line|part|step|item|column|code|page)[ .:#]*[0-9]{1,2}[a-z]?|(?:form|schedule)[ .:#]*(?:[0-9]{1,4}[a-z]?|[a-k]))$"
FORM_NAME = r"(?i)^(?:forms?|schedules?|sch)\b[ .:#]"
LABEL = r"^[A-Za-z][A-Za-z&'\-]*(?:[ ][A-Za-z&'\-]+){0,3}:[ \t]+"
EDGE = r"^[\p{P}]+|[\p{P}]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _is(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def looks_like_a_value(text: Column) -> Column:
    t = trimmed(text)
    lone = (F.size(_words(t)) == 1) & ~_is(t, r"\p{N}") & (F.length(t) < 6)
    return (F.length(t) >= 4) & ~F.endswith(t, F.lit(":")) & _is(t, r"[\p{L}\p{N}]") & ~lone


def is_not_identifying(text: Column) -> Column:
    t = trimmed(text)
    n_digits = F.length(F.regexp_replace(t, r"\P{N}", ""))
    named = F.exists(F.slice(_words(t), 2, 1 << 20), lambda w: _is(F.regexp_replace(w, EDGE, ""), r"^\p{Lu}.*\p{Ll}"))
    return (
        F.when(t == "", True)
        .when(_is(t, MONEY), F.contains(t, F.lit(".")) | F.contains(t, F.lit("%")) | (n_digits < 8))
        .when(_is(t, FORM_NAME) & ~named, True)
        .otherwise(_is(t, CAPTION))
    )


def value_without_label(text: Column) -> Column:
    rest = F.trim(F.regexp_replace(text, LABEL, ""))
    return F.when(_is(text, LABEL) & (F.length(rest) >= 3), rest).otherwise(text)


def is_too_slight(text: Column) -> Column:
    t = trimmed(text)
    real = F.size(F.filter(_words(t), lambda w: F.length(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")) >= 2))
    return (F.length(t) < 4) | _is(t, r"(?i)^[0-9]{1,2}[a-z]$") | (~_is(t, r"\p{N}") & (real < 2) & (F.length(t) < 8))


def is_rule_hit_with_caption(proposal: Column, rule_value: Column) -> Column:
    """Whether a proposal is just a value a rule has found, perhaps with a caption."""
    at = F.call_function("locate", F.lower(rule_value), F.lower(proposal))
    extra = F.concat(F.substring(proposal, F.lit(1), at - F.lit(1)), F.substring(proposal, at + F.length(rule_value), F.length(proposal)))
    extra = F.regexp_replace(extra, r"(?U)^[\s\p{P}]+|[\s\p{P}]+$", "")
    return (F.length(rule_value) > 0) & (at > 0) & ((extra == "") | (~_is(extra, r"\p{N}") & (F.size(_words(extra)) <= 5)))


def is_implausible_name(text: Column, kind: Column) -> Column:
    t = trimmed(text)

    def odd(word: Column) -> Column:
        bare = F.regexp_replace(word, EDGE, "")
        return (bare != "") & ~_is(bare, r"^[\p{Lu}\p{Lt}\p{N}]") & ~F.lower(bare).isin(*PARTICLES)

    return F.contains(F.lower(kind), F.lit("name")) & ((F.length(t) > 60) | F.exists(_words(t), odd))


def is_implausible_identifier(text: Column, kind: Column) -> Column:
    return _contains_any(F.lower(kind), NUMBER_KINDS) & (F.length(trimmed(text)) > 30)


def is_allowed_kind(kind: Column) -> Column:
    return (F.trim(kind) == "") | _contains_any(F.lower(kind), ALLOWED_KINDS)


def is_excluded_kind(kind: Column) -> Column:
    k = F.lower(kind)
    return (k != "") & (k.isin(*EXCLUDED_EXACTLY) | _contains_any(k, EXCLUDED_KINDS))
