"""Personal-data detection and de-identification as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: what counts as each kind of personal data ----
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+1 )?\([0-9]{3}\) [0-9]{3}-[0-9]{4}\b|\b[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
CARD = r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b|\b3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
TOKEN_LABEL = "LEDGER_TOKEN"

#: Everything that is masked or tokenised, tried in this order at each place in a text.
ANY = "|".join((EMAIL, SSN, IBAN, CARD, PHONE))


def luhn_valid(number: Column) -> Column:
    """Whether a card number passes the check-digit rule."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    values = F.transform(
        F.filter(digits, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")
        ),
    )
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0


def found(text: Column) -> Column:
    """Array of (info_type, value), one per occurrence, in the order of the types.

    A cheap look for an ``@`` or two digits in a row spares most texts the patterns.
    """

    def of(kind: str, pattern: str, worth_it: Column) -> Column:
        matches = F.when(worth_it, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
            F.array().cast("array<string>")
        )
        return F.transform(matches, lambda m: F.struct(F.lit(kind).alias("info_type"), m.alias("value")))

    digits = text.rlike("[0-9][0-9]")
    cards = F.filter(of("CREDIT_CARD_NUMBER", CARD, digits), lambda f: luhn_valid(f["value"]))
    return F.concat(
        of("EMAIL_ADDRESS", EMAIL, text.contains("@")),
        of("PHONE_NUMBER", PHONE, digits),
        of("US_SOCIAL_SECURITY_NUMBER", SSN, digits),
        cards,
        of("IBAN_CODE", IBAN, digits),
    )


def replace_matches(text: Column, pattern: str, replacement) -> Column:
    """``text`` with every match of ``pattern`` put through ``replacement(column)``."""
    between = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), replacement)
    pieces = F.zip_with(between, matches, lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    return F.array_join(pieces, "")


def token(value: Column, secret: str) -> Column:
    """Deterministic surrogate of a value under ``secret``."""
    return F.concat(F.lit(f"{TOKEN_LABEL}("), F.sha2(F.concat(F.lit(secret), value), 256), F.lit(")"))


def deidentify(text: Column, secret: str) -> Column:
    """Tokens for SSN, IBAN and card numbers; ``#`` for every character of e-mails and phones."""

    def hide(m: Column) -> Column:
        direct = m.contains("@") | m.rlike(f"^(?:{PHONE})$")
        not_a_card = m.rlike(f"^(?:{CARD})$") & ~luhn_valid(m)
        return (
            F.when(direct, F.repeat(F.lit("#"), F.length(m))).when(not_a_card, m).otherwise(token(m, secret))
        )

    worth_it = text.contains("@") | text.rlike("[0-9][0-9]")
    return F.when(worth_it, replace_matches(text, ANY, hide)).otherwise(text)
