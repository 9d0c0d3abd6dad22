"""Amount text -> cents, strict decimals, currency codes.

All steps are built-in string functions; the result is ANSI-safe (``try_cast``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and tokens removed before parsing (X12: CAD before CA).
NBSP_CHARS = "\u00a0\u202f"
CURRENCY_TOKENS = ("CAD", "CA", "$")
# Currency mapping of the transformer.
CURRENCY_MAP = {"$": "CAD", "C$": "CAD", "CA$": "CAD", "CAD": "CAD", "USD": "USD", "EUR": "EUR"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def amount_to_decimal(col) -> Column:
    """Text amount -> DECIMAL(38,10) or NULL.

    Handles ``$``/``CAD``/``CA``, non-breaking spaces, accounting parentheses,
    ``1.234,56`` (point = thousands) and ``1234,56`` (comma = decimal); a plain
    point stays a decimal point. Each intermediate string is referenced at most
    three times, so the generated code stays small (no branch duplicates the
    whole chain)."""
    s = F.trim(_c(col).cast("string"))
    neg = s.startswith("(") & s.endswith(")")
    s = F.regexp_replace(s, r"(?s)^\((.*)\)$", "$1")
    s = F.translate(s, NBSP_CHARS, "")
    for tok in CURRENCY_TOKENS:
        s = F.replace(s, F.lit(tok), F.lit(""))
    s = F.regexp_replace(s, r"\s+", "")
    # a comma is the decimal mark; when present, points are thousands separators
    s = F.when(s.contains(","), F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")).otherwise(s)
    return s.try_cast("decimal(38,10)") * F.when(neg, F.lit(-1)).otherwise(F.lit(1))


def amount_to_cents(col) -> Column:
    """B1: text amount -> integer cents (round half away from zero), NULL if unparsable."""
    return F.round(amount_to_decimal(col) * 100, 0).try_cast("long")


def strict_decimal(col) -> Column:
    """Text -> DECIMAL(18,2) when it is a plain signed number, else 0."""
    s = F.trim(_c(col).cast("string"))
    ok = s.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return F.when(ok, s.try_cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))


def norm_currency(col) -> Column:
    """Currency code normalisation ($, C$, CA$ -> CAD; others upper-cased)."""
    s = F.upper(F.trim(_c(col).cast("string")))
    m = F.create_map(*[F.lit(x) for kv in CURRENCY_MAP.items() for x in kv])
    return F.coalesce(F.try_element_at(m, s), s)


def currency_token(col) -> Column:
    """Currency marker found in an amount text ('' when none)."""
    return F.regexp_extract(_c(col).cast("string"), r"(CA\$|C\$|CAD|USD|EUR|\$)", 1)
