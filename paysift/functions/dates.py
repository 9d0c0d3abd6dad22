"""Date text -> DATE.

Accepted shapes: ISO ``yyyy-MM-dd`` (prefix of a timestamp too), day-first
``dd/MM/yyyy`` / ``dd-MM-yyyy`` (X16: never month-first), the inverted
``yyyy-dd-MM`` repaired when the middle part is > 12 and the last <= 12 (B4),
and Excel serial numbers (B3). Out-of-window years become NULL (B5, X15).
Everything is ANSI-safe: parts are validated with regexes and built with
``try_to_date``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Excel origins (X14: 45897 -> 2025-08-28 with the 1900 system).
EXCEL_ORIGIN_1900 = "1899-12-30"
EXCEL_ORIGIN_1904 = "1904-01-01"
# Year window (X15) — reference default and the wide reading.
YEAR_LO, YEAR_HI = 2000, 2050
WIDE_YEAR_LO, WIDE_YEAR_HI = 1990, 2100

ISO_RE = r"^(\d{4})-(\d{2})-(\d{2})"
DMY_RE = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
SERIAL_RE = r"^\d{4,6}(\.0+)?$"
# yyyy-dd-MM with a middle part > 12 and a last part <= 12 -> swap the two parts
YDM_SWAP_RE = r"^(\d{4})-(1[3-9]|[2-9]\d)-(0\d|1[0-2])$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ymd(y: Column, m: Column, d: Column) -> Column:
    txt = F.format_string("%04d-%02d-%02d", y.try_cast("int"), m.try_cast("int"), d.try_cast("int"))
    return F.try_to_date(txt, "yyyy-MM-dd")


def fix_ydm(col) -> Column:
    """B4: 'yyyy-dd-MM' -> 'yyyy-MM-dd' when the middle part > 12 and the last <= 12."""
    s = F.trim(_c(col).cast("string"))
    y, a, b = (F.regexp_extract(s, ISO_RE, i) for i in (1, 2, 3))
    inverted = s.rlike(ISO_RE) & (a.try_cast("int") > 12) & (b.try_cast("int") <= 12)
    return F.when(inverted, F.concat_ws("-", y, b, a)).otherwise(s)


def serial_to_date(col, origin: str = EXCEL_ORIGIN_1900) -> Column:
    """Excel serial day number -> DATE with the given origin."""
    n = F.regexp_extract(_c(col).cast("string"), r"^(\d+)", 1).try_cast("int")
    return F.date_add(F.lit(origin).cast("date"), n)


def in_window(d: Column, lo: int = YEAR_LO, hi: int = YEAR_HI) -> Column:
    """Keep a date only when its year is in [lo, hi] (``d`` is referenced once)."""
    return F.try_element_at(F.filter(F.array(d), lambda x: F.year(x).between(lo, hi)), F.lit(1))


def parse_pay_date(col, lo: int = YEAR_LO, hi: int = YEAR_HI, serial_origin: str = EXCEL_ORIGIN_1900) -> Column:
    """B2 (+B3, B4, B5): any accepted date text -> DATE or NULL.

    Three cheap shape tests pick one parser: ISO prefix (the B4 repair of
    ``yyyy-dd-MM`` — middle part > 12 and last <= 12 — is one regex swap),
    day-first ``d/M/yyyy`` (either separator), or an Excel serial. Each value is
    parsed once by ``try_to_date`` with a fixed pattern (invalid dates -> NULL),
    and no sub-expression is duplicated, so the generated code stays small."""
    s = F.trim(_c(col).cast("string"))
    iso = F.regexp_replace(F.substring(s, 1, 10), YDM_SWAP_RE, "$1-$3-$2")
    d = (F.when(s.rlike(ISO_RE), F.try_to_date(iso, "yyyy-MM-dd"))
         .when(s.rlike(DMY_RE), F.try_to_date(F.translate(s, "-", "/"), "d/M/yyyy"))
         .when(s.rlike(SERIAL_RE), serial_to_date(s, serial_origin)))
    return in_window(d, lo, hi)


def is_numeric_text(col) -> Column:
    return F.trim(_c(col).cast("string")).rlike(r"^-?\d+(\.\d+)?$")
