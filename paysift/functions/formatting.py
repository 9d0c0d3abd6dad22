"""Display formatting at the edge of reports: built-in ``format_number`` + text edits.

Fixed values: money uses a space as thousands separator, a point as decimal
mark, a leading '-' and a trailing ' $'; counts use U+202F as thousands
separator; percentages have one decimal and a trailing '%'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_fr(col) -> Column:
    x = _c(col).cast("double")
    body = F.replace(F.format_number(F.abs(x), 2), F.lit(","), F.lit(" "))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body, F.lit(" $"))


def number_fr(col) -> Column:
    return F.replace(F.format_number(_c(col).cast("long"), 0), F.lit(","), F.lit("\u202f"))


def percent_fr(col) -> Column:
    return F.concat(F.format_number(_c(col).cast("double"), 1).cast("string"), F.lit("%"))
