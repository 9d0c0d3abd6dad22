"""Business key of a pay line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POST_DEFAULT = "N/A"


def business_key(pay_date, matricule, pay_code, post, cents, employer_cents) -> Column:
    """MD5 of date|number|code|post|cents|employer cents (NULL parts -> '' or '0')."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    parts = [
        F.coalesce(c(pay_date).cast("string"), F.lit("")),
        F.coalesce(c(matricule).cast("string"), F.lit("")),
        F.coalesce(c(pay_code).cast("string"), F.lit("")),
        F.coalesce(c(post).cast("string"), F.lit("")),
        F.coalesce(c(cents).cast("string"), F.lit("0")),
        F.coalesce(c(employer_cents).cast("string"), F.lit("0")),
    ]
    return F.md5(F.concat_ws("|", *parts))
