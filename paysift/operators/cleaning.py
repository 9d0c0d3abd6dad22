"""Table-level cleaning operators.

Column logic comes from ``paysift.functions``; these operators add the
table-wide parts: one-pass conditional aggregates for statistics, an unpivot
(``stack``) so per-column statistics are one group-by, and broadcast joins to
tiny policy tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.functions import dates as D
from paysift.functions.amounts import amount_to_cents
from paysift.functions.names import norm_text
from paysift.operators.lines import with_row_no

# Category-marker words that head blocks of a pay file.
MARKER_WORDS = ("gains", "deductions", "déductions", "deductions legales", "assurances", "syndicats",
                "total", "sous-total")
# Date-like column names.
DATE_NAME_RE = r"(?i)(date|jour|periode|période|day)"
INJECTION_RE = r"^[=+@|]"


def unpivot(df: DataFrame, cols: list[str], id_cols: list[str] | None = None) -> DataFrame:
    """(id..., column, value) rows for the given columns (values cast to string)."""
    ids = id_cols or []
    return df.unpivot(ids, cols, "column", "value") if ids else \
        df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")


def excel_origin(df: DataFrame, col: str, lo: int = D.YEAR_LO, hi: int = D.YEAR_HI) -> DataFrame:
    """Share of serial numbers that land in [lo, hi] under each origin; pick the larger."""
    s = F.trim(F.col(col).cast("string"))
    serial = s.rlike(D.SERIAL_RE)
    y1900 = F.year(D.serial_to_date(s, D.EXCEL_ORIGIN_1900))
    y1904 = F.year(D.serial_to_date(s, D.EXCEL_ORIGIN_1904))
    agg = df.agg(
        F.count_if(serial).alias("n_serial"),
        F.count_if(serial & y1900.between(lo, hi)).alias("_ok1900"),
        F.count_if(serial & y1904.between(lo, hi)).alias("_ok1904"))
    pct = lambda c: F.when(F.col("n_serial") > 0, F.round(F.col(c) * 100.0 / F.col("n_serial"), 6))
    return agg.select(
        "n_serial", pct("_ok1900").alias("pct_1900"), pct("_ok1904").alias("pct_1904"),
        F.when(F.col("_ok1904") > F.col("_ok1900"), F.lit("1904")).otherwise(F.lit("1900")).alias("system"))


def sanitise_dates(df: DataFrame, col: str, lo: int = D.YEAR_LO, hi: int = D.YEAR_HI) -> DataFrame:
    """Out-of-window dates -> NULL, with a flag for the rejected ones."""
    d = F.col(col)
    return df.withColumns({col: D.in_window(d, lo, hi),
                           f"{col}_rejected": d.isNotNull() & ~F.year(d).between(lo, hi)})


def date_stats(df: DataFrame, col: str) -> DataFrame:
    """Counts of total, valid and rejected dates."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(col).alias("valid"),
                  F.count_if(F.col(f"{col}_rejected")).alias("rejected"))


def date_column_report(df: DataFrame, cols: list[str], lo: int, hi: int) -> DataFrame:
    """Per date column: numeric / text / parsed / failed / final-valid counts and %."""
    u = unpivot(df, cols)
    v = F.trim(F.col("value"))
    parsed = D.parse_pay_date(v, lo, hi)
    agg = u.groupBy("column").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v.rlike(D.SERIAL_RE)).alias("numeric"),
        F.count_if(v.isNotNull() & ~v.rlike(D.SERIAL_RE)).alias("text"),
        F.count_if(parsed.isNotNull()).alias("parsed"),
        F.count_if(v.isNotNull() & parsed.isNull()).alias("failed"))
    return agg.withColumn("pct_valid", F.round(F.col("parsed") * 100.0 / F.col("total"), 6))


def detect_date_columns(df: DataFrame, cols: list[str], threshold: float = 0.6,
                        lo: int = D.WIDE_YEAR_LO, hi: int = D.WIDE_YEAR_HI) -> DataFrame:
    """A column is a date column by name, by type, or if >= threshold of values parse."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    u = unpivot(df, cols)
    ratio = u.groupBy("column").agg(
        F.round(F.avg(D.parse_pay_date(F.col("value"), lo, hi).isNotNull().cast("int")), 6).alias("ratio"))
    tmap = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    typ = F.try_element_at(tmap, F.col("column"))
    reason = (F.when(F.col("column").rlike(DATE_NAME_RE), F.lit("name"))
              .when(typ.isin("date", "timestamp", "timestamp_ntz"), F.lit("type"))
              .when(F.col("ratio") >= threshold, F.lit("values")))
    return ratio.select("column", reason.alias("reason"), "ratio", reason.isNotNull().alias("is_date"))


def drop_marker_rows(df: DataFrame, name_col: str, mat_col: str) -> DataFrame:
    """Drop category-marker rows and rows whose employee number is not all digits."""
    return df.filter(~norm_text(F.col(name_col)).isin(*MARKER_WORDS)
                     & F.trim(F.col(mat_col)).rlike(r"^\d+$"))


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop all-null rows, then all-null columns (one count pass decides the columns)."""
    rows = df.na.drop("all")
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
    keep = [c for c in rows.columns if counts[c] > 0]
    return rows.select(*keep)


def apply_sign_policy(lines: DataFrame, policy: DataFrame) -> DataFrame:
    """Multiply employee / employer amounts by the code's signs (default +1).

    The policy has one row per pay code (a catalogue), so it is broadcast.
    """
    p = F.broadcast(policy.select("pay_code", "employee_sign", "employer_sign"))
    return (lines.join(p, "pay_code", "left")
            .withColumn("amount_cents", F.col("amount_cents") * F.coalesce("employee_sign", F.lit(1)))
            .withColumn("employer_cents", F.col("employer_cents") * F.coalesce("employer_sign", F.lit(1)))
            .drop("employee_sign", "employer_sign"))


def pseudonymise(df: DataFrame, key: str, fmt: str = "E-%04d", name: str = "pseudo") -> DataFrame:
    """Stable pseudonym by rank of the distinct key.

    The rank runs over the distinct keys only, numbered by the range-sorted
    ordinal of ``with_row_no`` (no single-partition window), then joined back.
    """
    keys = with_row_no(df.select(key).distinct().filter(F.col(key).isNotNull()), [key], "_rk")
    ranked = keys.select(key, F.format_string(fmt, F.col("_rk")).alias(name))
    return df.join(ranked, key, "left")


def injection_report(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Per text column, number of cells starting with = + @ | (all rows)."""
    u = unpivot(df, text_cols)
    return u.filter(F.col("value").rlike(INJECTION_RE)).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_suspect"), F.min("value").alias("example"))


def fill_blanks(stg: DataFrame, ipm: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Blank columns of staging filled from the import table on (file, row)."""
    src = ipm.select(*keys, *[F.col(c).alias(f"_src_{c}") for c in cols])
    out = stg.join(src, keys, "left")
    return out.withColumns({
        c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.trim(F.col(f"_src_{c}"))) for c in cols
    }).drop(*[f"_src_{c}" for c in cols])


def convert_fields(raw: DataFrame, id_cols: list[str], amount_cols: list[str], date_cols: list[str],
                   lo: int = D.WIDE_YEAR_LO, hi: int = D.WIDE_YEAR_HI):
    """Tolerant conversion (NULL on failure) plus one alert row per failed cell.

    Returns (typed DataFrame, alerts DataFrame[id..., column, raw_value, alert_type]).
    """
    typed = raw.withColumns({**{f"{c}_cents": amount_to_cents(c) for c in amount_cols},
                             **{f"{c}_date": D.parse_pay_date(c, lo, hi) for c in date_cols}})
    checks = [(c, f"{c}_cents", "amount") for c in amount_cols] + [(c, f"{c}_date", "date") for c in date_cols]
    cells = F.array(*[F.when(F.col(src).isNotNull() & (F.trim(F.col(src)) != "") & F.col(dst).isNull(), F.struct(
        F.lit(src).alias("column"), F.col(src).cast("string").alias("raw_value"), F.lit(f"invalid_{kind}").alias("alert_type")))
        for src, dst, kind in checks])
    alerts = typed.select(*id_cols, F.explode(F.array_compact(cells)).alias("_a")).select(*id_cols, "_a.*")
    return typed, alerts
