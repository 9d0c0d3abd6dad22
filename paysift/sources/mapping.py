"""Header normalisation and synonym mapping to canonical names.

Mapping is plan-only (a projection with aliases): no job runs until the data
is used. Headers are compared in a normalised form (lower case, accents
removed, spaces collapsed).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .payfile import CANONICAL, REQUIRED_FIELDS

# Header synonyms (file spelling and older spelling) per canonical name.
HEADER_SYNONYMS = {
    "numero_ligne": ["n de ligne", "no de ligne", "numero de ligne"],
    "categorie_emploi": ["categorie d'emploi", "categorie emploi"],
    "code_emploi": ["code emploi", "code emploie"],
    "titre_emploi": ["titre d'emploi", "titre emploi"],
    "date_paie": ["date de paie", "date paie"],
    "matricule": ["matricule", "no employe"],
    "nom_employe": ["employe", "nom et prenom", "nom prenom"],
    "categorie_paie": ["categorie de paie", "categorie paie"],
    "code_paie": ["code de paie", "code paie"],
    "description_code_paie": ["description du code de paie", "desc code de paie"],
    "poste_budgetaire": ["poste budgetaire"],
    "description_poste_budgetaire": ["description du poste budgetaire", "desc poste budgetaire"],
    "montant_employe": ["montant"],
    "part_employeur": ["part employeur"],
    "montant_combine": ["montant combine", "mnt/cmb"],
}


def norm_header(h: str) -> str:
    s = unicodedata.normalize("NFKD", str(h).lower())
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    return " ".join(s.replace(" ", " ").split())


def header_map(columns: list[str], synonyms: dict[str, list[str]] = HEADER_SYNONYMS,
               positional: bool = True) -> dict[str, str]:
    """Source column -> canonical name; positional fallback when a 15-column file has
    unmatched headers."""
    lookup = {norm_header(s): canon for canon, syns in synonyms.items() for s in syns}
    out = {}
    for c in columns:
        k = lookup.get(norm_header(c))
        if k and k not in out.values():
            out[c] = k
    data_cols = [c for c in columns if c != "source_file"]
    if positional and len(data_cols) == len(CANONICAL) and len(out) < len(CANONICAL):
        for c, canon in zip(data_cols, CANONICAL):
            if c not in out and canon not in out.values():
                out[c] = canon
    return out


def canonicalise_columns(df: DataFrame, synonyms: dict[str, list[str]] = HEADER_SYNONYMS,
                         positional: bool = True) -> DataFrame:
    """A3: rename mapped columns to canonical names; unmapped columns keep their name."""
    m = header_map(df.columns, synonyms, positional)
    return df.select([F.col(f"`{c}`").alias(m.get(c, c)) for c in df.columns])


def missing_required(df: DataFrame, required: list[str] = REQUIRED_FIELDS) -> list[str]:
    return [c for c in required if c not in df.columns]


def preflight(df: DataFrame, required: list[str] = CANONICAL) -> DataFrame:
    """A2: required columns present, at least one row and one month, date/amount parse shares.

    One aggregate pass; the column check is schema metadata (``array_except``)."""
    from paysift.functions.amounts import amount_to_decimal
    from paysift.functions.dates import WIDE_YEAR_HI, WIDE_YEAR_LO, parse_pay_date
    have = F.array(*[F.lit(c) for c in df.columns])
    need = F.array(*[F.lit(c) for c in required])
    d = parse_pay_date("date_paie", WIDE_YEAR_LO, WIDE_YEAR_HI) if "date_paie" in df.columns else F.lit(None)
    m = amount_to_decimal("montant_employe") if "montant_employe" in df.columns else F.lit(None)
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.date_format(d, "yyyy-MM")).alias("n_months"),
               F.count(d).alias("n_dates"), F.count(m).alias("n_amounts"))
    checks = a.select(
        F.array_join(F.array_sort(F.array_except(need, have)), ",").alias("missing_columns"),
        "n_rows", "n_months",
        F.round(F.col("n_dates") / F.col("n_rows"), 6).alias("date_ok_ratio"),
        F.round(F.col("n_amounts") / F.col("n_rows"), 6).alias("amount_ok_ratio"))
    return checks.withColumn("ok", (F.col("missing_columns") == "") & (F.col("n_rows") >= 1)
                             & (F.col("n_months") >= 1))
