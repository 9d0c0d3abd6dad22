"""Employee numbers, names and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accent folding (lower-case Latin letters of French names).
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Placeholder names that mean "no name" (B14).
PLACEHOLDER_NAMES = ("nan", "nom", "prénom", "prenom", "none", "")
# Default labels.
LABEL_NA, LABEL_UNDEFINED, LABEL_UNCLASSED, LABEL_UNSPECIFIED = "N/A", "Non défini", "Non classé", "NON_SPECIFIE"
UNKNOWN_FIRST_NAME = "Inconnu"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_matricule(col) -> Column:
    """Noise (all but letters, digits and '-') out; all-digit numbers lose leading zeros ('000' -> '0', X28); upper-case."""
    s = F.regexp_replace(_c(col).cast("string"), "[^0-9A-Za-z-]", "")
    digits = s.rlike(r"^[0-9]+$")
    stripped = F.regexp_replace(s, r"^0+", "")
    return F.upper(F.when(digits, F.when(stripped == "", F.lit("0")).otherwise(stripped)).otherwise(s))


def norm_text(col) -> Column:
    """Lower-case, accents removed, spaces collapsed and trimmed."""
    s = F.translate(F.lower(_c(col).cast("string")), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def employee_key(mat, name) -> Column:
    """Normalised number, else MD5 of the normalised name (NULL only if both are NULL)."""
    m = F.nullif(norm_matricule(mat), F.lit(""))
    return F.coalesce(m, F.md5(norm_text(name)))


def split_fullname(col, mode: str = "comma") -> Column:
    """B11: 'Nom, Prénom' (comma) or last word / first word as the family name.

    Returns struct(nom, prenom, nom_norm, prenom_norm, nom_prenom); an empty
    first name becomes 'Inconnu' as in the reference.
    """
    raw = F.trim(_c(col).cast("string"))
    words = F.split(raw, r"\s+")
    n = F.size(words)
    if mode == "first_word":
        nom_w, pre_w = F.try_element_at(words, F.lit(1)), F.array_join(F.slice(words, 2, n), " ")
    else:
        nom_w, pre_w = F.try_element_at(words, F.lit(-1)), F.array_join(F.slice(words, 1, n - 1), " ")
    has_comma = raw.contains(",")
    nom = F.when(has_comma, F.trim(F.substring_index(raw, ",", 1))) \
        .when(n >= 2, nom_w).otherwise(raw)
    prenom = F.when(has_comma, F.trim(F.substring(raw, F.instr(raw, ",") + 1, F.length(raw)))) \
        .when(n >= 2, pre_w).otherwise(F.lit(""))
    return F.struct(
        nom.alias("nom"),
        F.when(prenom == "", F.lit(UNKNOWN_FIRST_NAME)).otherwise(prenom).alias("prenom"),
        norm_text(nom).alias("nom_norm"),
        F.when(prenom == "", F.lit(UNKNOWN_FIRST_NAME.lower())).otherwise(norm_text(prenom)).alias("prenom_norm"),
        raw.alias("nom_prenom"))


def clean_name(col) -> Column:
    """Placeholder names (nan, Nom, Prénom, blank) -> NULL."""
    s = F.trim(_c(col).cast("string"))
    return F.when(F.lower(s).isin(*PLACEHOLDER_NAMES) | s.isNull(), F.lit(None).cast("string")).otherwise(s)


def is_upper_name(col) -> Column:
    """Inactive flag = the name is fully upper-case and has a letter."""
    s = _c(col).cast("string")
    return F.coalesce((s == F.upper(s)) & s.rlike("[A-Za-z]"), F.lit(False))


def default_label(col, label: str = LABEL_UNDEFINED) -> Column:
    """blank/NULL -> a default label."""
    return F.coalesce(F.nullif(F.trim(_c(col).cast("string")), F.lit("")), F.lit(label))


# -------------------------------------------------------------------------------------
# Registry of text transforms; a chain is a left fold over the registry.
# -------------------------------------------------------------------------------------

def _title_keep_hyphen(s: Column) -> Column:
    parts = F.split(F.trim(s), "-")
    cap = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20))))
    return F.array_join(cap, "-")


TRANSFORMS = {
    "strip": lambda s: F.trim(s),
    "collapse_spaces": lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")),
    "upper": F.upper,
    "lower": F.lower,
    "title": lambda s: F.initcap(F.trim(s)),
    "title_keep_hyphen": _title_keep_hyphen,
    "sentence": lambda s: F.concat(F.upper(F.substring(F.trim(s), 1, 1)), F.substring(F.trim(s), 2, 1 << 20)),
    "drop_trailing_digit": lambda s: F.regexp_replace(F.trim(s), r"\s+\d+$", ""),
}


def apply_chain(col, kinds: list[str]) -> Column:
    s = F.coalesce(_c(col).cast("string"), F.lit(""))
    return reduce(lambda acc, k: TRANSFORMS[k](acc), kinds, s)


def apply_transforms(df, spec: dict[str, list[str]]):
    """Apply a transform chain per column (one projection, no UDF)."""
    return df.withColumns({c: apply_chain(c, kinds) for c, kinds in spec.items()})
