"""Profiling queries C1-C17 and pay-file source queries (A2, A3) over the raw pay file."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.operators import profile as P
from paysift.operators import sketches as SKETCH
from paysift.operators.registry import REGISTRY, VALUE_FIRST
from paysift.sources import fixtures as fx
from paysift.sources.mapping import canonicalise_columns, preflight
from paysift.sources.payfile import FILE_HEADERS, OPTIONAL_FIELDS, REQUIRED_FIELDS, land_pay_file, raw_pay_file
from paysift.sources.sinks import stored, together, work_dir

from . import mapping_sql as MS
from .catalog import query
from .sqltext import amount_cents, parse_date, norm_text

PROFILED = [h for h in FILE_HEADERS]


def _fr(x):
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(abs({x}) // 100 AS VARCHAR) || ',' || "
            f"lpad(CAST(abs({x}) % 100 AS VARCHAR), 2, '0'))")


def q(name):
    return '"' + name.replace('"', '""') + '"'


PAYFILE_CTE = f"""payfile AS (
  SELECT CAST(l.source_row_no AS VARCHAR) AS {q('N de ligne')}, e.categorie_emploi AS {q("catégorie d'emploi")},
    CAST(NULL AS VARCHAR) AS {q('code emploi')}, e.titre_emploi AS {q("titre d'emploi")}, r.date_raw AS {q('date de paie')},
    e.matricule_raw AS {q('matricule')}, e.nom_complet AS {q('employé')}, l.categorie_paie AS {q('catégorie de paie')},
    l.pay_code AS {q('code de paie')}, c.label AS {q('description du code de paie')}, l.budget_post AS {q('poste budgétaire')},
    CAST(NULL AS VARCHAR) AS {q('description du poste budgétaire')}, r.montant_raw AS {q('montant')},
    {_fr('l.employer_cents')} AS {q('part employeur')}, {_fr('(l.amount_cents + l.employer_cents)')} AS {q('montant combiné')},
    l.source_file
  FROM ledger l JOIN raw_lines r ON r.source_row_no = l.source_row_no
  LEFT JOIN codes c ON c.pay_code = l.pay_code LEFT JOIN employees e ON e.employee_id = l.employee_id)"""

MASK = "regexp_replace(regexp_replace(regexp_replace(value, '[^\\pL\\p{{Nd}}]', '.', 'g'), '\\pL', 'A', 'g'), '\\p{{Nd}}', '9', 'g')"
DATE_PATTERNS = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{5}$"]

PROFILE_CTE = PAYFILE_CTE + f""",
u AS (
  SELECT "column", trim(value) AS value FROM (
    UNPIVOT (SELECT {', '.join(f'CAST({q(c)} AS VARCHAR) AS {q(c)}' for c in PROFILED)} FROM payfile)
    ON {', '.join(q(c) for c in PROFILED)} INTO NAME "column" VALUE value) x
  WHERE value IS NOT NULL AND trim(value) <> ''),
vc AS (SELECT "column", value, count(*) AS cnt FROM u GROUP BY 1, 2),
prof0 AS (
  SELECT "column", CAST(sum(cnt) AS BIGINT) AS n, count(*) AS n_unique, max(cnt) AS most_common_count,
    arg_min(value, (-cnt, value)) AS most_common_value,
    CAST(sum(cnt * len(regexp_extract_all(value, '[\\pL\\pN_]+'))) AS BIGINT) AS n_tokens,
    CAST(sum(cnt * len(list_filter(regexp_extract_all(value, '[\\pL\\pN_]+'), lambda t: regexp_matches(t, '^[A-Za-z]+$'))))
      AS BIGINT) AS n_alpha_tokens,
    CAST(sum(cnt * length(value)) AS BIGINT) AS n_chars,
    CAST(sum(cnt * length(regexp_replace(value, '[^\\pL]', '', 'g'))) AS BIGINT) AS n_letters,
    CAST(sum(CASE WHEN regexp_matches(value, '^[0-9]+$') THEN cnt ELSE 0 END) AS BIGINT) AS n_numeric,
    CAST(sum(CASE WHEN contains(value, ',') THEN cnt ELSE 0 END) AS BIGINT) AS n_comma,
    CAST(sum(CASE WHEN {parse_date('value', 2000, 2050)} IS NOT NULL THEN cnt ELSE 0 END) AS BIGINT) AS n_date,
    CAST(sum(CASE WHEN {amount_cents('value')} IS NOT NULL THEN cnt ELSE 0 END) AS BIGINT) AS n_number,
    CAST(sum(CASE WHEN regexp_matches(value, '^[\\pL ''\\-]+$') THEN cnt ELSE 0 END) AS BIGINT) AS n_alpha_only,
    {', '.join(f"CAST(sum(CASE WHEN regexp_matches(value, '^(?:{p})$') THEN cnt ELSE 0 END) AS BIGINT) AS p{i}"
               for i, p in enumerate(DATE_PATTERNS))},
    sum(cnt * log2(cnt)) AS _clogc
  FROM vc GROUP BY 1),
ent AS (SELECT "column", round(log2(n) - _clogc / n, 6) AS entropy FROM prof0),
prof AS (
  SELECT p.* EXCLUDE (_clogc), e.entropy, round(n_unique / n, 6) AS unique_ratio, round(most_common_count / n, 6) AS most_common_ratio,
    round(n_numeric / n, 6) AS numeric_ratio, round(n_comma / n, 6) AS comma_ratio,
    round(CASE WHEN n_tokens > 0 THEN n_alpha_tokens / n_tokens ELSE 0.0 END, 6) AS alpha_token_ratio,
    round(n_date / n, 6) AS date_ratio, round(n_number / n, 6) AS number_ratio, round(n_chars / n, 6) AS avg_len,
    round(n_alpha_only / n, 6) AS alpha_only_ratio,
    round(CASE WHEN n_chars > 0 THEN n_letters / n_chars ELSE 0.0 END, 6) AS alpha_ratio
  FROM prof0 p JOIN ent e ON e."column" = p."column")"""


def payfile(spark, sf):
    return raw_pay_file(spark, sf)


def _vc(spark, sf):
    return P.value_counts(P.unpivot_values(payfile(spark, sf), PROFILED))


def _pats():
    return {f"d{i}": p for i, p in enumerate(DATE_PATTERNS)}


def profile(spark, sf):
    return P.column_profile(_vc(spark, sf), _pats())


@query("c01_mask_profile", f"""
SELECT "column", mask, CAST(n_mask AS BIGINT) AS n_mask, CAST(n AS BIGINT) AS n, round(n_mask / n, 6) AS coverage, round(1 - n_mask / n, 6) AS noise,
  length(mask) AS mask_len FROM (
  SELECT "column", mask, n_mask, sum(n_mask) OVER (PARTITION BY "column") AS n,
    row_number() OVER (PARTITION BY "column" ORDER BY n_mask DESC, mask) AS r
  FROM (SELECT "column", {MASK} AS mask, sum(cnt) AS n_mask FROM vc GROUP BY 1, 2) m) x WHERE r = 1
""".replace("{{", "{").replace("}}", "}"), ctes=PROFILE_CTE)
def c01(spark, sf):
    return P.mask_profile(_vc(spark, sf))


@query("c02_numeric_ratio", 'SELECT "column", numeric_ratio FROM prof', ctes=PROFILE_CTE)
def c02(spark, sf):
    return profile(spark, sf).select("column", "numeric_ratio")


@query("c03_comma_ratio", 'SELECT "column", comma_ratio FROM prof', ctes=PROFILE_CTE)
def c03(spark, sf):
    return profile(spark, sf).select("column", "comma_ratio")


@query("c04_alpha_token_ratio", 'SELECT "column", n_tokens, n_alpha_tokens, alpha_token_ratio FROM prof', ctes=PROFILE_CTE)
def c04(spark, sf):
    return profile(spark, sf).select("column", "n_tokens", "n_alpha_tokens", "alpha_token_ratio")


@query("c05_entropy_profile", """
SELECT "column", entropy, round((least(1.0, entropy / 2.5) + CASE WHEN most_common_ratio <= 0.25 THEN 1.0 ELSE 0.0 END) / 2.0, 6)
  AS high_entropy_score FROM prof
""", ctes=PROFILE_CTE)
def c05(spark, sf):
    p = profile(spark, sf)
    s = (F.least(F.lit(1.0), F.col("entropy") / 2.5)
         + F.when(F.col("most_common_ratio") <= 0.25, 1.0).otherwise(0.0)) / 2.0
    return p.select("column", "entropy", F.round(s, 6).alias("high_entropy_score"))


@query("c06_cardinality_profile", """
SELECT "column", n, n_unique, unique_ratio, most_common_value, most_common_count, most_common_ratio FROM prof
""", ctes=PROFILE_CTE)
def c06(spark, sf):
    return profile(spark, sf).select("column", "n", "n_unique", "unique_ratio", "most_common_value",
                                     "most_common_count", "most_common_ratio")


@query("c06_sketch_profile", """
SELECT "column", n, true AS unique_within_4pct, true AS top_count_within_half_pct, true AS entropy_within_quarter_bit FROM prof
""", ctes=PROFILE_CTE)
def c06_sketches(spark, sf):
    """Sketches of every file stored, merged, and measured against the exact profile."""
    # the lines are derived once, and stored by file: a file's sketches are made by few tasks, not by each
    df, path = raw_pay_file(spark, sf, lambda lines: stored(together(lines, "pay_date"), "pay-lines")), work_dir(spark, "sketches")
    SKETCH.add_files(df, PROFILED, path)
    exact = P.column_profile(P.value_counts(P.unpivot_values(df, PROFILED)), _pats())
    e = SKETCH.sketch_error(SKETCH.stored_profile(spark, path), exact)
    return e.select("column", "n", (F.col("unique_error") <= 0.04).alias("unique_within_4pct"),
                    (F.col("top_error") <= 0.005).alias("top_count_within_half_pct"), (F.col("entropy_error") <= 0.25).alias("entropy_within_quarter_bit"))


@query("c07_parse_ratio", 'SELECT "column", date_ratio, number_ratio FROM prof', ctes=PROFILE_CTE)
def c07(spark, sf):
    return profile(spark, sf).select("column", "date_ratio", "number_ratio")


@query("c08_pattern_ratio", 'SELECT "column", round(greatest(p0, p1, p2, 0) / n, 6) AS pattern_ratio FROM prof',
       ctes=PROFILE_CTE)
def c08(spark, sf):
    return P.pattern_ratio(profile(spark, sf), ["d0", "d1", "d2"])


@query("c09_hint_scores", """
SELECT "column", round(CASE WHEN unique_ratio <= 0.15 THEN 1 - (unique_ratio / 0.15) * 0.5 ELSE 0.0 END, 6) AS low_cardinality,
  round(CASE WHEN avg_len >= 3 AND avg_len <= 40 THEN 1.0 WHEN avg_len < 3 THEN greatest(0.0, avg_len / 3)
             ELSE greatest(0.0, 1 - (avg_len - 40) / 40) END, 6) AS avg_length_score
FROM prof
""", ctes=PROFILE_CTE)
def c09(spark, sf):
    return P.hint_scores(profile(spark, sf), 0.15, 3, 40)


@query("c10_validate_scores", """
SELECT "column", unique_ratio >= 0.3 AS uniqueness_ok, most_common_ratio <= 0.1 AS not_constant_ok,
  entropy >= 2.5 AS entropy_ok FROM prof
""", ctes=PROFILE_CTE)
def c10(spark, sf):
    return P.validate_scores(profile(spark, sf))


C11_CTE = PROFILE_CTE + ",\n" + MS.registry_ctes() + ",\nscores AS MATERIALIZED (" + MS.registry_scores() + ")"
C11_STEPS, C11_SQL = MS.greedy("scores", REGISTRY["ui"]["min_confidence_accept"], REGISTRY["ui"]["min_confidence_warn"])
C12_CTE = PAYFILE_CTE + ",\n" + MS.value_first_ctes(PROFILED) + ",\nscores AS MATERIALIZED (" + MS.value_first_scores() + ")"
C12_STEPS, C12_SQL = MS.greedy("scores", VALUE_FIRST["thresholds"]["accept"], VALUE_FIRST["thresholds"]["warn"])


@query("c11_propose_mapping", C11_SQL, ctes=C11_CTE + ",\n" + C11_STEPS)
def c11(spark, sf):
    df = payfile(spark, sf)
    prof = P.registry_profile(df, PROFILED, REGISTRY)
    return P.greedy_assign(P.score_matrix(prof, REGISTRY), accept=REGISTRY["ui"]["min_confidence_accept"],
                           warn=REGISTRY["ui"]["min_confidence_warn"])


@query("c11_score_matrix", "SELECT * FROM scores", ctes=C11_CTE)
def c11m(spark, sf):
    return P.score_matrix(P.registry_profile(payfile(spark, sf), PROFILED, REGISTRY), REGISTRY)


@query("c12_propose_mapping_value_first", C12_SQL, ctes=C12_CTE + ",\n" + C12_STEPS)
def c12(spark, sf):
    scores = P.value_first_scores(payfile(spark, sf), PROFILED, VALUE_FIRST)
    return P.greedy_assign(scores, accept=VALUE_FIRST["thresholds"]["accept"],
                           warn=VALUE_FIRST["thresholds"]["warn"])


SET_DETECTORS = [{"kind": "value_in_set", "values": ["101", "450"], "min_match_ratio": 0.5},
                 {"kind": "value_in_set_fuzzy", "values": ["GAINS", "Syndicàts"], "min_match_ratio": 0.8},
                 {"kind": "number_range_hint", "min_val": 0, "max_val": 500, "expected_ratio": 0.9},
                 {"kind": "entropy_range", "min_entropy": 1.0, "max_entropy": 3.0}]


def _share(cond, ratio):
    return f"round(least(1.0, CAST(sum(CASE WHEN {cond} THEN cnt ELSE 0 END) AS DOUBLE) / max(p.n) / {ratio}), 6)"


@query("c13_set_detectors", f"""
SELECT vc."column", {_share("upper(vc.value) IN ('101', '450')", 0.5)} AS value_in_set,
  {_share(f"{norm_text('vc.value')} IN ('gains', 'syndicats')", 0.8)} AS value_in_set_fuzzy,
  {_share(f"coalesce({amount_cents('vc.value')} BETWEEN 0 AND 50000, false)", 0.9)} AS number_range_hint,
  CAST(CASE WHEN max(p.entropy) >= 1.0 AND max(p.entropy) <= 3.0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS entropy_range
FROM vc JOIN prof p ON p."column" = vc."column" GROUP BY vc."column"
""", ctes=PROFILE_CTE)
def c13s(spark, sf):
    p = P.registry_profile(payfile(spark, sf), PROFILED, {"types": {"x": {"detectors": SET_DETECTORS}}})
    return p.select("column", *[F.round(P.extra_detector(d).cast("double"), 6).alias(d["kind"]) for d in SET_DETECTORS])


@query("c13_extra_detectors", """
SELECT "column", alpha_only_ratio, alpha_ratio,
  CAST(CASE WHEN entropy >= 2.0 AND entropy <= 4.0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS medium_entropy,
  CAST(CASE WHEN unique_ratio >= 0.02 AND unique_ratio <= 0.2 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS cardinality_in_range,
  round(comma_ratio * -0.4, 6) AS comma_penalty
FROM prof
""", ctes=PROFILE_CTE)
def c13(spark, sf):
    p = profile(spark, sf)
    return p.select(
        "column", "alpha_only_ratio", "alpha_ratio",
        P.extra_detector({"kind": "medium_entropy_alpha", "min_entropy": 2.0, "max_entropy": 4.0}).alias("medium_entropy"),
        P.extra_detector({"kind": "cardinality_range", "min_uniques_ratio": 0.02, "max_uniques_ratio": 0.2})
        .alias("cardinality_in_range"),
        F.round(P.extra_detector({"kind": "penalize_comma", "penalty_per_comma": -0.4}), 6).alias("comma_penalty"))


def _present(c):
    return f"({q(c)} IS NOT NULL AND trim(CAST({q(c)} AS VARCHAR)) <> '')"


CANON_SELECT = ", ".join(f"{q(h)} AS {c}" for h, c in zip(FILE_HEADERS, [
    "numero_ligne", "categorie_emploi", "code_emploi", "titre_emploi", "date_paie", "matricule", "nom_employe",
    "categorie_paie", "code_paie", "description_code_paie", "poste_budgetaire", "description_poste_budgetaire",
    "montant_employe", "part_employeur", "montant_combine"]))


@query("c14_required_check", f"""
SELECT numero_ligne, {' AND '.join(f"({c} IS NOT NULL AND trim({c}) <> '')" for c in REQUIRED_FIELDS)} AS required_ok,
  {' + '.join(f"CAST(({c} IS NOT NULL AND trim({c}) <> '') AS INT)" for c in OPTIONAL_FIELDS)} AS optional_present
FROM (SELECT {CANON_SELECT} FROM payfile) x
""", ctes=PAYFILE_CTE)
def c14(spark, sf):
    canon = canonicalise_columns(payfile(spark, sf))
    return P.required_check(canon, REQUIRED_FIELDS, OPTIONAL_FIELDS)


@query("c15_tabularity", f"""
SELECT non_empty AS non_empty_columns, round(cells / (n_rows * {len(FILE_HEADERS) + 1}), 6) AS density,
  round(0.6 * least(1.0, non_empty / 10) + 0.4 * (cells / (n_rows * {len(FILE_HEADERS) + 1})), 6) AS score
FROM (SELECT count(*) AS n_rows,
        {' + '.join(f"CAST(count(CASE WHEN trim(CAST({q(c)} AS VARCHAR)) <> '' THEN 1 END) > 0 AS INT)"
                    for c in FILE_HEADERS + ['source_file'])} AS non_empty,
        {' + '.join(f"count(CASE WHEN trim(CAST({q(c)} AS VARCHAR)) <> '' THEN 1 END)" for c in FILE_HEADERS + ['source_file'])}
          AS cells
      FROM payfile) a
""", ctes=PAYFILE_CTE)
def c15(spark, sf):
    return P.tabularity(payfile(spark, sf))


@query("c17_code_sign_profile", """
SELECT pay_code, count(*) FILTER (WHERE amount_cents > 0) AS n_pos, count(*) FILTER (WHERE amount_cents < 0) AS n_neg,
  count(*) FILTER (WHERE amount_cents = 0) AS n_zero,
  CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS sum_pos,
  CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS sum_neg,
  CASE WHEN count(*) FILTER (WHERE amount_cents > 0) > 0 AND count(*) FILTER (WHERE amount_cents < 0) = 0 THEN 'GAINS'
       WHEN count(*) FILTER (WHERE amount_cents < 0) > 0 AND count(*) FILTER (WHERE amount_cents > 0) = 0 THEN 'DÉDUCTIONS'
       ELSE 'MIXTE' END AS classe_probable
FROM ledger GROUP BY pay_code
""")
def c17(spark, sf):
    return P.code_sign_profile(fx.ledger(spark, sf))


@query("a02_preflight", f"""
SELECT '' AS missing_columns, n_rows, n_months, round(n_dates / n_rows, 6) AS date_ok_ratio,
  round(n_amounts / n_rows, 6) AS amount_ok_ratio, n_rows >= 1 AND n_months >= 1 AS ok
FROM (SELECT count(*) AS n_rows, count(DISTINCT strftime({parse_date('date_paie', 1990, 2100)}, '%Y-%m')) AS n_months,
        count({parse_date('date_paie', 1990, 2100)}) AS n_dates,
        count({amount_cents('montant_employe')}) AS n_amounts
      FROM (SELECT {CANON_SELECT} FROM payfile) x) a
""", ctes=PAYFILE_CTE)
def a02(spark, sf):
    canon = canonicalise_columns(payfile(spark, sf)).drop("source_file")
    return preflight(canon)


@query("a03_canonicalise_columns", f"SELECT {CANON_SELECT}, source_file FROM payfile", ctes=PAYFILE_CTE)
def a03(spark, sf):
    return canonicalise_columns(payfile(spark, sf))


# Saved mapping profiles (client, header list, last update) for C16.
SAVED_PROFILES = [
    (1, "client_a", FILE_HEADERS, "2025-01-10 00:00:00"),
    (2, "client_a", FILE_HEADERS, "2025-06-01 00:00:00"),
    (3, "client_b", FILE_HEADERS[:5], "2025-03-01 00:00:00"),
]


def _profiles_df(spark):
    rows = [(i, c, ";".join(h), ts) for i, c, h, ts in SAVED_PROFILES]
    df = spark.createDataFrame(rows, "profile_id int, client string, header string, updated_at string")
    sig = P.header_signatures(df.withColumnRenamed("profile_id", "file"))
    return df.join(sig.withColumnRenamed("file", "profile_id"), "profile_id").select(
        "profile_id", "client", "signature", F.to_timestamp_ntz("updated_at").alias("updated_at"))


def _sig_sql(h):
    return f"md5(array_to_string(list_sort(list_transform(string_split({h}, ';'), lambda x: lower(trim(x)))), '|'))"


PROFILES_CTE = "saved AS (SELECT profile_id, client, " + _sig_sql("header") + """ AS signature,
    CAST(updated_at AS TIMESTAMP) AS updated_at
  FROM (VALUES """ + ", ".join(
    "({0}, '{1}', '{2}', '{3}')".format(i, c, ";".join(h).replace("'", "''"), ts) for i, c, h, ts in SAVED_PROFILES
) + ") AS v(profile_id, client, header, updated_at))"


@query("c16_match_profiles", f"""
SELECT f.source_file, f.signature, s.profile_id, s.client, s.updated_at, s.profile_id IS NOT NULL AS matched
FROM (SELECT DISTINCT source_file, {_sig_sql("'" + ";".join(FILE_HEADERS).replace("'", "''") + "'")} AS signature
      FROM payfile) f
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client, signature ORDER BY updated_at DESC, profile_id DESC) AS r
                          FROM saved) x WHERE r = 1) s ON s.signature = f.signature
""", ctes=PAYFILE_CTE + ",\n" + PROFILES_CTE)
def c16(spark, sf):
    landing = work_dir(spark, "c16-landing")
    land_pay_file(spark, sf, landing)
    sigs = P.header_signatures(P.first_lines(spark, landing)).select(
        F.regexp_extract("file", r"source_file=([^/]+)", 1).alias("source_file"), "signature").distinct()
    m = P.match_profiles(sigs, _profiles_df(spark))
    return m.select("source_file", "signature", "profile_id", "client", "updated_at", "matched")
