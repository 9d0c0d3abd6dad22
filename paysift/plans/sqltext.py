"""Shared DuckDB fragments for the oracle texts (same definitions as the operators)."""

from __future__ import annotations


def cents(expr: str, alias: str) -> str:
    return f"CAST(SUM({expr}) AS BIGINT) AS {alias}"


def usd(col: str) -> str:
    return f"CAST({col} AS DOUBLE)/100.0"


CONTRACT_INNER = ",\n  ".join([
    cents("CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END", "_pos"),
    cents("CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END", "_neg"),
    cents("amount_cents", "_net"),
    cents("CASE WHEN amount_cents > 0 AND pay_code LIKE '%AJUST%' THEN amount_cents ELSE 0 END", "_adj"),
    cents("CASE WHEN amount_cents < 0 AND pay_code LIKE '%REMBOURSE%' THEN amount_cents ELSE 0 END", "_ref"),
])

NB_EMP_NONZERO = "COUNT(DISTINCT CASE WHEN amount_cents <> 0 THEN employee_id END) AS nb_employes"


def contract_outer(rate: str = "0.15") -> str:
    return ", ".join([
        f"{usd('_pos')} AS gains_brut", f"{usd('_neg')} AS deductions_net", f"{usd('_net')} AS net_a_payer",
        f"CAST(_pos AS DOUBLE)*{rate}/100.0 AS part_employeur",
        f"(CAST(_net AS DOUBLE) + CAST(_pos AS DOUBLE)*{rate})/100.0 AS cout_total",
        "-CAST(_neg AS DOUBLE)/100.0 AS cash_out_total", f"{usd('_adj')} AS ajustements_gains",
        f"{usd('_neg')} AS deductions_brutes", f"{usd('_ref')} AS remboursements",
    ])


DED = "('Deductions', 'Deductions_legales', 'Assurances', 'Syndicats')"

STAR_INNER = ",\n  ".join([
    "COUNT(*) AS nb_transactions",
    cents("CASE WHEN categorie_paie = 'Gains' AND amount_cents >= 0 THEN amount_cents ELSE 0 END", "_gains"),
    cents("CASE WHEN categorie_paie = 'Gains' AND amount_cents < 0 THEN abs(amount_cents) ELSE 0 END", "_adj"),
    cents(f"CASE WHEN categorie_paie IN {DED} THEN amount_cents ELSE 0 END", "_ded_net"),
    cents(f"CASE WHEN categorie_paie IN {DED} AND amount_cents < 0 THEN abs(amount_cents) ELSE 0 END",
          "_ded_brut"),
    cents(f"CASE WHEN categorie_paie IN {DED} AND amount_cents > 0 THEN amount_cents ELSE 0 END", "_refund"),
    cents("CASE WHEN categorie_paie = 'Deductions_legales' THEN amount_cents ELSE 0 END", "_legal"),
    cents("CASE WHEN categorie_paie = 'Assurances' THEN amount_cents ELSE 0 END", "_ins"),
    cents("CASE WHEN categorie_paie = 'Syndicats' THEN amount_cents ELSE 0 END", "_union"),
    cents("amount_cents", "_net"),
    cents("employer_cents", "_er"),
    cents("CASE WHEN categorie_paie = 'Gains' THEN amount_cents ELSE 0 END", "_gains_all"),
    "COUNT(*) FILTER (WHERE categorie_paie = 'Gains' AND amount_cents < 0) AS nb_ajustements",
    f"COUNT(*) FILTER (WHERE categorie_paie IN {DED} AND amount_cents > 0) AS nb_remboursements",
    "COUNT(DISTINCT employee_id) AS nb_employes",
])

STAR_OUTER = ", ".join([
    f"{usd('_gains')} AS gains_brut", f"{usd('_adj')} AS ajustements_gains",
    f"{usd('_ded_net')} AS deductions_net", f"{usd('_ded_brut')} AS deductions_brutes",
    f"{usd('_refund')} AS remboursements", f"{usd('_legal')} AS deductions_legales_net",
    f"{usd('_ins')} AS assurances_net", f"{usd('_union')} AS syndicats_net",
    f"{usd('_net')} AS net_a_payer", f"{usd('_er')} AS part_employeur",
    "CAST(_gains_all + _er AS DOUBLE)/100.0 AS cout_employeur_pnl",
    "CAST(_net + _er AS DOUBLE)/100.0 AS cash_out_total",
    "CAST(_net AS DOUBLE)/nullif(nb_employes, 0)/100.0 AS net_moyen_par_employe",
    "nb_ajustements", "nb_remboursements", "nb_employes", "nb_transactions",
])


# ---- cleaning twins (DuckDB) ----------------------------------------------------------

ISO_RE = r"^(\d{4})-(\d{2})-(\d{2})"
DMY_RE = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
SERIAL_RE = r"^\d{4,6}(\.0+)?$"


def amount_cents(x: str) -> str:
    s = f"trim({x})"
    neg = f"(starts_with({s}, '(') AND ends_with({s}, ')'))"
    s1 = f"(CASE WHEN {neg} THEN substr({s}, 2, length({s}) - 2) ELSE {s} END)"
    s2 = f"replace(replace(replace(translate({s1}, '\u00a0\u202f', ''), 'CAD', ''), 'CA', ''), '$', '')"
    s3 = f"regexp_replace({s2}, '\\s+', '', 'g')"
    s4 = (f"(CASE WHEN contains({s3}, '.') AND contains({s3}, ',') THEN replace(replace({s3}, '.', ''), ',', '.')"
          f" ELSE replace({s3}, ',', '.') END)")
    d = f"TRY_CAST({s4} AS DECIMAL(38,10))"
    return f"TRY_CAST(round((CASE WHEN {neg} THEN -{d} ELSE {d} END) * 100, 0) AS BIGINT)"


def fix_ydm(x: str) -> str:
    s = f"trim({x})"
    a, b, y = (f"regexp_extract({s}, '{ISO_RE}', {i})" for i in (2, 3, 1))
    return (f"(CASE WHEN regexp_matches({s}, '{ISO_RE}') AND TRY_CAST({a} AS INT) > 12 "
            f"AND TRY_CAST({b} AS INT) <= 12 THEN concat_ws('-', {y}, {b}, {a}) ELSE {s} END)")


def _ymd(y: str, m: str, d: str) -> str:
    return (f"CAST(try_strptime(printf('%04d-%02d-%02d', TRY_CAST({y} AS INT), TRY_CAST({m} AS INT), "
            f"TRY_CAST({d} AS INT)), '%Y-%m-%d') AS DATE)")


def serial_date(s: str, origin: str = "1899-12-30") -> str:
    return f"(DATE '{origin}' + TRY_CAST(regexp_extract({s}, '^(\\d+)', 1) AS INT))"


def parse_date(x: str, lo: int, hi: int) -> str:
    s = fix_ydm(x)
    iso = _ymd(*(f"regexp_extract({s}, '{ISO_RE}', {i})" for i in (1, 2, 3)))
    dd, mm, yy = (f"regexp_extract({s}, '{DMY_RE}', {i})" for i in (1, 2, 3))
    d = (f"(CASE WHEN regexp_matches({s}, '{ISO_RE}') THEN {iso} "
         f"WHEN regexp_matches({s}, '{DMY_RE}') THEN {_ymd(yy, mm, dd)} "
         f"WHEN regexp_matches({s}, '{SERIAL_RE}') THEN {serial_date(s)} END)")
    return f"(CASE WHEN year({d}) BETWEEN {lo} AND {hi} THEN {d} END)"


def norm_text(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '\\s+', ' ', 'g'))"


def norm_matricule(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9A-Za-z-]', '', 'g')"
    st = f"regexp_replace({s}, '^0+', '')"
    return f"upper(CASE WHEN regexp_matches({s}, '^[0-9]+$') THEN (CASE WHEN {st} = '' THEN '0' ELSE {st} END) ELSE {s} END)"
