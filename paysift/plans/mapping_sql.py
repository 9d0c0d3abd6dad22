"""DuckDB text of the mapping proposals C11 and C12, from the same registry values as the Spark expressions."""

from __future__ import annotations

from paysift.operators.profile import MIN_CONFIDENCE_ACCEPT, MIN_CONFIDENCE_WARN, VALIDATOR_PENALTY, _norm_py
from paysift.operators.registry import REGISTRY, VALUE_FIRST

from .sqltext import amount_cents, parse_date


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _regex(p: str) -> str:
    return _text(f"^(?:{p})$".replace("\\u202F", "\\x{202F}"))


def _patterns() -> list[str]:
    return list(dict.fromkeys(p for t in REGISTRY["types"].values() for d in t["detectors"] if d["kind"] == "pattern_any" for p in d["patterns"]))


def _allows() -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(d["allow"]) for t in REGISTRY["types"].values() for d in t["detectors"] if d["kind"] == "mask_dominance"))


def _mask(allow: tuple[str, ...]) -> str:
    literal = "".join("\\" + c for c in allow if c not in "A9")
    return (f"regexp_replace(regexp_replace(regexp_replace(value, {_text('[^\\pL\\p{Nd}' + literal + ']')}, '.', 'g'), '\\pL', 'A', 'g'), "
            "'\\p{Nd}', '9', 'g')")


def registry_ctes() -> str:
    """CTEs behind ``prof`` (the column profile): shares of the registry's patterns, and dominant masks."""
    pats = ", ".join(f"sum(CASE WHEN regexp_matches(value, {_regex(p)}) THEN cnt ELSE 0 END) AS pat{i}" for i, p in enumerate(_patterns()))
    masks = ",\n".join(f"""mask{i} AS (SELECT "column", round(n_mask / n, 6) AS cov, length(mask) AS len FROM (
  SELECT "column", mask, n_mask, sum(n_mask) OVER (PARTITION BY "column") AS n, row_number() OVER (PARTITION BY "column" ORDER BY n_mask DESC, mask) AS r
  FROM (SELECT "column", {_mask(a)} AS mask, sum(cnt) AS n_mask FROM vc GROUP BY 1, 2) m) x WHERE r = 1)""" for i, a in enumerate(_allows()))
    joins = " ".join(f'LEFT JOIN mask{i} m{i} ON m{i}."column" = p."column"' for i in range(len(_allows())))
    cols = ", ".join(f"m{i}.cov AS mask_cov{i}, m{i}.len AS mask_len{i}" for i in range(len(_allows())))
    return (f'pats AS (SELECT "column", {pats} FROM vc GROUP BY 1),\n{masks},\n'
            f'full_prof AS (SELECT p.*, x.* EXCLUDE ("column"), {cols} FROM prof p JOIN pats x ON x."column" = p."column" {joins})')


def _ratio(column: str, least: float) -> str:
    return f"(CASE WHEN {column} >= {least} THEN {column} ELSE {column} * 0.5 END)"


def _detector(d: dict) -> str:
    k = d["kind"]
    ratios = {"all_numeric_ratio": "numeric_ratio", "contains_comma_ratio": "comma_ratio", "alpha_token_ratio": "alpha_token_ratio",
              "date_parse_ratio": "date_ratio", "number_parse_ratio": "number_ratio"}
    if k in ratios:
        return _ratio(ratios[k], d["min_ratio"])
    if k == "mask_dominance":
        i = _allows().index(tuple(d["allow"]))
        good = f"mask_cov{i} >= {d['coverage_min']} AND 1 - mask_cov{i} <= {d['noise_max']}"
        return (f"(CASE WHEN NOT (mask_len{i} BETWEEN {d['min_len']} AND {d['max_len']}) THEN 0.0 WHEN {good} THEN mask_cov{i} ELSE mask_cov{i} * 0.5 END)")
    if k == "high_entropy_alpha":
        return f"((least(1.0, entropy / {d['min_entropy']}) + CASE WHEN most_common_ratio <= {d['max_const_ratio']} THEN 1.0 ELSE 0.0 END) / 2.0)"
    if k == "pattern_any":
        return "greatest(" + ", ".join(f"CAST(pat{_patterns().index(p)} AS DOUBLE) / n" for p in d["patterns"]) + ", 0.0)"
    if k == "low_cardinality_hint":
        m = d["max_uniques_ratio"]
        return f"(CASE WHEN unique_ratio <= {m} THEN 1 - unique_ratio / {m} * 0.5 ELSE 0.0 END)"
    if k == "avg_length_range":
        lo, hi = d["min_len"], d["max_len"]
        return (f"(CASE WHEN avg_len >= {lo} AND avg_len <= {hi} THEN 1.0 WHEN avg_len < {lo} THEN greatest(0.0, avg_len / {lo}) "
                f"ELSE greatest(0.0, 1 - (avg_len - {hi}) / {hi}) END)")
    return "0.0"  # declared kinds without an implementation


def _validator(v: dict) -> str:
    return {"uniqueness_hint": f"unique_ratio >= {v.get('min_uniques_ratio')}", "reject_constant": f"most_common_ratio <= {v.get('max_const_ratio')}",
            "high_entropy": f"entropy >= {v.get('min_entropy')}"}[v["kind"]]


def registry_scores() -> str:
    """C11: (type, priority, column, score)."""
    rows = []
    for name, t in REGISTRY["types"].items():
        total = " + ".join(["CAST(0.0 AS DOUBLE)", *(f"CAST({_detector(d)} AS DOUBLE) * CAST({d['weight']} AS DOUBLE)" for d in t["detectors"])])
        total = f"greatest(-1.0, least(1.0, {total}))"
        ok = " AND ".join(_validator(v) for v in t["validators"]) or "true"
        rows.append(f"""SELECT {_text(name)} AS type, {t['priority']} AS priority, "column", round(CASE WHEN {ok} THEN {total} ELSE {total} * {VALIDATOR_PENALTY} END, 6) AS score
  FROM full_prof""")
    return "\nUNION ALL ".join(rows)


def value_first_ctes(columns: list[str]) -> str:
    """Shares of the values of each column (blanks count) and whether its header is in a target's lexicon."""
    pat = VALUE_FIRST["patterns"]
    quoted = {c: '"' + c + '"' for c in columns}
    select = ", ".join(f"trim(coalesce(CAST({x} AS VARCHAR), '')) AS {x}" for x in quoted.values())

    def share(cond):
        return f"CAST(sum(CASE WHEN {cond} THEN cnt ELSE 0 END) AS DOUBLE) / sum(cnt)"
    lexicon = VALUE_FIRST["headers_lexicon"]
    heads = []
    for c in columns:
        flags = ", ".join("1.0" if any(_norm_py(k) and _norm_py(k) in _norm_py(c) for k in lexicon[t]) else "0.0" for t in VF_TARGETS)
        heads.append(f"({_text(c)}, {flags})")
    post = ", ".join(share(f"regexp_matches(value, {_regex(p)})") for p in pat["poste_budgetaire"])
    return f"""vfv AS (SELECT "column", value, count(*) AS cnt FROM (
    UNPIVOT (SELECT {select} FROM payfile) ON {', '.join(quoted.values())} INTO NAME "column" VALUE value) x GROUP BY 1, 2),
vfs AS (SELECT "column", {share(parse_date('value', 2000, 2050) + ' IS NOT NULL')} AS v_date, {share(amount_cents('value') + ' IS NOT NULL')} AS v_montant,
    {share(f"regexp_matches(value, {_regex(pat['matricule_digits'])})")} AS v_matricule, {share(f"regexp_matches(value, {_regex(pat['code_paie'])})")} AS v_code,
    greatest({post}) AS v_pb,
    {share(f"contains(value, {_text(pat['name_has_comma'])}) OR (len(regexp_split_to_array(value, '\\s+')) >= {pat['name_words_min']} AND value <> '')")} AS v_np,
    CAST(sum(CASE WHEN length(value) >= 10 THEN cnt ELSE 0 END) AS DOUBLE) / greatest(sum(CASE WHEN length(value) > 0 THEN cnt ELSE 0 END), 1) AS v_long
  FROM vfv GROUP BY 1),
vfh AS (SELECT * FROM (VALUES {', '.join(heads)}) AS h("column", {', '.join('h_' + t for t in VF_TARGETS)}))"""


VF_TARGETS = ("date", "montant", "matricule", "nom_prenom", "code_paie", "poste_budgetaire", "description_poste", "type_paie")


def value_first_scores() -> str:
    """(type, priority, column, score)."""
    wv, wh = VALUE_FIRST["weights"]["value_patterns"], VALUE_FIRST["weights"]["header"]
    value = {"date": "v_date", "montant": "v_montant", "matricule": "v_matricule", "nom_prenom": "v_np", "code_paie": "v_code", "poste_budgetaire": "v_pb",
             "description_poste": "v_long * (1 - v_montant) * (1 - v_code)"}
    rows = []
    for i, t in enumerate(VF_TARGETS):
        own = f"CAST({wv} AS DOUBLE) * ({value[t]}) + " if t in value else ""
        rows.append(f'SELECT {_text(t)} AS type, {-i} AS priority, s."column", round({own}CAST({wh} AS DOUBLE) * h_{t}, 6) AS score FROM vfs s JOIN vfh h ON h."column" = s."column"')
    return "\nUNION ALL ".join(rows)


def greedy(scores: str, accept: float = MIN_CONFIDENCE_ACCEPT, warn: float = MIN_CONFIDENCE_WARN) -> tuple[str, str]:
    """CTEs and SELECT of the greedy assignment over the table ``scores``: types by priority, each its best free column."""
    ctes = f"""ranked_types AS (SELECT type, row_number() OVER (ORDER BY priority DESC, type) AS k FROM (SELECT DISTINCT type, priority FROM {scores}) t),
steps AS (
  SELECT 0 AS k, []::VARCHAR[] AS taken, CAST(NULL AS VARCHAR) AS chosen
  UNION ALL
  SELECT k + 1, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c) END, c FROM (
    SELECT s.k, s.taken, (SELECT arg_min(x."column", (-x.score, x."column")) FROM {scores} x JOIN ranked_types r ON r.type = x.type
                          WHERE r.k = s.k + 1 AND x.score > 0 AND NOT list_contains(s.taken, x."column")) AS c
    FROM steps s WHERE s.k < (SELECT max(k) FROM ranked_types)) y),
alts AS (SELECT type, string_agg(printf('%s:%.3f', "column", score), ', ' ORDER BY score DESC, "column") AS alternatives
         FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, "column") AS p FROM {scores}) z WHERE p <= 3 GROUP BY 1)"""
    select = f"""SELECT r.type, s.chosen AS "column", CASE WHEN s.chosen IS NULL THEN 0.0 ELSE round(x.score, 3) END AS score,
  CASE WHEN s.chosen IS NULL THEN 'not_detected' WHEN round(x.score, 3) >= {accept} THEN 'accept' WHEN round(x.score, 3) >= {warn} THEN 'warn' ELSE 'low' END AS status,
  a.alternatives
FROM steps s JOIN ranked_types r ON r.k = s.k JOIN alts a ON a.type = r.type LEFT JOIN {scores} x ON x.type = r.type AND x."column" = s.chosen"""
    return ctes, select
