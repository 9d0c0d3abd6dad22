"""Column profiling and schema proposal.

The reference profiles a 200-row sample in a Python list. Here whole columns
are profiled in one Spark job:

1. ``unpivot_values``: (column, value) rows for the chosen columns, trimmed,
   blanks dropped;
2. ``value_counts``: one group-by on (column, value) with map-side partial
   aggregation — the only shuffle of the raw data;
3. every per-value detector is evaluated once per *distinct* value and summed
   with the value's count, then reduced per column (``column_profile``).

Scores per (type, column) are expressions over the per-column profile
(metadata-sized: one row per column). Only the greedy assignment of C11/C12
runs on the driver, on the collected types x columns score matrix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.amounts import amount_to_decimal
from paysift.functions.dates import parse_pay_date
from paysift.functions.names import norm_text
from paysift.sources.sinks import stored

# Profiling thresholds of the registry UI.
MIN_CONFIDENCE_ACCEPT, MIN_CONFIDENCE_WARN = 0.70, 0.50
VALIDATOR_PENALTY = 0.3
TOKEN_RE = r"[\p{L}\p{N}_]+"
ALPHA_TOKEN_RE = r"^[A-Za-z]+$"


# ------------------------------------------------------------------------------- C1-C10

def unpivot_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) for the given columns; values trimmed, NULL and blank dropped."""
    s = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    u = s.unpivot([], cols, "column", "value")
    return u.select("column", F.trim("value").alias("value")).filter(F.col("value").isNotNull() & (F.col("value") != ""))


def value_counts(u: DataFrame) -> DataFrame:
    return u.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def mask_expr(v: Column, allow: tuple[str, ...] = ("A", "9")) -> Column:
    """Letters -> A, digits -> 9, allowed literal characters kept, anything else -> '.'."""
    lits = "".join("\\" + ch for ch in allow if ch not in ("A", "9"))
    keep = "\\p{L}" + "\\p{Nd}" + lits
    m = F.regexp_replace(v, f"[^{keep}]", ".")
    if "A" in allow:
        m = F.regexp_replace(m, r"\p{L}", "A")
    if "9" in allow:
        m = F.regexp_replace(m, r"\p{Nd}", "9")
    return m


def mask_profile(vc: DataFrame, allow: tuple[str, ...] = ("A", "9")) -> DataFrame:
    """Dominant mask per column with its count, coverage and noise."""
    return mask_profiles(vc, [allow]).drop("allow")


def mask_profiles(vc: DataFrame, allows: list[tuple[str, ...]]) -> DataFrame:
    """C1 for several sets of allowed characters (``allow``: their number) from one reading of the counts.

    The best mask and the total are plain aggregates over the masks' counts: no column's masks meet in one task."""
    each = F.array(*[F.struct(F.lit(i).alias("allow"), mask_expr(F.col("value"), a).alias("mask")) for i, a in enumerate(allows)])
    masks = vc.select("column", "cnt", F.explode(each).alias("_m")).groupBy("column", "_m.allow", "_m.mask").agg(F.sum("cnt").alias("n_mask"))
    dom = masks.groupBy("column", "allow").agg(F.min(F.struct((-F.col("n_mask")).alias("_n"), "mask")).alias("_b"), F.sum("n_mask").alias("n"))
    dom = dom.select("column", "allow", "_b.mask", (-F.col("_b._n")).alias("n_mask"), "n")
    return dom.select(
        "column", "mask", "n_mask", "n", F.round(F.col("n_mask") / F.col("n"), 6).alias("coverage"),
        F.round(1 - F.col("n_mask") / F.col("n"), 6).alias("noise"), F.length("mask").cast("long").alias("mask_len"), "allow")


def column_profile(vc: DataFrame, patterns: dict[str, str] | None = None,
                   date_window: tuple[int, int] = (2000, 2050), extra: list[Column] | None = None) -> DataFrame:
    """C2-C9 (+C5, C6): one row per column with all value statistics.

    Per-value flags are computed on distinct values and weighted by their
    count. Entropy and the most common value come from the same counts, in the
    same single aggregation, as do the ``extra`` aggregates.
    """
    v, cnt = F.col("value"), F.col("cnt")
    toks = F.regexp_extract_all(v, F.lit(TOKEN_RE), 0)
    flags = {
        "n_numeric": v.rlike(r"^[0-9]+$"),
        "n_comma": v.contains(","),
        "n_date": parse_pay_date(v, *date_window).isNotNull(),
        "n_number": amount_to_decimal(v).isNotNull(),
        "n_alpha_only": v.rlike(r"^[\p{L} '\-]+$"),
    }
    for name, rgx in (patterns or {}).items():
        flags[f"p_{name}"] = v.rlike(f"^(?:{rgx})$")
    weighted = [F.sum(F.when(c, cnt).otherwise(0)).cast("long").alias(k) for k, c in flags.items()]
    agg = vc.groupBy("column").agg(
        F.sum(cnt).cast("long").alias("n"), F.count(F.lit(1)).alias("n_unique"),
        F.max(cnt).alias("most_common_count"),
        F.min_by(v, F.struct(-cnt, v)).alias("most_common_value"),
        F.sum(cnt * F.size(toks)).cast("long").alias("n_tokens"),
        F.sum(cnt * F.size(F.filter(toks, lambda t: t.rlike(ALPHA_TOKEN_RE)))).cast("long").alias("n_alpha_tokens"),
        F.sum(cnt * F.length(v)).cast("long").alias("n_chars"),
        F.sum(cnt * F.length(F.regexp_replace(v, r"[^\p{L}]", ""))).cast("long").alias("n_letters"),
        F.sum(cnt * F.log2(cnt)).alias("_clogc"),
        *weighted, *(extra or []))
    # Shannon entropy from the same pass: H = log2(n) - sum(c * log2 c) / n
    out = agg.withColumn("entropy", F.log2(F.col("n")) - F.col("_clogc") / F.col("n")).drop("_clogc")
    n = F.col("n")
    return out.select(
        "*",
        F.round(F.col("n_unique") / n, 6).alias("unique_ratio"),
        F.round(F.col("most_common_count") / n, 6).alias("most_common_ratio"),
        F.round(F.col("n_numeric") / n, 6).alias("numeric_ratio"),
        F.round(F.col("n_comma") / n, 6).alias("comma_ratio"),
        F.round(F.when(F.col("n_tokens") > 0, F.col("n_alpha_tokens") / F.col("n_tokens")).otherwise(0.0), 6)
        .alias("alpha_token_ratio"),
        F.round(F.col("n_date") / n, 6).alias("date_ratio"),
        F.round(F.col("n_number") / n, 6).alias("number_ratio"),
        F.round(F.col("n_chars") / n, 6).alias("avg_len"),
        F.round(F.col("n_alpha_only") / n, 6).alias("alpha_only_ratio"),
        F.round(F.when(F.col("n_chars") > 0, F.col("n_letters") / F.col("n_chars")).otherwise(0.0), 6)
        .alias("alpha_ratio")).withColumn("entropy", F.round("entropy", 6))


def _ratio_rule(ratio: Column, min_ratio: float) -> Column:
    return F.when(ratio >= min_ratio, ratio).otherwise(ratio * 0.5)


def hint_scores(prof: DataFrame, max_uniques_ratio: float = 0.15, min_len: float = 0, max_len: float = 1000) -> DataFrame:
    """Low-cardinality hint and average-length-in-range score."""
    ur, al = F.col("unique_ratio"), F.col("avg_len")
    low = F.when(ur <= max_uniques_ratio, 1 - (ur / max_uniques_ratio) * 0.5).otherwise(0.0)
    length = _avg_len_score(al, min_len, max_len)
    return prof.select("column", F.round(low, 6).alias("low_cardinality"), F.round(length, 6).alias("avg_length_score"))


def _avg_len_score(al: Column, lo: float, hi: float) -> Column:
    below = F.greatest(F.lit(0.0), al / lo) if lo > 0 else F.lit(0.0)
    above = F.greatest(F.lit(0.0), 1 - (al - hi) / hi) if hi > 0 else F.lit(0.0)
    return F.when((al >= lo) & (al <= hi), F.lit(1.0)).when(al < lo, below).otherwise(above)


def validate_scores(prof: DataFrame, min_uniques_ratio: float = 0.30, max_const_ratio: float = 0.10,
                    min_entropy: float = 2.5) -> DataFrame:
    """Validator outcomes per column (uniqueness, reject-constant, minimum entropy)."""
    return prof.select(
        "column", (F.col("unique_ratio") >= min_uniques_ratio).alias("uniqueness_ok"),
        (F.col("most_common_ratio") <= max_const_ratio).alias("not_constant_ok"),
        (F.col("entropy") >= min_entropy).alias("entropy_ok"))


def pattern_ratio(prof: DataFrame, names: list[str]) -> DataFrame:
    """Best full-match share among several patterns (columns ``p_<name>`` of the profile)."""
    return prof.select("column", F.round(F.greatest(*[F.col(f"p_{n}") for n in names], F.lit(0)) / F.col("n"), 6)
                       .alias("pattern_ratio"))


# ------------------------------------------------------------------------------- C11-C13

def _kind_score(d: dict, extra: bool) -> Column:
    """Score expression of one registry detector over a profile row."""
    k = d["kind"]
    if k == "mask_dominance":
        cov = F.col(f"mask_cov_{_allow_key(d.get('allow', ['A', '9']))}")
        mlen = F.col(f"mask_len_{_allow_key(d.get('allow', ['A', '9']))}")
        ok_len = (mlen >= d.get("min_len", 1)) & (mlen <= d.get("max_len", 100))
        good = (cov >= d.get("coverage_min", 0.6)) & ((1 - cov) <= d.get("noise_max", 0.15))
        return F.when(~ok_len, F.lit(0.0)).when(good, cov).otherwise(cov * 0.5)
    if k == "all_numeric_ratio":
        return _ratio_rule(F.col("numeric_ratio"), d.get("min_ratio", 0.8))
    if k == "contains_comma_ratio":
        return _ratio_rule(F.col("comma_ratio"), d.get("min_ratio", 0.45))
    if k == "alpha_token_ratio":
        return _ratio_rule(F.col("alpha_token_ratio"), d.get("min_ratio", 0.8))
    if k == "high_entropy_alpha":
        me = d.get("min_entropy", 2.5)
        es = F.least(F.lit(1.0), F.col("entropy") / me) if me > 0 else F.lit(0.0)
        cs = F.when(F.col("most_common_ratio") <= d.get("max_const_ratio", 0.25), 1.0).otherwise(0.0)
        return (es + cs) / 2.0
    if k == "date_parse_ratio":
        return _ratio_rule(F.col("date_ratio"), d.get("min_ratio", 0.7))
    if k == "number_parse_ratio":
        return _ratio_rule(F.col("number_ratio"), d.get("min_ratio", 0.7))
    if k == "pattern_any":
        names = [_pat_name(p) for p in d.get("patterns", [])]
        return F.greatest(*[F.col(f"p_{n}") / F.col("n") for n in names], F.lit(0.0))
    if k == "low_cardinality_hint":
        m = d.get("max_uniques_ratio", 0.15)
        return F.when(F.col("unique_ratio") <= m, 1 - (F.col("unique_ratio") / m) * 0.5).otherwise(0.0)
    if k == "avg_length_range":
        return _avg_len_score(F.col("avg_len"), d.get("min_len", 0), d.get("max_len", 1000))
    if not extra:
        return F.lit(0.0)  # kinds without an implementation in the reference score 0
    return extra_detector(d)


def extra_detector(d: dict) -> Column:
    """The registry kinds the reference declares but does not implement."""
    k = d["kind"]
    if k == "penalize_comma":
        return F.col("comma_ratio") * d.get("penalty_per_comma", -0.4)
    if k == "alpha_only_ratio":
        return _ratio_rule(F.col("alpha_only_ratio"), d.get("min_ratio", 0.85))
    if k == "alpha_ratio":
        return _ratio_rule(F.col("alpha_ratio"), d.get("min_ratio", 0.7))
    if k in ("medium_entropy_alpha", "entropy_range"):
        e = F.col("entropy")
        return F.when((e >= d.get("min_entropy", 2.0)) & (e <= d.get("max_entropy", 4.0)), 1.0).otherwise(0.0)
    if k == "cardinality_range":
        u = F.col("unique_ratio")
        return F.when((u >= d.get("min_uniques_ratio", 0.0)) & (u <= d.get("max_uniques_ratio", 1.0)), 1.0) \
            .otherwise(0.0)
    if k in ("value_in_set", "value_in_set_fuzzy", "number_range_hint"):
        return F.least(F.lit(1.0), F.col(f"x_{_set_name(d)}") / F.col("n") / d.get("min_match_ratio",
                                                                                d.get("expected_ratio", 1.0)))
    return F.lit(0.0)


def _allow_key(allow) -> str:
    return "".join({"A": "a", "9": "d", "-": "h", "_": "u", ".": "p"}.get(c, "x") for c in allow)


_NUMBERS: dict[str, int] = {}


def _number(setting: str) -> int:
    """Number of a pattern or detector, by first use: the registry's order."""
    return _NUMBERS.setdefault(setting, len(_NUMBERS))


def _pat_name(p: str) -> str:
    return f"pattern_{_number(p)}"


def _set_name(d: dict) -> str:
    return f"set_{_number(repr(sorted(d.items())))}"


def registry_profile(df: DataFrame, cols: list[str], registry: dict) -> DataFrame:
    """Per-column profile with every statistic the registry's detectors need."""
    u = unpivot_values(df, cols)
    vc = stored(value_counts(u), "value-counts")  # read once for the profile and once for all masks
    pats = {}
    sets = {}
    allows = {("A", "9")}
    for t in registry["types"].values():
        for d in t.get("detectors", []):
            if d["kind"] == "pattern_any":
                for p in d.get("patterns", []):
                    pats[_pat_name(p)] = p
            if d["kind"] == "mask_dominance":
                allows.add(tuple(d.get("allow", ["A", "9"])))
            if d["kind"] in ("value_in_set", "value_in_set_fuzzy", "number_range_hint"):
                sets[_set_name(d)] = d
    v = F.col("value")
    exprs = []
    for name, d in sets.items():
        if d["kind"] == "number_range_hint":
            num = amount_to_decimal(v)
            c = num.between(d.get("min_val", 0), d.get("max_val", 1e18))
        elif d["kind"] == "value_in_set_fuzzy":
            c = norm_text(v).isin(*[_norm_py(x) for x in d.get("values", [])])
        else:
            c = F.upper(v).isin(*[x.upper() for x in d.get("values", [])])
        exprs.append(F.sum(F.when(c, F.col("cnt")).otherwise(0)).alias(f"x_{name}"))
    prof = column_profile(vc, pats, extra=exprs)
    allows = sorted(allows)
    of = lambda i, c: F.max(F.when(F.col("allow") == i, F.col(c)))  # noqa: E731  one row per column and set of characters
    masks = mask_profiles(vc, allows).groupBy("column").agg(*[of(i, c).alias(f"{n}_{_allow_key(a)}") for i, a in enumerate(allows)
                                                              for c, n in (("coverage", "mask_cov"), ("mask_len", "mask_len"))])
    return prof.join(masks, "column", "left")


def _norm_py(s: str) -> str:
    import unicodedata
    s = unicodedata.normalize("NFKD", s.lower())
    return " ".join("".join(ch for ch in s if not unicodedata.combining(ch)).split())


def score_matrix(prof: DataFrame, registry: dict, extra: bool = False) -> DataFrame:
    """C11 scores: (type, column, score) with clamp to [-1, 1] and the x0.3 validator penalty.

    All types are scored in one projection over the per-column profile and
    exploded, so the profile is computed once."""
    rows = []
    for name, t in registry["types"].items():
        if not t.get("visible", True):
            continue
        total = reduce(lambda a, b: a + b, [_kind_score(d, extra) * d.get("weight", 1.0)
                                            for d in t.get("detectors", [])], F.lit(0.0))
        total = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))
        ok = F.lit(True)
        for v in t.get("validators", []) or []:
            if v["kind"] == "uniqueness_hint":
                ok = ok & (F.col("unique_ratio") >= v.get("min_uniques_ratio", 0.3))
            elif v["kind"] == "reject_constant":
                ok = ok & (F.col("most_common_ratio") <= v.get("max_const_ratio", 0.1))
            elif v["kind"] == "high_entropy":
                ok = ok & (F.col("entropy") >= v.get("min_entropy", 2.5))
        score = F.round(F.when(ok, total).otherwise(total * VALIDATOR_PENALTY), 6)
        rows.append(F.struct(F.lit(name).alias("type"), F.lit(t.get("priority", 50)).alias("priority"),
                             score.alias("score")))
    return prof.select("column", F.explode(F.array(*rows)).alias("_s")).select(
        "_s.type", "_s.priority", "column", "_s.score")


def greedy_assign(scores: DataFrame, order_col: str = "priority", positive_only: bool = True,
                  accept: float = MIN_CONFIDENCE_ACCEPT, warn: float = MIN_CONFIDENCE_WARN):
    """Greedy assignment on the (types x columns) matrix, plus top-3 alternatives.

    The matrix has one row per (type, column): metadata-sized, so it is
    collected; the assignment itself is sequential by nature.
    """
    rows = scores.select("type", order_col, "column", "score").collect()
    spark = scores.sparkSession
    by_type: dict[str, list] = {}
    order: dict[str, float] = {}
    for r in rows:
        by_type.setdefault(r["type"], []).append((r["column"], float(r["score"])))
        order[r["type"]] = r[order_col]
    taken: set[str] = set()
    out = []
    for t in sorted(by_type, key=lambda x: (-order[x], x)):
        ranked = sorted(by_type[t], key=lambda x: (-x[1], x[0]))
        alts = ", ".join(f"{c}:{s:.3f}" for c, s in ranked[:3])
        chosen, conf = None, 0.0
        for c, s in ranked:
            if c not in taken and (s > 0 or not positive_only):
                chosen, conf = c, round(s, 3)
                taken.add(c)
                break
        status = "not_detected" if chosen is None else (
            "accept" if conf >= accept else "warn" if conf >= warn else "low")
        out.append((t, chosen, float(conf), status, alts))
    return spark.createDataFrame(out, "type string, column string, score double, status string, alternatives string")


# ------------------------------------------------------------------------------- C12

def value_first_scores(df: DataFrame, cols: list[str], cfg: dict) -> DataFrame:
    """Value-first scores per (target, column): 0.55 x value signal + 0.25 x header match.

    Values are unpivoted and counted once; every signal is evaluated on the
    distinct values and weighted by count. NULL cells count as '' in the
    denominators, as in the reference. Header matches are computed on the header
    names (driver-side metadata)."""
    pat = cfg["patterns"]
    s = df.select([F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in cols])
    vc = s.unpivot([], cols, "col", "value").groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt"))
    v, cnt = F.col("value"), F.col("cnt")

    def share(cond):
        return F.sum(F.when(cond, cnt).otherwise(0)) / F.sum(cnt)
    ln = F.length(v)
    stats = vc.groupBy("col").agg(
        share(parse_pay_date(v).isNotNull()).alias("v_date"),
        share(amount_to_decimal(v).isNotNull()).alias("v_montant"),
        share(v.rlike(f"^(?:{pat['matricule_digits']})$")).alias("v_matricule"),
        share(v.rlike(f"^(?:{pat['code_paie']})$")).alias("v_code"),
        F.greatest(*[share(v.rlike(f"^(?:{p})$")) for p in pat["poste_budgetaire"]]).alias("v_pb"),
        share(v.contains(pat["name_has_comma"]) | ((F.size(F.split(v, r"\s+")) >= pat["name_words_min"]) & (v != "")))
        .alias("v_np"),
        (F.sum(F.when(ln >= 10, cnt).otherwise(0)) / F.greatest(F.sum(F.when(ln > 0, cnt).otherwise(0)), F.lit(1)))
        .alias("v_long"))
    lex = cfg["headers_lexicon"]
    heads = []
    for c in cols:
        h = _norm_py(c)
        heads.append((c, *[1.0 if any(_norm_py(k) and _norm_py(k) in h for k in lex[t]) else 0.0
                           for t in ("date", "montant", "matricule", "nom_prenom", "code_paie", "poste_budgetaire",
                                     "description_poste", "type_paie")]))
    hdf = df.sparkSession.createDataFrame(heads, "col string, h_date double, h_montant double, h_matricule double, "
                                                 "h_nom_prenom double, h_code_paie double, h_poste_budgetaire double, "
                                                 "h_description_poste double, h_type_paie double")
    s = stats.join(F.broadcast(hdf), "col")
    wv, wh = cfg["weights"]["value_patterns"], cfg["weights"]["header"]
    desc = F.col("v_long") * (1 - F.col("v_montant")) * (1 - F.col("v_code"))
    targets = {
        "date": wv * F.col("v_date") + wh * F.col("h_date"),
        "montant": wv * F.col("v_montant") + wh * F.col("h_montant"),
        "matricule": wv * F.col("v_matricule") + wh * F.col("h_matricule"),
        "nom_prenom": wv * F.col("v_np") + wh * F.col("h_nom_prenom"),
        "code_paie": wv * F.col("v_code") + wh * F.col("h_code_paie"),
        "poste_budgetaire": wv * F.col("v_pb") + wh * F.col("h_poste_budgetaire"),
        "description_poste": wv * desc + wh * F.col("h_description_poste"),
        "type_paie": wh * F.col("h_type_paie"),
    }
    order = {t: -i for i, t in enumerate(targets)}
    rows = [F.struct(F.lit(t).alias("type"), F.lit(order[t]).alias("priority"), F.round(e, 6).alias("score"))
            for t, e in targets.items()]
    return s.select(F.col("col").alias("column"), F.explode(F.array(*rows)).alias("_s")).select(
        "_s.type", "_s.priority", "column", "_s.score")


# ------------------------------------------------------------------------------- C14-C17

def required_check(raw: DataFrame, required: list[str], optional: list[str], id_col: str = "numero_ligne") -> DataFrame:
    """C14: presence flags of required / optional fields per raw line."""
    def present(c):
        return F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "")
    req = reduce(lambda a, b: a & b, [present(c) for c in required])
    n_opt = reduce(lambda a, b: a + b, [present(c).cast("int") for c in optional])
    return raw.select(F.col(f"`{id_col}`").alias("numero_ligne"), req.alias("required_ok"),
                      n_opt.alias("optional_present"))


def tabularity(df: DataFrame, expected_cols: int = 10) -> DataFrame:
    """0.6 x (non-empty columns / expected, capped at 1) + 0.4 x cell density."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1))
                                                     .alias(f"_c{i}") for i, c in enumerate(cols)])
    non_empty = reduce(lambda a, b: a + b, [(F.col(f"_c{i}") > 0).cast("int") for i in range(len(cols))])
    cells = reduce(lambda a, b: a + b, [F.col(f"_c{i}") for i in range(len(cols))])
    density = cells / (F.col("_rows") * len(cols))
    score = 0.6 * F.least(F.lit(1.0), non_empty / expected_cols) + 0.4 * density
    return agg.select(non_empty.alias("non_empty_columns"), F.round(density, 6).alias("density"),
                      F.round(score, 6).alias("score"))


def first_lines(spark, path: str) -> DataFrame:
    """The first line of every text file under ``path``, distributed.

    The first line of a file is the first row of the split that starts at
    offset 0; inside a split, ``monotonically_increasing_id`` follows the line
    order, so ``min_by`` on (block start, id) picks it without reading a whole
    file into one row."""
    t = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_o"))
    return t.groupBy("file").agg(F.min_by("value", "_o").alias("header"))


def header_signatures(first: DataFrame, sep: str = ";") -> DataFrame:
    """signature = md5 of the sorted, normalised header names of each file."""
    names = F.transform(F.split(F.col("header"), sep), lambda x: F.lower(F.trim(x)))
    return first.select("file", F.md5(F.array_join(F.array_sort(names), "|")).alias("signature"))


def match_profiles(signatures: DataFrame, profiles: DataFrame) -> DataFrame:
    """Latest saved mapping profile per (client, signature) matched to each file; unmatched kept.

    Files that name their ``client`` only match profiles of that client; without
    a client column a file gets the latest profile of every client."""
    w = Window.partitionBy("client", "signature").orderBy(F.desc("updated_at"), F.desc("profile_id"))
    latest = profiles.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    keys = ["client", "signature"] if "client" in signatures.columns else ["signature"]
    return signatures.join(latest, keys, "left").withColumn("matched", F.col("profile_id").isNotNull())


def code_sign_profile(lines: DataFrame, code: str = "pay_code", amount: str = "amount_cents") -> DataFrame:
    """C17: per pay code, counts and sums of positive / negative / zero amounts and the likely class."""
    a = F.col(amount)
    agg = lines.groupBy(code).agg(
        F.count_if(a > 0).alias("n_pos"), F.count_if(a < 0).alias("n_neg"), F.count_if(a == 0).alias("n_zero"),
        F.sum(F.when(a > 0, a).otherwise(0)).cast("long").alias("sum_pos"),
        F.sum(F.when(a < 0, a).otherwise(0)).cast("long").alias("sum_neg"))
    cls = (F.when((F.col("n_pos") > 0) & (F.col("n_neg") == 0), F.lit("GAINS"))
           .when((F.col("n_neg") > 0) & (F.col("n_pos") == 0), F.lit("DÉDUCTIONS")).otherwise(F.lit("MIXTE")))
    return agg.withColumn("classe_probable", cls)
