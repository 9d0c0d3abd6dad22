"""KPI engine, audits, comparisons and report tables.

Inputs are canonical lines (cents). The reference computes these for one
selected period in a single process; here every report is computed for all
periods at once with one group-by, and period-to-period logic runs on the small
per-period aggregate (a self join on the computed previous-month key, or a
window over the per-period rows). Top-n reports keep their limit because the
limit is the feature, with a unique tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.names import norm_text
from paysift.sources.sinks import stored

from .kpi import dollars, on_date
from .topk import exact_quantiles

# KPI-engine keywords, thresholds and codes.
OVERTIME_KEYWORDS = ("heures sup", "overtime", "hs", "heure sup", "temps supp")
RETIREMENT_KEYWORDS = ("retraite", "rrq", "reer", "pension", "401k", "retirement")
INVEST_KEYWORDS = ("invest", "épargne", "epargne", "reer", "celi", "tfsa", "placement")
SENSITIVE_CODES = ("401", "501", "701", "999")
ALERT_WARN, ALERT_CRIT = 10.0, 20.0
DED_ALERT_WARN, DED_ALERT_CRIT = 15.0, 25.0
TURNOVER_WARN, TURNOVER_CRIT = 10.0, 15.0
OVERTIME_ALERT = 20.0
TREND_NEUTRAL_PCT = 1.0
STABLE_NET_DOLLARS = 100.0
NEG_NET_DOLLARS = -0.01
PIVOT_CATEGORIES = ("Gains", "Deductions", "Deductions_legales", "Assurances", "Syndicats")
MAX_CATEGORIES = 1000
# Categories shown as negative amounts, by accent-free lower-case name.
DEDUCTION_NAME = "deductions"
NEGATED_CATEGORIES = (DEDUCTION_NAME, "assurances")
SALT_BUCKETS = 64
BUDGET_ALLOCATION_FACTOR = 1.10


def _m() -> Column:
    return F.col("montant_employe")


def period_col(c: str = "date_paie") -> Column:
    return F.date_format(c, "yyyy-MM")


def _kw(col: Column, words) -> Column:
    return F.lower(col.cast("string")).rlike("|".join(words))


def _trend(cur: Column, prev: Column) -> Column:
    d = (cur - prev) / prev * 100
    return (F.when(prev.isNull() | (prev == 0), F.lit("neutral"))
            .when(F.abs(d) < TREND_NEUTRAL_PCT, F.lit("neutral"))
            .when(d > 0, F.lit("up")).otherwise(F.lit("down")))


def _alert(cur: Column, prev: Column, warn: float, crit: float) -> Column:
    d = F.abs((cur - prev) / prev * 100)
    return (F.when(prev.isNull() | (prev == 0), F.lit("ok")).when(d >= crit, F.lit("critical"))
            .when(d >= warn, F.lit("warning")).otherwise(F.lit("ok")))


# ---------------------------------------------------------------------------- F35-F40

def attach_employee(per: DataFrame, emp: DataFrame) -> DataFrame:
    """Employee number and name joined onto a per-employee aggregate (LEFT: unknown ids keep NULLs).

    Report operators aggregate employee-free lines to (key, employee_id) first
    and join the employee table only to that much smaller table."""
    e = emp.select("employee_id", F.col("matricule_norm").alias("matricule"), F.col("nom_complet").alias("nom_employe"))
    return per.join(e, "employee_id", "left")


def _employee_counts(lines: DataFrame, emp: DataFrame | None, keys: list[str]) -> DataFrame:
    """Distinct employee numbers per ``keys`` (aggregate first when the lines carry no employee columns)."""
    if emp is None:
        return lines.groupBy(*keys).agg(F.countDistinct("matricule").alias("_e"))
    per = lines.select(*keys, "employee_id").distinct()
    return attach_employee(per, emp).groupBy(*keys).agg(F.countDistinct("matricule").alias("_e"))


def _per_matricule(lines: DataFrame, emp: DataFrame | None, keys: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` per (keys, employee number), aggregating per employee id before the join."""
    if emp is None:
        return lines.groupBy(*keys, "matricule").agg(F.sum(value).alias(name))
    per = lines.groupBy(*keys, "employee_id").agg(F.sum(value).alias(name))
    return attach_employee(per, emp).groupBy(*keys, "matricule").agg(F.sum(name).alias(name))



def monthly_kpis(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """Per month: mass, net, deductions, active headcount, employer cost, mean cost, overtime.

    With ``emp``, ``lines`` carry no employee columns: sums are taken per
    (month, employee id) first and the employee table is joined to that
    aggregate, not to every line."""
    hs = _kw(F.col("code_paie"), OVERTIME_KEYWORDS)
    sums = [F.sum(F.when(_m() >= 0, _m()).otherwise(0)).cast("long").alias("masse_cents"),
            F.sum(_m()).cast("long").alias("net_cents"),
            F.sum(F.when(_m() < 0, _m()).otherwise(0)).cast("long").alias("ded_cents"),
            F.sum("part_employeur").cast("long").alias("part_cents"),
            F.sum(F.when(hs, _m()).otherwise(0)).cast("long").alias("hs_cents"),
            F.count_if(hs).alias("hs_lines")]
    if emp is not None:
        per = lines.groupBy(period_col().alias("period"), "employee_id").agg(*sums)
        base, key = attach_employee(per, emp), F.col("period")
        sums = [F.sum(c).cast("long").alias(c) for c in
                ("masse_cents", "net_cents", "ded_cents", "part_cents", "hs_cents", "hs_lines")]
    else:
        base, key = lines, period_col().alias("period")
    inactive = (F.col("nom_employe") == F.upper("nom_employe")) & F.col("nom_employe").rlike("[A-Za-z]")
    return base.groupBy(key).agg(
        *sums,
        F.countDistinct(F.when(~F.coalesce(inactive, F.lit(False)), F.col("matricule"))).alias("effectifs"),
        F.countDistinct("matricule").alias("nb_employes"))


def _with_previous_month(m: DataFrame) -> DataFrame:
    """Join each month with the calendar-previous month (absent month -> NULL)."""
    prev_key = F.date_format(F.add_months(F.to_date(F.concat(F.col("period"), F.lit("-01"))), -1), "yyyy-MM")
    cur = m.withColumn("_prev", prev_key)
    p = m.select([F.col(c).alias(f"p_{c}") for c in m.columns])
    return cur.join(F.broadcast(p), cur["_prev"] == p["p_period"], "left")


def kpi_with_delta(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """Each KPI per month with the previous calendar month, delta %, trend, alert."""
    j = _with_previous_month(monthly_kpis(lines, emp))

    def usd(c):
        return F.col(c).cast("double") / 100.0

    def row(kpi_id, cur, prev, delta, trend, alert):
        return F.struct(F.lit(kpi_id).alias("kpi_id"), cur.alias("value"), prev.alias("previous"),
                        F.round(delta, 6).alias("delta_pct"), trend.alias("trend"), alert.alias("alert_level"))

    has_prev = F.col("p_period").isNotNull()
    masse, pmasse = usd("masse_cents"), usd("p_masse_cents")
    net, pnet = usd("net_cents"), usd("p_net_cents")
    ded, pded = F.abs(usd("ded_cents")), F.abs(usd("p_ded_cents"))
    cost, pcost = usd("masse_cents") + usd("part_cents"), usd("p_masse_cents") + usd("p_part_cents")
    avg = F.abs(net) / F.nullif(F.col("nb_employes"), F.lit(0))
    pavg = F.abs(pnet) / F.nullif(F.col("p_nb_employes"), F.lit(0))
    eff, peff = F.col("effectifs").cast("double"), F.col("p_effectifs").cast("double")
    hs, phs = usd("hs_cents"), usd("p_hs_cents")
    zero = F.lit(0.0)

    def pct(c, p, cond, denom=None):
        return F.when(has_prev & cond, (c - p) / (denom if denom is not None else p) * 100).otherwise(zero)

    ded_delta = pct(ded, pded, pded != 0)
    hs_ok = (phs != 0) & (F.col("hs_lines") > 0)
    hs_delta = pct(hs, phs, hs_ok, F.abs(phs))
    rows = F.array(
        row("masse_salariale", masse, pmasse, pct(masse, pmasse, pmasse > 0),
            F.when(has_prev & (pmasse > 0), _trend(masse, pmasse)).otherwise("neutral"),
            F.when(has_prev & (pmasse > 0), _alert(masse, pmasse, ALERT_WARN, ALERT_CRIT)).otherwise("ok")),
        row("salaire_net", net, pnet, pct(net, pnet, pnet != 0, F.abs(pnet)),
            F.when(has_prev & (pnet != 0), _trend(net, pnet)).otherwise("neutral"), F.lit("ok")),
        row("deductions", ded, pded, ded_delta,
            F.when(~has_prev | (pded == 0), F.lit("neutral")).when(ded_delta > 1, F.lit("down"))
            .when(ded_delta < -1, F.lit("up")).otherwise(F.lit("neutral")),
            F.when(has_prev & (pded != 0), _alert(ded, pded, DED_ALERT_WARN, DED_ALERT_CRIT)).otherwise("ok")),
        row("effectifs", eff, peff, pct(eff, peff, peff > 0),
            F.when(has_prev & (peff > 0), _trend(eff, peff)).otherwise("neutral"), F.lit("ok")),
        row("cout_employeur", cost, pcost, pct(cost, pcost, pcost > 0),
            F.when(has_prev & (pcost > 0), _trend(cost, pcost)).otherwise("neutral"), F.lit("ok")),
        row("cout_moyen", F.coalesce(avg, zero), pavg, pct(avg, pavg, pavg > 0),
            F.when(has_prev & (pavg > 0), _trend(avg, pavg)).otherwise("neutral"), F.lit("ok")),
        row("heures_sup", F.abs(hs), phs, hs_delta,
            F.when(has_prev & hs_ok, _trend(hs, phs)).otherwise("neutral"),
            F.when(has_prev & hs_ok & (hs_delta > OVERTIME_ALERT), F.lit("warning")).otherwise("ok")))
    return j.select("period", F.explode(rows).alias("k")).select("period", "k.*")


def turnover_rate(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """leavers / mean headcount vs the previous calendar month (10/15 % alerts).

    Employee presence is reduced to distinct (employee, month); a full outer
    join with the same set shifted by one month gives joiners and leavers.
    """
    if emp is not None:  # distinct (employee id, month) first, then the employee number
        ids = lines.select("employee_id", period_col().alias("period")).distinct()
        pres = attach_employee(ids, emp).select(F.col("matricule").alias("emp"), "period").distinct()
    else:
        pres = lines.select(F.col("matricule").alias("emp"), period_col().alias("period")).distinct()
    shifted = pres.select("emp", F.date_format(F.add_months(F.to_date(F.concat("period", F.lit("-01"))), 1),
                                               "yyyy-MM").alias("period"), F.lit(True).alias("_was"))
    months = pres.select("period").distinct()
    cur = pres.withColumn("_is", F.lit(True))
    j = cur.join(shifted, ["emp", "period"], "full_outer").join(F.broadcast(months), "period", "inner")
    agg = j.groupBy("period").agg(
        F.count_if(F.col("_is").isNotNull()).alias("n_current"),
        F.count_if(F.col("_was").isNotNull()).alias("n_previous"),
        F.count_if(F.col("_is").isNotNull() & F.col("_was").isNull()).alias("nouveaux"),
        F.count_if(F.col("_is").isNull() & F.col("_was").isNotNull()).alias("departs"))
    eff = (F.col("n_current") + F.col("n_previous")) / 2.0
    taux = F.when(eff > 0, F.col("departs") / eff * 100).otherwise(0.0)
    return agg.filter(F.col("n_previous") > 0).select(
        "period", "nouveaux", "departs", eff.alias("effectif_moyen"), F.round(taux, 6).alias("taux"),
        F.when(taux > TURNOVER_CRIT, F.lit("critical")).when(taux > TURNOVER_WARN, F.lit("warning"))
        .otherwise(F.lit("ok")).alias("alert_level"))


def kpi_history(deltas: DataFrame, n: int = 12) -> DataFrame:
    """each KPI over the last ``n`` months present (rank on the month list)."""
    months = deltas.select("period").distinct()
    last = months.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("period")))).filter(F.col("_r") <= n)
    return deltas.join(F.broadcast(last.select("period")), "period").select("period", "kpi_id", "value")


def kpi_alerts(deltas: DataFrame) -> DataFrame:
    """warning / critical KPI rows."""
    return deltas.filter(F.col("alert_level").isin("warning", "critical"))


# ---------------------------------------------------------------------------- F41-F47

def summary(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """rows, employees, net without meta rows, % of employees with negative net."""
    per_emp = _per_matricule(lines, emp, [], _m(), "_net")
    neg = per_emp.agg(F.round(F.avg((F.col("_net") < NEG_NET_DOLLARS * 100).cast("double")) * 100.0, 6)
                      .alias("neg_pct"), F.countDistinct("matricule").alias("employees"))
    tot = lines.agg(F.count(F.lit(1)).alias("rows"),
                    F.sum(F.when(F.col("montant_combine") != 0, _m()).otherwise(0)).cast("long").alias("_n"))
    return tot.crossJoin(neg).select("rows", "employees", dollars("_n").alias("net_total"), "neg_pct")


def negative_nets(lines: DataFrame, key: str = "date_paie", emp: DataFrame | None = None) -> DataFrame:
    """Per period and employee with net < -0.01 $ (X17 reading 1)."""
    per = _per_matricule(lines, emp, [key], _m(), "_net")
    return per.filter(F.col("_net") < -1).select(key, "matricule", dollars(F.col("_net").cast("long")).alias("net"))


def _names_by_date(lines: DataFrame, emp: DataFrame | None) -> DataFrame:
    """Distinct (date, employee name); per employee id first when the lines carry no employee columns."""
    if emp is None:
        return lines.select("date_paie", "nom_employe").distinct()
    ids = lines.select("date_paie", "employee_id").distinct()
    return attach_employee(ids, emp).select("date_paie", "nom_employe").distinct()


def audit_findings(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """findings per pay date: negative nets, upper-case names, sensitive codes."""
    neg = negative_nets(lines, emp=emp).groupBy("date_paie").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("rule", F.lit("nets_negatifs"))
    upper = _names_by_date(lines, emp).filter(
        (F.col("nom_employe") == F.upper("nom_employe")) & F.col("nom_employe").rlike("[A-Za-z]")) \
        .groupBy("date_paie").agg(F.countDistinct("nom_employe").alias("n")).withColumn("rule", F.lit("noms_majuscules"))
    sens = lines.filter(F.trim("code_paie").isin(*SENSITIVE_CODES)).groupBy("date_paie") \
        .agg(F.countDistinct("code_paie").alias("n")).withColumn("rule", F.lit("codes_sensibles"))
    return neg.unionByName(upper).unionByName(sens).select("date_paie", "rule", "n")


def anomalies(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """anomaly rows of the three detectors, one table (X18: always the union)."""
    neg = negative_nets(lines, emp=emp).select("date_paie", F.lit("Net négatif").alias("type"),
                                      F.col("matricule").alias("employe"), "net")
    upper = _names_by_date(lines, emp).filter(
        (F.col("nom_employe") == F.upper("nom_employe")) & F.col("nom_employe").rlike("[A-Za-z]")) \
        .select("date_paie", F.lit("Nom en MAJUSCULES").alias("type"), F.col("nom_employe").alias("employe")).distinct()
    sens = lines.filter(F.trim("code_paie").isin(*SENSITIVE_CODES)) \
        .select("date_paie", F.lit("Code sensible").alias("type"), F.col("code_paie").alias("code")).distinct()
    return neg.unionByName(upper, allowMissingColumns=True).unionByName(sens, allowMissingColumns=True)


def period_deltas_by(lines: DataFrame, dim: str) -> DataFrame:
    """per pay date and ``dim``, delta vs the previous existing pay date (FULL OUTER, X19:
    a side without the key counts 0 and is flagged)."""
    per = lines.groupBy("date_paie", dim).agg(F.sum(_m()).cast("long").alias("_c"))
    dates = lines.select("date_paie").distinct()
    nxt = dates.select(F.col("date_paie").alias("_pd"),
                       F.lead("date_paie").over(Window.orderBy("date_paie")).alias("date_paie")) \
        .filter(F.col("date_paie").isNotNull())
    prev_vals = per.select(F.col("date_paie").alias("_pd"), dim, F.col("_c").alias("_p")) \
        .join(F.broadcast(nxt), "_pd")
    cur = per.join(F.broadcast(nxt.select("date_paie", "_pd")), "date_paie")
    j = cur.join(prev_vals, ["date_paie", "_pd", dim], "full_outer")
    return j.select("date_paie", F.col("_pd").alias("date_precedente"), dim,
                    dollars(F.coalesce("_c", F.lit(0)) - F.coalesce("_p", F.lit(0))).alias("delta"),
                    F.col("_c").isNull().alias("absent_current"), F.col("_p").isNull().alias("absent_previous"))


def top_movers(deltas: DataFrame, dim: str, n: int = 5) -> DataFrame:
    """top n up and down movers per pay date.

    The n best are kept per (date, salt bucket) and then per date, for each
    direction by itself, so no task ranks all keys of a date."""
    salted = deltas.select("date_paie", dim, "delta", F.pmod(F.xxhash64(dim), F.lit(SALT_BUCKETS)).alias("_b"))

    def best(order: Column, up: bool) -> DataFrame:
        d = salted
        for parts in (["date_paie", "_b"], ["date_paie"]):
            w = Window.partitionBy(*parts).orderBy(order, dim)
            d = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
        return d.select("date_paie", dim, "delta", F.lit(up).alias("is_top_up"), F.lit(not up).alias("is_top_down"))

    return best(F.desc("delta"), True).unionByName(best(F.asc("delta"), False)).groupBy("date_paie", dim, "delta").agg(
        F.max("is_top_up").alias("is_top_up"), F.max("is_top_down").alias("is_top_down"))


def period_stats(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """per pay date: totals, headcount, mean and median net per employee (meta rows excluded).

    The median is exact and computed by ``exact_quantiles`` (no group in one task)."""
    tx = lines.filter(F.col("montant_combine") != 0)
    per_emp = _per_matricule(tx, emp, ["date_paie"], _m(), "_net")
    means = per_emp.groupBy("date_paie").agg((F.avg("_net") / 100.0).alias("net_moyen"))
    med = exact_quantiles(per_emp, ["date_paie"], "_net", [0.5])
    emp_stats = means.join(med.select("date_paie", F.col("n").alias("nb_employes"),
                                      (F.col("q_0") / 100.0).alias("net_median")), "date_paie")
    tot = tx.groupBy("date_paie").agg(F.sum(_m()).cast("long").alias("_n"),
                                      F.sum(F.when(_m() < 0, _m()).otherwise(0)).cast("long").alias("_d"))
    return tot.join(emp_stats, "date_paie").select(
        "date_paie", dollars("_n").alias("net_total"), dollars(F.col("_n") - F.col("_d")).alias("brut_total"),
        dollars("_d").alias("deductions_total"), "nb_employes", F.round("net_moyen", 6).alias("net_moyen"),
        F.round("net_median", 6).alias("net_median"))


def anomaly_set(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """per month: negative nets, inactive with gains, sensitive codes, new codes, post changes.

    New code = a code seen in this month and in no other month. Post change
    = the employee's first post this month differs from the last post of the
    other months (``min_by``/``max_by`` on the row order, not pandas order).
    The lines are read once: one aggregate per (month, employee) with its sums, first
    and last post and set of codes is written, and all five figures come from it.
    With ``emp`` (employee-free lines) the employee is the id, whose numbers and names
    are joined to that aggregate."""
    lp = lines.withColumn("period", period_col()).filter(F.col("montant_combine") != 0)
    order = F.struct("date_paie", "source_row_no")
    gain_line = (F.lower("categorie_paie") == "gains") & (_m() > 0)
    code = F.trim("code_paie")
    who = ["employee_id"] if emp is not None else ["matricule", "nom_employe"]
    ids = stored(lp.groupBy("period", *who).agg(
        F.sum(_m()).alias("_n"), F.min(order).alias("_fk"), F.min_by("poste_budgetaire", order).alias("_first"),
        F.max(order).alias("_lk"), F.max_by("poste_budgetaire", order).alias("_last"), F.max(gain_line.cast("int")).alias("_gain"),
        F.collect_set(F.struct(code.alias("c"), F.when(code.isin(*SENSITIVE_CODES), F.col("code_paie")).alias("s"))).alias("_codes")), "anomaly-ids")
    named = attach_employee(ids, emp) if emp is not None else ids
    per = named.groupBy("period", "matricule").agg(
        F.sum("_n").alias("_n"), F.min("_fk").alias("_fk"), F.min_by("_first", "_fk").alias("_first"),
        F.max("_lk").alias("_lk"), F.max_by("_last", "_lk").alias("_last"))
    gainers = named.filter(F.col("_gain") == 1).select("period", "nom_employe")
    codes = ids.select("period", F.explode("_codes").alias("_c")).select("period", "_c.*").distinct()
    neg = per.filter(F.col("_n") < -1).groupBy("period").agg(F.count(F.lit(1)).alias("nets_negatifs"))
    inactive = (F.col("nom_employe") == F.upper("nom_employe")) & F.col("nom_employe").rlike("[A-Za-z]")
    inact = gainers.filter(inactive).groupBy("period").agg(F.countDistinct("nom_employe").alias("inactifs_avec_gains"))
    # every line has a code entry, null codes too, so this is every month
    months = codes.groupBy("period").agg(F.countDistinct("s").alias("codes_sensibles"))
    single = codes.select("c", "period").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("_k"), F.first("period").alias("period")) \
        .filter(F.col("_k") == 1)
    new_codes = single.groupBy("period").agg(F.count(F.lit(1)).alias("nouveaux_codes"))
    w = Window.partitionBy("matricule").orderBy(F.desc("_lk"))
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per.withColumn("_rk", F.row_number().over(w)) \
        .withColumn("_top", F.first("_last").over(full)).withColumn("_second", F.nth_value("_last", 2).over(full))
    other_last = F.when(F.col("_rk") == 1, F.col("_second")).otherwise(F.col("_top"))
    changes = ranked.filter(other_last.isNotNull() & (F.col("_first") != other_last)) \
        .groupBy("period").agg(F.count(F.lit(1)).alias("changements_poste"))
    out = reduce(lambda a, b: a.join(b, "period", "left"), [months, neg, inact, new_codes, changes])
    cols = ["period", "nets_negatifs", "inactifs_avec_gains", "codes_sensibles", "nouveaux_codes", "changements_poste"]
    return out.na.fill(0, cols[1:]).select(*cols)


def period_tendency(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """each pay date vs the previous existing one: deltas, tendency (±100 $), %."""
    tx = lines.filter(F.col("montant_combine") != 0)
    per = tx.groupBy("date_paie").agg(F.sum(_m()).cast("long").alias("_n"),
                                      F.sum(F.when(_m() < 0, _m()).otherwise(0)).cast("long").alias("_d"))
    per = per.join(_employee_counts(tx, emp, ["date_paie"]), "date_paie", "left")
    w = Window.orderBy("date_paie")
    p = per.select("date_paie", "_n", "_d", "_e", F.lag("date_paie").over(w).alias("period_precedente"),
                   F.lag("_n").over(w).alias("_pn"), F.lag("_d").over(w).alias("_pd"), F.lag("_e").over(w).alias("_pe"))
    dn = dollars(F.col("_n") - F.col("_pn"))
    return p.filter(F.col("period_precedente").isNotNull()).select(
        "date_paie", "period_precedente", dn.alias("delta_net"),
        dollars(F.col("_d") - F.col("_pd")).alias("delta_deductions"),
        (F.col("_e") - F.col("_pe")).alias("delta_effectif"),
        F.when(F.abs(dn) < STABLE_NET_DOLLARS, F.lit("stable")).when(dn > 0, F.lit("hausse"))
        .otherwise(F.lit("baisse")).alias("tendance"),
        F.when(F.col("_pn") != 0, F.round((F.col("_n") - F.col("_pn")) / F.abs(F.col("_pn")) * 100.0, 6))
        .otherwise(F.lit(0.0)).alias("pct_variation"))


def report_summary(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """month summary indicators per pay date, unpivoted (indicator, value)."""
    agg = lines.groupBy("date_paie").agg(F.sum(_m()).cast("long").alias("_n"),
                                         F.sum(F.when(_m() < 0, _m()).otherwise(0)).cast("long").alias("_d"))
    agg = agg.join(_employee_counts(lines, emp, ["date_paie"]), "date_paie", "left")
    v = agg.select("date_paie", dollars("_n").alias("a"), dollars(F.col("_n") - F.col("_d")).alias("b"),
                   dollars("_d").alias("c"), F.col("_e").cast("double").alias("d"),
                   (dollars("_n") / F.nullif(F.col("_e"), F.lit(0))).alias("e"))
    return v.select("date_paie", F.expr(
        "stack(5, 'Net total', a, 'Brut total', b, 'Déductions', c, 'Nb employés', d, 'Net moyen', e) "
        "AS (indicateur, valeur)"))


def _in_net(category: Column) -> Column:
    return (category == "Gains") | (norm_text(category) == DEDUCTION_NAME)


def report_employee_rows(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """F48 as rows: (date, employee, category, amount, net of the employee on that date), for any number of categories.

    Deductions and insurance are negative; the net is gains plus deductions, in every spelling of
    their name (``Déductions``, ``DEDUCTIONS``). A null category is 'N/A'. With ``emp``
    (employee-free lines), sums are taken per (date, employee id, category) before
    the employee number and name are joined."""
    category = F.coalesce("categorie_paie", F.lit("N/A"))
    if emp is not None:
        per = lines.groupBy("date_paie", "employee_id", category.alias("categorie")).agg(F.sum(_m()).cast("long").alias("_s"))
        base, val = attach_employee(per, emp), F.col("_s")
    else:
        base, val = lines.withColumn("categorie", category), _m()
    keys = ["date_paie", "matricule", "nom_employe"]
    per = base.groupBy(*keys, "categorie").agg(F.sum(val).cast("long").alias("_c"))
    signed = per.withColumn("_c", F.when(norm_text(F.col("categorie")).isin(*NEGATED_CATEGORIES), -F.abs("_c")).otherwise(F.col("_c")))
    net = F.sum(F.when(_in_net(F.col("categorie")), F.col("_c")).otherwise(0)).over(Window.partitionBy(*keys))
    return signed.select(*keys, "categorie", dollars("_c").alias("montant"), dollars(net).alias("Net"))


def report_employee_pivot(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """employee x pay category pivot over every category of the data, deductions negative, net.

    The rows of ``report_employee_rows`` with a column for each category (one for
    names that differ in case only, as columns do); the usual ones are always
    present. Column names have to be known first: the distinct categories are read,
    and if there are more than ``MAX_CATEGORIES`` the unusual ones come as one map
    column ``autres`` (category to amount), none is left out."""
    category = F.coalesce("categorie_paie", F.lit("N/A"))
    found = [r[0] for r in lines.select(category.alias("c")).distinct().limit(MAX_CATEGORIES + 1).collect()]
    columns = {c.lower(): c for c in PIVOT_CATEGORIES}
    unusual = ~F.lower("categorie").isin(*columns)
    if len(found) <= MAX_CATEGORIES:
        for c in sorted(found):
            columns.setdefault(c.lower(), c)
    cents = F.round(F.col("montant") * 100).cast("long")
    cells = [dollars(F.coalesce(F.sum(F.when(F.lower("categorie") == k, cents)), F.lit(0))).alias(c) for k, c in columns.items()]
    if len(found) > MAX_CATEGORIES:
        cells.append(F.map_from_entries(F.array_sort(F.collect_list(F.when(unusual, F.struct("categorie", "montant"))))).alias("autres"))
    return report_employee_rows(lines, emp).groupBy("date_paie", "matricule", "nom_employe").agg(*cells, F.max("Net").alias("Net"))


def report_by_code(lines: DataFrame) -> DataFrame:
    """distribution by code per pay date."""
    return lines.groupBy("date_paie", "code_paie", "description_code_paie").agg(
        dollars(F.sum(_m())).alias("montant"))


def report_by_post(lines: DataFrame) -> DataFrame:
    """distribution by budget post per pay date."""
    return lines.groupBy("date_paie", "poste_budgetaire").agg(dollars(F.sum(_m())).alias("montant"))


def evolution(lines: DataFrame, n: int = 12) -> DataFrame:
    """net total of the last ``n`` months."""
    per = lines.groupBy(period_col().alias("period")).agg(F.sum(_m()).cast("long").alias("_n"))
    w = Window.orderBy(F.desc("period"))
    return per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(
        "period", dollars("_n").alias("net_total"))


# ---------------------------------------------------------------------------- F51-F64

def dashboard_series(tx: DataFrame, until=None, n: int = 30) -> DataFrame:
    """last ``n`` pay dates <= ``until`` (default the latest): mass, net, transactions."""
    lim = tx.agg(F.max("pay_date")).scalar() if until is None else F.lit(until).cast("date")
    a = F.col("amount_cents")
    per = tx.filter(F.col("pay_date") <= lim).groupBy("pay_date").agg(
        F.sum(F.when(a > 0, a).otherwise(0)).cast("long").alias("_m"), F.sum(a).cast("long").alias("_n"),
        F.count(F.lit(1)).alias("transactions"))
    return per.orderBy(F.desc("pay_date")).limit(n).select(
        "pay_date", dollars("_m").alias("masse"), dollars("_n").alias("net"), "transactions")


def top_by_abs(lines: DataFrame, dim: list[str], n: int = 10, at=None) -> DataFrame:
    """top ``n`` of ``dim`` by |total| for one pay date (default the latest)."""
    d = lines.agg(F.max("date_paie")).scalar() if at is None else F.lit(at).cast("date")
    per = lines.filter(F.col("date_paie") == d).groupBy(*dim).agg(F.sum(_m()).cast("long").alias("_t"))
    return per.orderBy(F.desc(F.abs("_t")), *dim).limit(n).select(*dim, dollars("_t").alias("total"))


def distribution(lines: DataFrame, cat: str, n: int = 8) -> DataFrame:
    """top ``n`` categories by total (descending, tie on the label)."""
    per = lines.groupBy(cat).agg(F.sum(_m()).cast("long").alias("_t"))
    return per.orderBy(F.desc("_t"), cat).limit(n).select(cat, dollars("_t").alias("total"))


def keyword_totals(lines: DataFrame, cat: str = "description_code_paie") -> DataFrame:
    """retirement (total, mean per line, top 10 employees) and investment totals."""
    ret = lines.filter(_kw(F.col(cat), RETIREMENT_KEYWORDS))
    inv = lines.filter(_kw(F.col(cat), INVEST_KEYWORDS))
    r = ret.agg(F.lit("retraite").alias("theme"), F.abs(dollars(F.sum(_m()))).alias("total"),
                F.abs(F.avg(_m()) / 100.0).alias("average"), F.count(F.lit(1)).alias("n_lines"))
    i = inv.agg(F.lit("investissement").alias("theme"), F.abs(dollars(F.sum(_m()))).alias("total"),
                F.abs(F.avg(_m()) / 100.0).alias("average"), F.count(F.lit(1)).alias("n_lines"))
    return r.unionByName(i).select("theme", F.coalesce("total", F.lit(0.0)).alias("total"),
                                   F.round(F.coalesce("average", F.lit(0.0)), 6).alias("average"), "n_lines")


def retirement_top_employees(lines: DataFrame, cat: str = "description_code_paie", n: int = 10) -> DataFrame:
    """top ``n`` employees by |retirement amount|."""
    per = lines.filter(_kw(F.col(cat), RETIREMENT_KEYWORDS)).groupBy("matricule").agg(
        F.abs(F.sum(_m())).cast("long").alias("_a"))
    return per.orderBy(F.desc("_a"), "matricule").limit(n).select("matricule", dollars("_a").alias("amount"))


def budget_vs_actual(lines: DataFrame, budget: DataFrame | None = None) -> DataFrame:
    """spent per post; allocated from a budget table, else 110 % of spent."""
    spent = lines.groupBy("poste_budgetaire").agg(F.abs(F.sum(_m())).cast("long").alias("_s"))
    if budget is not None:
        spent = spent.join(budget.select("poste_budgetaire", F.col("allocated_cents").alias("_a")),
                           "poste_budgetaire", "left")
    else:
        spent = spent.withColumn("_a", F.round(F.col("_s") * 110 / 100).cast("long"))
    return spent.select("poste_budgetaire", dollars("_s").alias("spent"), dollars("_a").alias("allocated"),
                        dollars(F.col("_a") - F.col("_s")).alias("variance"))


def equity(lines: DataFrame, by: str = "titre_emploi", emp: DataFrame | None = None) -> DataFrame:
    """median, IQR and N of the per-employee net per ``by`` group (exact quantiles).

    With ``emp`` (employee-free lines), nets are summed per employee id before
    the employee attributes are joined."""
    if emp is not None:
        from .analytics import attach_attrs
        per_id = lines.groupBy("employee_id").agg(F.sum(_m()).cast("long").alias("_c"))
        per = attach_attrs(per_id, emp, ["matricule", by]).groupBy(by, "matricule").agg(
            (F.sum("_c") / 100.0).alias("_net"))
    else:
        per = lines.groupBy(by, "matricule").agg((F.sum(_m()) / 100.0).alias("_net"))
    q = exact_quantiles(per, [by], "_net", [0.25, 0.5, 0.75])
    return q.select(by, F.round("q_1", 6).alias("median"), F.round(F.col("q_2") - F.col("q_0"), 6).alias("iqr"), "n")


def pay_frequency(dates: DataFrame, date_col: str = "pay_date") -> DataFrame:
    """mean/min/max gap between distinct pay dates and the frequency band."""
    d = dates.select(date_col).filter(F.col(date_col).isNotNull()).distinct()
    g = d.select(F.datediff(F.col(date_col), F.lag(date_col).over(Window.orderBy(date_col))).alias("gap")) \
        .filter(F.col("gap").isNotNull())
    a = g.agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.min("gap").alias("min_gap"),
              F.max("gap").alias("max_gap"), F.count(F.lit(1)).alias("n_gaps"))
    m = F.col("mean_gap")
    band = (F.when(m.between(6, 8), F.lit("hebdomadaire")).when(m.between(13, 15), F.lit("bi-hebdomadaire"))
            .when(m.between(14, 16), F.lit("bi-mensuelle")).when(m.between(28, 32), F.lit("mensuelle"))
            .otherwise(F.lit("irreguliere")))
    return a.withColumn("frequence", band)


def sequence_range(periods: DataFrame) -> DataFrame:
    """range of period sequences per year."""
    return periods.groupBy(F.year("pay_date").cast("int").alias("annee")).agg(
        F.min("period_seq_in_year").alias("seq_min"), F.max("period_seq_in_year").alias("seq_max"),
        F.count(F.lit(1)).alias("n_periods"))


def imported_files(lines: DataFrame) -> DataFrame:
    """per source file: first date, lines, employees."""
    return lines.groupBy("source_file").agg(F.min("pay_date").alias("date_min"), F.count(F.lit(1)).alias("lignes"),
                                            F.countDistinct("employee_id").alias("employes"))


def period_list(periods: DataFrame, tx: DataFrame, ipm: DataFrame) -> DataFrame:
    """periods ∪ ledger dates ∪ import dates with origin and counts (two FULL OUTER joins)."""
    t = tx.groupBy("pay_date").agg(F.count(F.lit(1)).alias("n_ledger"))
    i = ipm.filter(F.col("pay_date").isNotNull()).groupBy("pay_date").agg(F.count(F.lit(1)).alias("n_import"))
    p = periods.select("pay_date", "status")
    j = p.join(t, "pay_date", "full_outer").join(i, "pay_date", "full_outer")
    origin = (F.when(F.col("status").isNotNull(), F.lit("periode"))
              .when(F.col("n_ledger").isNotNull(), F.lit("ledger")).otherwise(F.lit("import")))
    return j.select("pay_date", origin.alias("origine"), "status",
                    F.coalesce("n_ledger", F.lit(0)).alias("n_ledger"), F.coalesce("n_import", F.lit(0)).alias("n_import"))


def ledger_stats(tx: DataFrame, periods: DataFrame, emp: DataFrame) -> DataFrame:
    """one-row statistics: lines, total, open periods, active employees, files."""
    per = tx.groupBy("source_file", "employee_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("amount_cents").alias("_c"))
    a = per.agg(F.sum("_n").alias("n_lines"), dollars(F.sum("_c")).alias("total"),
                F.countDistinct("source_file").alias("n_files"), F.countDistinct("employee_id").alias("n_employees"))
    p = periods.agg(F.count_if(F.col("status") == "ouverte").alias("open_periods"))
    e = emp.agg(F.count_if(F.col("statut") == "actif").alias("active_employees"))
    return a.crossJoin(p).crossJoin(e)


def rollup_series(lines: DataFrame, group: str | None = None) -> DataFrame:
    """totals by day, month and year (optionally by a field) in one GROUPING SETS job."""
    g = [group] if group else []
    day, month, year = (F.col("date_paie").cast("string").alias("day"), period_col().alias("month"),
                        F.date_format("date_paie", "yyyy").alias("year"))
    base = lines.select(day, month, year, *g, _m())
    sets = [[F.col("day"), *[F.col(x) for x in g]], [F.col("month"), *[F.col(x) for x in g]],
            [F.col("year"), *[F.col(x) for x in g]]]
    agg = base.groupingSets(sets, *[F.col(c) for c in ["day", "month", "year", *g]]).agg(
        F.sum(_m()).cast("long").alias("_t"), F.count(F.lit(1)).alias("n"))
    grain = F.when(F.col("day").isNotNull(), F.lit("day")).when(F.col("month").isNotNull(), F.lit("month")) \
        .otherwise(F.lit("year"))
    return agg.select(grain.alias("grain"), F.coalesce("day", "month", "year").alias("bucket"), *g,
                      dollars("_t").alias("total"), "n")


def batch_summary(tx: DataFrame, batches: DataFrame, stg: DataFrame) -> DataFrame:
    """latest completed batch: lines, rejected, total, employees."""
    last = batches.filter(F.col("status") == "completed").agg(F.max("pay_date")).scalar()
    lines = on_date(tx, last)
    rej = stg.filter((F.col("pay_date") == last) & ((F.col("amount_cents") == 0) | (F.col("employer_cents") < 0)))
    return lines.agg(F.max("pay_date").alias("pay_date"), F.count(F.lit(1)).alias("n_lines"),
                     dollars(F.sum("amount_cents")).alias("total"),
                     F.countDistinct("employee_id").alias("n_employees")).crossJoin(
        rej.agg(F.count(F.lit(1)).alias("n_rejected")))


def file_summary(stg: DataFrame) -> DataFrame:
    """per source file: lines, rejected lines, net total, distinct employees, pay dates."""
    rejected = F.col("pay_date").isNull() | (F.col("amount_cents") == 0) | (F.col("employer_cents") < 0) \
        | (F.trim("pay_code") == "")
    return stg.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(rejected).alias("n_rejected"),
        dollars(F.sum("amount_cents")).alias("total"), F.countDistinct("employee_id").alias("n_employees"),
        F.min("pay_date").alias("date_min"), F.max("pay_date").alias("date_max"))


def file_breakdown(stg: DataFrame, by: str) -> DataFrame:
    """per source file and pay code (or pay date): lines, total, gains, deductions."""
    a = F.col("amount_cents")
    return stg.groupBy("source_file", by).agg(
        F.count(F.lit(1)).alias("n_lines"), dollars(F.sum(a)).alias("total"),
        dollars(F.sum(F.when(a > 0, a).otherwise(0))).alias("gains"), dollars(F.sum(F.when(a < 0, a).otherwise(0))).alias("deductions"))


def file_top_employees(stg: DataFrame, n: int = 10) -> DataFrame:
    """the ``n`` employees with the largest net per source file (ties by employee id).

    Kept per (file, salt bucket) first, so one large file is ranked by many tasks."""
    per = stg.filter(F.col("employee_id").isNotNull()).groupBy("source_file", "employee_id").agg(F.sum("amount_cents").cast("long").alias("_n"))
    per = per.withColumn("_b", F.pmod(F.xxhash64("employee_id"), F.lit(SALT_BUCKETS)))
    for parts in (["source_file", "_b"], ["source_file"]):
        w = Window.partitionBy(*parts).orderBy(F.desc("_n"), "employee_id")
        per = per.withColumn("rang", F.row_number().over(w)).filter(F.col("rang") <= n)
    return per.select("source_file", "rang", "employee_id", dollars("_n").alias("net"))


def period_report(lines: DataFrame, at=None) -> DataFrame:
    """detail lines of a pay date (default the latest) with lineage."""
    d = lines.agg(F.max("date_paie")).scalar() if at is None else F.lit(at).cast("date")
    return lines.filter(F.col("date_paie") == d).select(
        "date_paie", "matricule", "nom_employe", "code_paie", "description_code_paie",
        dollars("montant_employe").alias("montant"), dollars("part_employeur").alias("part_employeur"),
        "source_file", "source_row_no")


def employees_for_date(tx: DataFrame, emp: DataFrame) -> DataFrame:
    """F64: employees per pay date with category/title and a computed status (aggregate first)."""
    per = tx.groupBy("pay_date", "employee_id").agg(
        F.sum("amount_cents").cast("long").alias("_n"), F.bool_or(F.col("amount_cents") != 0).alias("_any"))
    e = emp.select("employee_id", "nom_complet", F.coalesce(F.nullif(F.trim("categorie_emploi"), F.lit("")),
                                                            F.lit("Non défini")).alias("categorie_emploi"),
                   "titre_emploi", "statut")
    j = per.join(e, "employee_id", "left")
    upper = (F.col("nom_complet") == F.upper("nom_complet")) & F.col("nom_complet").rlike("[A-Za-z]")
    status = F.when(upper | (F.col("statut") == "inactif"), F.lit("inactif")) \
        .when(F.col("_any"), F.lit("actif")).otherwise(F.lit("sans_paie"))
    return j.select("pay_date", "employee_id", "nom_complet", "categorie_emploi", "titre_emploi",
                    dollars("_n").alias("net"), status.alias("statut_calcule"))
