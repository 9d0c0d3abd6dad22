"""KPI families over the pay ledger.

Money is kept in integer cents (``LongType``) through every aggregation and is
turned into dollars only in the final projection: ``CAST(cents AS DOUBLE)/100``.
Each KPI family is one ``groupBy`` with a shared aggregate list, so a family is a
single scan with map-side partial aggregation; the contradictory definitions of
the reference (X1-X5) live in separately named functions.

Joins with the employee table aggregate the ledger first to (key, employee)
rows and join those, so the join input is the per-employee aggregate, never the
raw lines (the employee table grows with the data and is not broadcast by hint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: employer-share rate of the contract views.
CONTRACT_EMPLOYER_RATE = 0.15
# Code fragments of the contract views.
ADJUST_PATTERN = "%AJUST%"
REFUND_PATTERN = "%REMBOURSE%"
# Deduction categories of the star views.
DEDUCTION_CATEGORIES = ("Deductions", "Deductions_legales", "Assurances", "Syndicats")
UNDEFINED_LABEL = "Non défini"



def dollars(c: str | Column) -> Column:
    """Cents -> dollars as DOUBLE (exact for |cents| < 2**53)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double") / 100.0


def _sum_when(cond: Column, val: Column | None = None) -> Column:
    val = F.col("amount_cents") if val is None else val
    return F.sum(F.when(cond, val).otherwise(F.lit(0))).cast("long")


# --------------------------------------------------------------------------------------
# Contract family (F2-F9): positive amounts are gains, negative amounts deductions.
# --------------------------------------------------------------------------------------

def contract_cents_aggs() -> list[Column]:
    """Line-level partial sums of the contract family, in cents."""
    A = F.col("amount_cents")
    return [
        _sum_when(A > 0).alias("_pos"),
        _sum_when(A < 0).alias("_neg"),
        F.sum(A).cast("long").alias("_net"),
        _sum_when((A > 0) & F.col("pay_code").like(ADJUST_PATTERN)).alias("_adj"),
        _sum_when((A < 0) & F.col("pay_code").like(REFUND_PATTERN)).alias("_ref"),
    ]


def contract_dollars(rate: float = CONTRACT_EMPLOYER_RATE) -> list[Column]:
    """Final projection of the contract family from the ``_pos/_neg/...`` cents sums."""
    pos = F.col("_pos").cast("double")
    return [
        dollars("_pos").alias("gains_brut"),
        dollars("_neg").alias("deductions_net"),
        dollars("_net").alias("net_a_payer"),
        (pos * F.lit(rate) / 100.0).alias("part_employeur"),
        ((F.col("_net").cast("double") + pos * F.lit(rate)) / 100.0).alias("cout_total"),
        (-F.col("_neg").cast("double") / 100.0).alias("cash_out_total"),
        dollars("_adj").alias("ajustements_gains"),
        dollars("_neg").alias("deductions_brutes"),
        dollars("_ref").alias("remboursements"),
    ]


def nb_employes_nonzero() -> Column:
    """X5 reading 2: distinct employees with a non-zero amount."""
    A = F.col("amount_cents")
    return F.countDistinct(F.when(A != 0, F.col("employee_id"))).alias("nb_employes")


def _contract_by(lines: DataFrame, keys: list[Column], rate: float) -> DataFrame:
    agg = lines.groupBy(*keys).agg(*contract_cents_aggs(), nb_employes_nonzero())
    key_names = agg.columns[:len(keys)]
    return agg.select(*key_names, *contract_dollars(rate), "nb_employes")


def kpi_by_period(tx: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """contract KPI per pay date (11 columns)."""
    return _contract_by(tx, [F.col("pay_date").alias("date_paie")], rate)


def kpi_by_code(tx: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """contract KPI per pay date and pay code."""
    return _contract_by(tx, [F.col("pay_date").alias("date_paie"), F.col("pay_code")], rate)


def kpi_by_post(tx: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """contract KPI per pay date and budget post of the line (blank -> 'Non défini')."""
    post = F.coalesce(F.col("budget_post"), F.lit(UNDEFINED_LABEL)).alias("poste_budgetaire")
    return _contract_by(tx, [F.col("pay_date").alias("date_paie"), post], rate)


def kpi_by_employee(tx: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """contract KPI per pay date and employee (``nb_employes`` is 1 by definition)."""
    agg = tx.groupBy(F.col("pay_date").alias("date_paie"), "employee_id").agg(*contract_cents_aggs())
    return agg.select("date_paie", "employee_id", *contract_dollars(rate),
                      F.lit(1).cast("long").alias("nb_employes"))


def _per_employee_then_join(tx: DataFrame, emp: DataFrame, keys: list[Column],
                            emp_attr: Column) -> tuple[DataFrame, list[str]]:
    """Contract KPI by ``keys`` + an employee attribute, aggregating before the join.

    Stage 1 reduces lines to one row per (keys, employee) with cents sums and a
    non-zero flag; stage 2 joins that with the employee attribute and sums again.
    Each employee has one attribute value, so counting flagged rows per group is
    exactly the distinct count of the reference.
    """
    A = F.col("amount_cents")
    per_emp = tx.groupBy(*keys, "employee_id").agg(
        *contract_cents_aggs(), F.max(F.when(A != 0, 1).otherwise(0)).alias("_nz"))
    key_names = per_emp.columns[:len(keys)]
    attrs = emp.select("employee_id", emp_attr.alias("_attr"))
    joined = per_emp.join(attrs, "employee_id", "left")
    agg = joined.groupBy(*key_names, "_attr").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("_pos", "_neg", "_net", "_adj", "_ref")],
        F.sum("_nz").cast("long").alias("nb_employes"))
    return agg, key_names


def kpi_by_category(tx: DataFrame, emp: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """contract KPI per pay date and job category (NULL -> 'Non défini')."""
    agg, keys = _per_employee_then_join(tx, emp, [F.col("pay_date").alias("date_paie")],
                                        F.col("categorie_emploi"))
    return agg.select(*keys, F.coalesce("_attr", F.lit(UNDEFINED_LABEL)).alias("categorie_emploi"),
                      *contract_dollars(rate), "nb_employes")


def _month_key(c: str = "pay_date") -> Column:
    return F.date_format(c, "yyyy-MM")


def _per_date_employee(tx: DataFrame) -> DataFrame:
    """One row per (pay date, employee): distinct counts over longer periods start from it, not from raw lines."""
    return tx.groupBy("pay_date", "employee_id").agg(
        *contract_cents_aggs(), F.max(F.when(F.col("amount_cents") != 0, 1).otherwise(0)).alias("_nz"), F.count(F.lit(1)).alias("_n"))


def _finish() -> list[Column]:
    return [*[F.sum(c).cast("long").alias(c) for c in ("_pos", "_neg", "_net", "_adj", "_ref")],
            F.countDistinct(F.when(F.col("_nz") == 1, F.col("employee_id"))).alias("nb_employes"),
            F.countDistinct("pay_date").alias("nb_dates_paie"), F.sum("_n").cast("long").alias("nb_transactions")]


def kpi_month(tx: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """monthly contract KPI with distinct pay dates and transaction count."""
    agg = _per_date_employee(tx).groupBy(_month_key().alias("mois"), F.date_format("pay_date", "yyyy").alias("annee")).agg(*_finish())
    return agg.select("mois", "annee", *contract_dollars(rate), "nb_employes", "nb_dates_paie",
                      "nb_transactions")


def kpi_year(tx: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """F8: annual contract KPI with distinct pay dates and months."""
    agg = _per_date_employee(tx).groupBy(F.date_format("pay_date", "yyyy").alias("annee")).agg(
        *_finish(), F.countDistinct(_month_key()).alias("nb_mois"))
    return agg.select("annee", *contract_dollars(rate), "nb_employes", "nb_dates_paie", "nb_mois",
                      "nb_transactions")


def kpi_month_category(tx: DataFrame, emp: DataFrame, rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """month x job category (gains, deductions, net, employer share, cost, headcount, count)."""
    A = F.col("amount_cents")
    per_emp = tx.groupBy(_month_key().alias("mois"), "employee_id").agg(
        *contract_cents_aggs(), F.max(F.when(A != 0, 1).otherwise(0)).alias("_nz"),
        F.count(F.lit(1)).alias("_n"))
    attrs = emp.select("employee_id", F.col("categorie_emploi").alias("_attr"))
    agg = per_emp.join(attrs, "employee_id", "left").groupBy("mois", "_attr").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("_pos", "_neg", "_net", "_adj", "_ref")],
        F.sum("_nz").cast("long").alias("nb_employes"), F.sum("_n").cast("long").alias("nb_transactions"))
    pos = F.col("_pos").cast("double")
    return agg.select(
        "mois", F.substring("mois", 1, 4).alias("annee"),
        F.coalesce("_attr", F.lit(UNDEFINED_LABEL)).alias("categorie_emploi"),
        dollars("_pos").alias("gains_brut"), dollars("_neg").alias("deductions_net"),
        dollars("_net").alias("net_a_payer"), (pos * F.lit(rate) / 100.0).alias("part_employeur"),
        ((F.col("_net").cast("double") + pos * F.lit(rate)) / 100.0).alias("cout_total"),
        "nb_employes", "nb_transactions")


# --------------------------------------------------------------------------------------
# Cards (F1) and parameter-driven rate
# --------------------------------------------------------------------------------------

def on_date(tx: DataFrame, target, date_col: str = "pay_date") -> DataFrame:
    """Lines of one pay date. When the ledger carries ``pay_year`` (its storage
    partition column), the same date is also stated on the year, so a stored
    ledger prunes its year partitions (the target may be a scalar subquery)."""
    cond = F.col(date_col) == target
    if "pay_year" in tx.columns:
        cond = cond & (F.col("pay_year") == F.year(target))
    return tx.filter(cond)


def kpi_cards(tx: DataFrame, pay_date=None) -> DataFrame:
    """KPI cards of one pay date (default: the latest pay date of the ledger).

    The latest date is a scalar subquery, so the filter can prune partitions of a
    ledger stored by pay date/year.
    """
    A = F.col("amount_cents")
    target = F.lit(pay_date).cast("date") if pay_date is not None else \
        tx.agg(F.max("pay_date")).scalar()
    day = on_date(tx, target)
    agg = day.agg(F.sum(A).cast("long").alias("_net"), _sum_when(A > 0).alias("_pos"),
                  _sum_when(A < 0).alias("_neg"), F.countDistinct("employee_id").alias("nb_employes"),
                  F.count(F.lit(1)).alias("nb_transactions"), F.max("pay_date").alias("date_paie"))
    return agg.select(
        "date_paie",
        F.coalesce(dollars("_net"), F.lit(0.0)).alias("salaire_net_total"),
        F.coalesce(dollars("_pos"), F.lit(0.0)).alias("masse_salariale"),
        F.coalesce(dollars("_neg"), F.lit(0.0)).alias("deductions"),
        F.when(F.col("nb_employes") > 0, dollars("_net") / F.col("nb_employes"))
        .otherwise(F.lit(0.0)).alias("net_moyen"),
        "nb_employes", "nb_transactions")


def kpi_param_rate(tx: DataFrame, params: DataFrame, key: str = "part_employeur_taux",
                   default: float | None = None) -> DataFrame:
    """contract KPI per date with the employer rate read from a parameter table.

    ``params`` is (param_key, value_num); the one matching row is a scalar
    subquery (1 row), joined to every group as a constant. A missing key is an
    error unless the caller gives a ``default``.
    """
    rate = params.filter(F.col("param_key") == key).agg(F.max("value_num").alias("r")).scalar()
    missing = F.raise_error(F.lit(f"no parameter {key!r}")).cast("double") if default is None else F.lit(default)
    rate = F.coalesce(rate, missing)
    agg = tx.groupBy(F.col("pay_date").alias("date_paie")).agg(*contract_cents_aggs(),
                                                             nb_employes_nonzero())
    pos = F.col("_pos").cast("double")
    return agg.select(
        "date_paie", dollars("_pos").alias("gains_brut"), dollars("_net").alias("net_a_payer"),
        (pos * rate / 100.0).alias("part_employeur"),
        ((F.col("_net").cast("double") + pos * rate) / 100.0).alias("cout_total"), "nb_employes")


# --------------------------------------------------------------------------------------
# Star family (F10-F11): categories from the code dimension, algebraic deductions.
# --------------------------------------------------------------------------------------

def star_cents_aggs(columns: list[str]) -> list[Column]:
    cat = F.col("categorie_paie")
    A = F.col("amount_cents")
    ded = cat.isin(*DEDUCTION_CATEGORIES)
    gains = cat == "Gains"
    adjusted = F.col("is_adjustment") if "is_adjustment" in columns else gains & (A < 0)
    refunded = F.col("is_refund") if "is_refund" in columns else ded & (A > 0)
    return [
        F.count(F.lit(1)).alias("nb_transactions"),
        _sum_when(gains & (A >= 0)).alias("_gains"),
        _sum_when(gains & (A < 0), F.abs(A)).alias("_adj"),
        _sum_when(ded).alias("_ded_net"),
        _sum_when(ded & (A < 0), F.abs(A)).alias("_ded_brut"),
        _sum_when(ded & (A > 0)).alias("_refund"),
        _sum_when(cat == "Deductions_legales").alias("_legal"),
        _sum_when(cat == "Assurances").alias("_ins"),
        _sum_when(cat == "Syndicats").alias("_union"),
        F.sum(A).cast("long").alias("_net"),
        F.sum("employer_cents").cast("long").alias("_er"),
        _sum_when(gains).alias("_gains_all"),
        F.count_if(adjusted).alias("nb_ajustements"),
        F.count_if(refunded).alias("nb_remboursements"),
        F.countDistinct("employee_id").alias("nb_employes"),
    ]


def star_dollars() -> list[Column]:
    return [
        dollars("_gains").alias("gains_brut"),
        dollars("_adj").alias("ajustements_gains"),
        dollars("_ded_net").alias("deductions_net"),
        dollars("_ded_brut").alias("deductions_brutes"),
        dollars("_refund").alias("remboursements"),
        dollars("_legal").alias("deductions_legales_net"),
        dollars("_ins").alias("assurances_net"),
        dollars("_union").alias("syndicats_net"),
        dollars("_net").alias("net_a_payer"),
        dollars("_er").alias("part_employeur"),
        ((F.col("_gains_all") + F.col("_er")).cast("double") / 100.0).alias("cout_employeur_pnl"),
        ((F.col("_net") + F.col("_er")).cast("double") / 100.0).alias("cash_out_total"),
        (F.col("_net").cast("double") / F.nullif(F.col("nb_employes"), F.lit(0)) / 100.0)
        .alias("net_moyen_par_employe"),
    ]


def kpi_star(fact: DataFrame) -> DataFrame:
    """star KPI per pay date (algebraic deductions, refunds, P&L cost, cash-out, tags).

    Counts the tags stored by the fact load (``is_adjustment`` = negative gain,
    ``is_refund`` = positive deduction), or their definition on untagged lines.
    """
    agg = fact.groupBy("pay_date").agg(*star_cents_aggs(fact.columns))
    return agg.select(
        F.col("pay_date").alias("date_paie"), F.date_format("pay_date", "yyyy-MM").alias("mois_paie"),
        F.year("pay_date").cast("int").alias("annee_paie"),
        F.quarter("pay_date").cast("int").alias("trimestre"),
        "nb_employes", "nb_transactions", *star_dollars(), "nb_ajustements", "nb_remboursements")


def kpi_star_month(fact: DataFrame) -> DataFrame:
    """star KPI per month, with the last refresh (max ``loaded_at`` if present)."""
    extra = [F.max("loaded_at").alias("derniere_mise_a_jour")] if "loaded_at" in fact.columns else []
    agg = fact.groupBy(F.date_format("pay_date", "yyyy-MM").alias("mois_paie")).agg(
        *star_cents_aggs(fact.columns), *extra)
    return agg.select("mois_paie", F.substring("mois_paie", 1, 4).cast("int").alias("annee_paie"),
                      "nb_employes", "nb_transactions", *star_dollars(), "nb_ajustements",
                      "nb_remboursements", *[e for e in ["derniere_mise_a_jour"] if extra])


def kpi_employee_date(tx: DataFrame, emp: DataFrame, stg: DataFrame | None = None,
                      rate: float = CONTRACT_EMPLOYER_RATE) -> DataFrame:
    """KPI per employee and pay date with attributes.

    Both sides are aggregated first: the ledger to (date, employee), staging
    attributes to (date, employee) with ``max(nullif(x,''))``. The OR-join of the
    reference on two employee-number columns (X22) becomes one equi join on the
    employee id, so no row can fan out.
    """
    A = F.col("amount_cents")
    agg = tx.groupBy(F.col("pay_date").alias("date_paie"), "employee_id").agg(
        _sum_when(A > 0).alias("_pos"), _sum_when(A < 0).alias("_neg"), F.sum(A).cast("long").alias("_net"))
    e = emp.select("employee_id", "matricule_norm", "nom_complet", "categorie_emploi", "titre_emploi")
    out = agg.join(e, "employee_id", "inner")
    if stg is not None:
        sa = stg.groupBy(F.col("pay_date").alias("date_paie"), "employee_id").agg(
            F.max(F.nullif(F.col("budget_post"), F.lit(""))).alias("_post"))
        out = out.join(sa, ["date_paie", "employee_id"], "left")
    else:
        out = out.withColumn("_post", F.lit(None).cast("string"))
    pos = F.col("_pos").cast("double")

    def lbl(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNDEFINED_LABEL))
    er = pos * F.lit(rate) / 100.0
    # cout_total = round(net + employer share, 2), half away from zero, in 1/100 cents.
    hund = F.col("_net") * 100 + F.col("_pos") * F.lit(int(round(rate * 100)))
    cost_cents = F.when(hund >= 0, F.floor((hund + 50) / 100)) \
        .otherwise(-F.floor((-hund + 50) / 100)).cast("long")
    return out.select(
        "date_paie", F.col("matricule_norm").alias("matricule"),
        F.coalesce("nom_complet", F.lit("N/A")).alias("nom_prenom"),
        lbl("categorie_emploi").alias("categorie_emploi"), lbl("titre_emploi").alias("titre_emploi"),
        lbl("_post").alias("poste_budgetaire"),
        dollars("_pos").alias("gains_brut"), dollars("_neg").alias("deductions"),
        dollars("_net").alias("net"), er.alias("part_employeur"),
        dollars(cost_cents).alias("cout_total"))


def v_period_compat(star: DataFrame) -> DataFrame:
    """The star KPI per date under its older column names."""
    names = {"gains_brut": "brut", "deductions_net": "deductions_employe", "net_a_payer": "net"}
    keep = ["date_paie", "gains_brut", "deductions_net", "net_a_payer", "part_employeur", "cout_employeur_pnl", "cash_out_total",
            "nb_employes", "ajustements_gains", "deductions_brutes", "remboursements"]
    return star.select(*keep).withColumnsRenamed(names)
