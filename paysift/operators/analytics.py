"""Screen aggregations over canonical lines and employee views.

Inputs are canonical lines (``paysift.operators.lines.canonical_lines``) in
cents. Every view is a ``groupBy`` whose partial aggregate runs map-side; joins
with per-employee tables take per-employee aggregates, not raw lines. Windows
only run on small derived tables (batches, per-employee rankings partitioned
by employee).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kpi import dollars

# Category patterns of the screen views. The reference matches
# 'Déduction%'; we compare on the accent-free lower-case form so 'Deductions'
# and 'Déductions' both count (documented deviation).
DEDUCTION_PREFIX = "deduction%"
INSURANCE_PREFIX = "assurances%"
CONTRIB_PATTERNS = ("%cotisation%", "%impot%")
PRIME_PATTERN = "%prime%"
OVERTIME_FAMILY = "HS"
UNCLASSED = "Non classé"
UNDEFINED = "Non défini"

# Accent folding (lower-case Latin-1 letters used by French names).
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(c: Column) -> Column:
    """Lower-case, accent-free form (B10 without space handling)."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def _s(cond: Column, val: str) -> Column:
    return F.sum(F.when(cond, F.col(val)).otherwise(F.lit(0))).cast("long")


def _is_gain() -> Column:
    return F.col("categorie_paie") == "Gains"


def _is_deduction() -> Column:
    return fold(F.col("categorie_paie")).like(DEDUCTION_PREFIX)


EMPLOYEE_SOURCE = {"matricule": "matricule_norm", "nom_employe": "nom_complet", "categorie_emploi": "categorie_emploi",
                   "titre_emploi": "titre_emploi", "statut": "statut"}


def attach_attrs(per: DataFrame, emp: DataFrame, attrs: list[str]) -> DataFrame:
    """Employee attributes (canonical-line names) joined onto a per-employee-id aggregate."""
    e = emp.select("employee_id", *[F.col(EMPLOYEE_SOURCE[a]).alias(a) for a in attrs])
    return per.join(e, "employee_id", "left")


def pay_mass(lines: DataFrame) -> DataFrame:
    """pay mass per date: combined total, gains, deductions, employer share."""
    agg = lines.groupBy("date_paie").agg(
        F.sum("montant_combine").cast("long").alias("_comb"),
        _s(_is_gain(), "montant_employe").alias("_g"),
        _s(_is_deduction(), "montant_employe").alias("_d"),
        F.sum("part_employeur").cast("long").alias("_er"))
    return agg.select("date_paie", dollars("_comb").alias("total_combine"), dollars("_g").alias("gains"),
                      dollars("_d").alias("deductions"), dollars("_er").alias("part_employeur"))


def by_category_code(lines: DataFrame) -> DataFrame:
    """F16: totals per date, pay category and pay code."""
    agg = lines.groupBy("date_paie", "categorie_paie", "code_paie").agg(
        F.sum("montant_combine").cast("long").alias("_comb"), F.sum("part_employeur").cast("long").alias("_er"),
        F.count(F.lit(1)).alias("lignes"))
    return agg.select("date_paie", "categorie_paie", "code_paie", dollars("_comb").alias("total_combine"),
                      dollars("_er").alias("part_employeur"), "lignes")


def by_post(lines: DataFrame) -> DataFrame:
    """totals per date and budget post."""
    agg = lines.groupBy("date_paie", "poste_budgetaire").agg(
        F.sum("montant_combine").cast("long").alias("_comb"), F.sum("part_employeur").cast("long").alias("_er"),
        _s(_is_gain(), "montant_employe").alias("_g"), _s(_is_deduction(), "montant_employe").alias("_d"))
    return agg.select("date_paie", "poste_budgetaire", dollars("_comb").alias("total_combine"),
                      dollars("_er").alias("part_employeur"), dollars("_g").alias("gains"),
                      dollars("_d").alias("deductions"))


def by_function(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """totals and headcount per date, job category and job title.

    With ``emp`` (employee-free lines), sums are taken per (date, employee id)
    before the employee attributes are joined."""
    if emp is not None:
        per = lines.groupBy("date_paie", "employee_id").agg(F.sum("montant_combine").cast("long").alias("_c"))
        lines = attach_attrs(per, emp, ["matricule", "categorie_emploi", "titre_emploi"])
        total = F.sum("_c")
    else:
        total = F.sum("montant_combine")
    agg = lines.groupBy("date_paie", "categorie_emploi", "titre_emploi").agg(
        total.cast("long").alias("_comb"), F.countDistinct("matricule").alias("nb_employes"))
    return agg.select("date_paie", "categorie_emploi", "titre_emploi", dollars("_comb").alias("total_combine"),
                      "nb_employes")


def by_employee(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """totals per date and employee with representative attributes (max of non-blank).

    With ``emp`` (employee-free lines), sums are taken per (date, employee id)
    before the employee attributes are joined."""
    def rep(c):
        return F.max(F.nullif(F.trim(F.col(c)), F.lit(""))).alias(c)
    parts = {"_comb": F.sum("montant_combine"), "_g": _s(_is_gain(), "montant_employe"),
             "_d": _s(_is_deduction(), "montant_employe"), "_er": F.sum("part_employeur"),
             "lignes": F.count(F.lit(1))}
    if emp is not None:
        per = lines.groupBy("date_paie", "employee_id").agg(*[e.cast("long").alias(k) for k, e in parts.items()])
        lines = attach_attrs(per, emp, ["matricule", "nom_employe", "categorie_emploi", "titre_emploi"])
        parts = {k: F.sum(k) for k in parts}
    agg = lines.groupBy("date_paie", "matricule").agg(
        rep("nom_employe"), rep("categorie_emploi"), rep("titre_emploi"),
        *[e.cast("long").alias(k) for k, e in parts.items()])
    return agg.select("date_paie", "matricule", "nom_employe", "categorie_emploi", "titre_emploi",
                      dollars("_comb").alias("total_combine"), dollars("_g").alias("gains"),
                      dollars("_d").alias("deductions"), dollars("_er").alias("part_employeur"), "lignes")


def by_code(lines: DataFrame) -> DataFrame:
    """totals per date and pay code with description and category."""
    agg = lines.groupBy("date_paie", "code_paie", "description_code_paie", "categorie_paie").agg(
        F.sum("montant_combine").cast("long").alias("_comb"), F.sum("part_employeur").cast("long").alias("_er"),
        F.count(F.lit(1)).alias("lignes"))
    return agg.select("date_paie", "code_paie", "description_code_paie", "categorie_paie",
                      dollars("_comb").alias("total_combine"), dollars("_er").alias("part_employeur"), "lignes")


def overtime(lines: DataFrame, families: DataFrame) -> DataFrame:
    """overtime and bonuses: code family 'HS', else category containing 'prime'."""
    fam = F.broadcast(families.select(F.col("pay_code").alias("code_paie"), "famille"))
    hs = lines.join(fam, "code_paie", "left").filter(
        (F.col("famille") == OVERTIME_FAMILY)
        | (F.col("famille").isNull() & F.col("categorie_paie").ilike(PRIME_PATTERN)))
    agg = hs.groupBy("date_paie", "poste_budgetaire").agg(
        F.sum("montant_employe").cast("long").alias("_hs"), F.count(F.lit(1)).alias("lignes"))
    return agg.select("date_paie", "poste_budgetaire", dollars("_hs").alias("total_hs"), "lignes")


def benefits(lines: DataFrame) -> DataFrame:
    """benefits per date and code: employer share, insurance retained, total."""
    agg = lines.groupBy("date_paie", "code_paie", "description_code_paie").agg(
        F.sum("part_employeur").cast("long").alias("_er"),
        _s(F.col("categorie_paie").ilike(INSURANCE_PREFIX), "montant_employe").alias("_ret"),
        F.sum("montant_combine").cast("long").alias("_comb"))
    return agg.select("date_paie", "code_paie", "description_code_paie", dollars("_er").alias("part_employeur"),
                      dollars("_ret").alias("retenu_employe"), dollars("_comb").alias("total_combine"))


def turnover(lines: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """entry (first date) and exit (last date) rows per employee (X21: right-censored).

    Lines are reduced to distinct (employee, date, name, post); the bounds per
    employee are aggregated from that same set and joined back once on the
    employee (both sides share the employee partitioning; AQE splits a hot key);
    each row then yields an entry and/or an exit."""
    if emp is not None:  # distinct (employee id, date, post) first, then number and name
        ids = lines.select("employee_id", "date_paie", "poste_budgetaire").distinct()
        lines = attach_attrs(ids, emp, ["matricule", "nom_employe"])
    d = lines.select("matricule", "date_paie", "nom_employe", "poste_budgetaire").distinct()
    bounds = d.groupBy("matricule").agg(F.min("date_paie").alias("first_date"),
                                        F.max("date_paie").alias("last_date"))
    st = d.join(bounds, "matricule")
    kinds = F.array(F.when(F.col("date_paie") == F.col("first_date"), F.lit("Entree")),
                    F.when(F.col("date_paie") == F.col("last_date"), F.lit("Sortie")))
    return st.select("date_paie", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("type"),
                     "matricule", "nom_employe", "poste_budgetaire")


def contributions(lines: DataFrame) -> DataFrame:
    """contributions and taxes per date (category matches cotisation/impot)."""
    c = F.col("categorie_paie")
    cond = c.ilike(CONTRIB_PATTERNS[0]) | c.ilike(CONTRIB_PATTERNS[1])
    agg = lines.groupBy("date_paie").agg(_s(cond, "montant_employe").alias("_c"))
    return agg.select("date_paie", dollars("_c").alias("somme_cotisations"))


# ----------------------------------------------------------------------------------
# Employee views over the ledger
# ----------------------------------------------------------------------------------

def monthly_summary(tx: DataFrame, emp: DataFrame) -> DataFrame:
    """per pay date and employee: employee, employer, combined totals and count."""
    agg = tx.groupBy("pay_date", "employee_id").agg(
        F.sum("amount_cents").cast("long").alias("_a"), F.sum("employer_cents").cast("long").alias("_e"),
        F.count(F.lit(1)).alias("transaction_count"))
    e = emp.select("employee_id", F.col("matricule_norm").alias("matricule"), "nom_complet")
    return agg.join(e, "employee_id").select(
        "pay_date", "employee_id", "matricule", "nom_complet", dollars("_a").alias("total_employee_amount"),
        dollars("_e").alias("total_employer_amount"),
        dollars(F.col("_a") + F.col("_e")).alias("total_combined_amount"), "transaction_count")


def current_salary(tx: DataFrame, emp: DataFrame) -> DataFrame:
    """latest pay date's net per active employee (``max_by`` replaces DISTINCT ON)."""
    per_date = tx.groupBy("employee_id", "pay_date").agg(F.sum("amount_cents").cast("long").alias("_net"))
    latest = per_date.groupBy("employee_id").agg(
        F.max("pay_date").alias("last_pay_date"), F.max_by("_net", "pay_date").alias("_last"))
    e = emp.filter(F.col("statut") == "actif").select(
        "employee_id", F.col("matricule_norm").alias("matricule"), "nom_complet", "statut")
    return e.join(latest, "employee_id", "left").select(
        "employee_id", "matricule", "nom_complet", "statut", "last_pay_date",
        dollars("_last").alias("last_net_salary"))


def annual_history(tx: DataFrame, emp: DataFrame) -> DataFrame:
    """per year and employee: totals and distinct pay periods."""
    agg = tx.groupBy(F.year("pay_date").cast("int").alias("year"), "employee_id").agg(
        F.sum("amount_cents").cast("long").alias("_a"), F.sum("employer_cents").cast("long").alias("_e"),
        F.countDistinct("pay_date").alias("pay_periods_count"))
    e = emp.select("employee_id", F.col("matricule_norm").alias("matricule"), "nom_complet")
    return agg.join(e, "employee_id").select(
        "year", "employee_id", "matricule", "nom_complet", dollars("_a").alias("annual_employee_total"),
        dollars("_e").alias("annual_employer_total"),
        dollars(F.col("_a") + F.col("_e")).alias("annual_combined_total"), "pay_periods_count")


def employees_enriched(emp: DataFrame, tx: DataFrame) -> DataFrame:
    """employees with first/last pay, distinct pay dates and lifetime total."""
    agg = tx.groupBy("employee_id").agg(
        F.countDistinct("pay_date").alias("nb_mois_paie"), F.min("pay_date").alias("premiere_paie"),
        F.max("pay_date").alias("derniere_paie"), F.sum("amount_cents").cast("long").alias("_tot"))
    return emp.join(agg, "employee_id", "left").select(
        *emp.columns, F.coalesce("nb_mois_paie", F.lit(0)).cast("long").alias("nb_mois_paie"),
        "premiere_paie", "derniere_paie", dollars("_tot").alias("total_paie_lifetime"))


def employee_period_summary(tx: DataFrame, emp: DataFrame, periods: DataFrame) -> DataFrame:
    """employee x period net summary (periods ⋈ ledger ⋈ employees)."""
    agg = tx.groupBy("pay_date", "employee_id").agg(F.sum("amount_cents").cast("long").alias("_net"))
    agg = agg.join(periods.select("pay_date"), "pay_date")
    e = emp.select("employee_id", F.col("nom_complet").alias("nom"), F.col("matricule_norm").alias("matricule"),
                   "statut", F.coalesce("categorie_emploi", F.lit("")).alias("categorie_emploi"),
                   F.coalesce("titre_emploi", F.lit("")).alias("titre_emploi"))
    return agg.join(e, "employee_id").select("pay_date", "employee_id", "nom", "matricule", "statut",
                                             "categorie_emploi", "titre_emploi", dollars("_net").alias("salaire_net"))


def dominant_profile(lines: DataFrame, key: str, attrs: list[str], undefined: str = UNDEFINED) -> DataFrame:
    """most frequent attribute combination per ``key``; ties by attribute order.

    Counting is a group-by on (key, attrs); the ranking window is partitioned by
    the key over those counted rows (distinct combinations, not lines).
    """
    cleaned = [F.coalesce(F.nullif(F.trim(F.col(a)), F.lit("")), F.lit(undefined)).alias(a) for a in attrs]
    base = lines.select(key, *cleaned).groupBy(key, *attrs).agg(F.count(F.lit(1)).alias("occurrences"))
    w = Window.partitionBy(key).orderBy(F.desc("occurrences"), *attrs)
    return base.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def category_headcount(tx: DataFrame, profile: DataFrame, cat: str) -> DataFrame:
    """distinct employees per pay date and profile category ('Non classé' if blank)."""
    per = tx.select("pay_date", "employee_id").distinct()
    p = profile.select("employee_id",
                       F.coalesce(F.nullif(F.col(cat), F.lit("")), F.lit(UNCLASSED)).alias("categorie"))
    return per.join(p, "employee_id").groupBy(F.col("pay_date").alias("date_paie"), "categorie").agg(
        F.count(F.lit(1)).alias("nb_employes"))


def employee_groups(profile: DataFrame, attrs: list[str]) -> DataFrame:
    """F32: employees per attribute combination and share of all (% on the small result)."""
    g = profile.groupBy(*attrs).agg(F.countDistinct("employee_id").alias("nb_employes"))
    total = profile.agg(F.countDistinct("employee_id").alias("_t"))
    return g.crossJoin(F.broadcast(total)).select(
        *attrs, "nb_employes",
        (F.expr("(nb_employes * 20000 + _t) div (2 * _t)") / 100.0).alias("pct"))


def new_hires(tx: DataFrame, emp: DataFrame, batches: DataFrame) -> DataFrame:
    """per completed batch, active employees and whether their number exceeds the
    previous batch's maximum (first batch: all new). The lag runs on the batch
    aggregate (one row per batch), joined back by batch id."""
    b = batches.filter(F.col("status") == "completed").select("batch_id", "pay_date", "source_file")
    e = emp.filter(F.col("matricule_norm").rlike("^[0-9]+$")).select(
        "employee_id", "matricule_norm", F.col("matricule_norm").cast("long").alias("matricule_int"))
    active = tx.filter(F.col("amount_cents") != 0).select("pay_date", "employee_id").distinct()
    mp = active.join(b, "pay_date").join(e, "employee_id")
    mx = mp.groupBy("batch_id", "pay_date").agg(F.max("matricule_int").alias("max_actuel"),
                                                F.count(F.lit(1)).alias("nb_employes"))
    w = Window.orderBy("pay_date", "batch_id")
    prev = mx.select("batch_id", "max_actuel", "nb_employes",
                     F.lag("max_actuel").over(w).alias("max_precedent"),
                     F.lag("pay_date").over(w).alias("date_precedente"))
    return mp.join(prev, "batch_id").select(
        "batch_id", "pay_date", "source_file", "employee_id", "matricule_norm", "matricule_int",
        "max_precedent", "max_actuel", "date_precedente",
        (F.col("matricule_int") > F.coalesce("max_precedent", F.lit(0))).alias("est_nouveau"))


def new_hire_stats(nh: DataFrame) -> DataFrame:
    """F33 stats: totals, new, old, bounds and the sorted list of all new numbers per batch.

    ``nh`` has one row per batch and employee, so plain counts do."""
    new = F.col("est_nouveau")
    agg = nh.groupBy("batch_id", "pay_date", "source_file").agg(
        F.count(F.lit(1)).alias("total_employes"), F.count_if(new).alias("nouveaux_employes"),
        F.count_if(~new).alias("anciens_employes"), F.max("max_precedent").alias("max_precedent"),
        F.max("max_actuel").alias("max_actuel"), F.max("date_precedente").alias("date_precedente"),
        F.collect_list(F.when(new, F.col("matricule_norm"))).alias("_new"))
    return agg.withColumn("liste_nouveaux", F.array_join(F.array_sort("_new"), ", ")).drop("_new")


def churn(nh: DataFrame, emp: DataFrame) -> DataFrame:
    """per pay date: total, new, left (inactive), churn % (2 decimals), previous date."""
    per = nh.groupBy("pay_date", "employee_id").agg(F.max("est_nouveau").alias("est_nouveau"), F.max("date_precedente").alias("prev"))
    base = per.join(emp.select("employee_id", "statut"), "employee_id")
    agg = base.groupBy("pay_date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("est_nouveau").alias("nouveaux"),
        F.count_if(F.col("statut") == "inactif").alias("sorties"), F.max("prev").alias("prev_date"))
    bp = F.expr("(sorties * 20000 + total) div (2 * total)")  # half-up basis points
    return agg.select("pay_date", "total", "nouveaux", "sorties",
                      F.when(F.col("total") > 0, bp / 100.0).otherwise(F.lit(0.0)).alias("churn"), "prev_date")
