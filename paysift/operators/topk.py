"""Exact quantiles per group without pulling a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: a quantile it gives is off by at most ``n / ACCURACY`` ranks.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles per group with linear interpolation (``percentile`` / ``quantile_cont``),
    without holding or sorting a group's values in one task.

    First pass: a mergeable quantile sketch per group (``approx_percentile``) gives for
    each quantile an interval of values that holds its two neighbouring ranks, as the
    sketch's rank error is bounded. Second pass: all values below an interval are
    counted as one, those inside by value, both combined map-side; a running sum over
    the few values inside finds the ranks ``floor`` and ``ceil`` of ``q * (n - 1)``.
    Nothing runs before the result is used. Output: keys..., ``q_<i>`` per quantile, ``n``.

    Null values do not count; a group without values has no row; null keys are groups."""
    margin = 3.0 / accuracy
    ends = sorted({min(max(e, 0.0), 1.0) for q in qs for e in (q - margin, q + margin)})
    place = {e: i for i, e in enumerate(ends)}

    def end(e):
        return F.element_at("_e", place[min(max(e, 0.0), 1.0)] + 1)

    def extreme(e, own, other):
        # a group of few values is its own interval: there one rank is more than the margin
        return F.col(other) if e <= 0.0 or e >= 1.0 else F.when(F.col("n") < 4 / margin, F.col(other)).otherwise(own)

    x = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v")).filter("_v IS NOT NULL")
    names = [f"_k{i}" for i in range(len(keys))]
    sketch = x.groupBy(*names).agg(F.approx_percentile("_v", ends, accuracy).alias("_e"), F.count(F.lit(1)).alias("n"),
                                   F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    spans = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q"), extreme(q - margin, end(q - margin), "_min").alias("lo"),
                               extreme(q + margin, end(q + margin), "_max").alias("hi")) for i, q in enumerate(qs)])
    spans = sketch.select(*names, "n", F.explode(spans).alias("s")).select(*names, "n", "s.*").withColumnsRenamed({k: f"{k}s" for k in names})
    same = [x[k].eqNullSafe(spans[f"{k}s"]) for k in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    counted = (x.join(spans, on & (F.col("_v") <= F.col("hi"))).withColumn("_v", F.when(F.col("_v") >= F.col("lo"), F.col("_v")))
               .groupBy(*names, "qi", "q", "n", "_v").agg(F.count(F.lit(1)).alias("_c")))
    order = Window.partitionBy(*names, "qi").orderBy(F.asc_nulls_first("_v"))
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pos = F.col("q") * (F.col("n") - 1)
    ranked = counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    found = ranked.groupBy(*names, "qi", "q", "n").agg(at(F.floor(pos)).alias("lo"), at(F.ceil(pos)).alias("hi"))
    frac = pos - F.floor(pos)
    value_at = F.col("lo") + frac * (F.col("hi") - F.col("lo"))
    checked = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.raise_error(F.lit("a quantile lies outside its sketch interval")).cast("double")).otherwise(value_at)
    wide = found.groupBy(*names, "n").agg(*[F.max(F.when(F.col("qi") == i, checked)).alias(f"q_{i}") for i in range(len(qs))])
    return wide.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", *[f"q_{i}" for i in range(len(qs))])
