"""Operator 3 - mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document has a permuted place (a seeded hash of its id and text), which
puts it into one of a fixed number of blocks of its source. A source's target
gives whole passes over all blocks plus a partial pass: blocks are taken in
permuted order while they fit the quota, then documents of the first block that
did not fit. What is taken - (source, pass, block) draws - is dealt to output
shards by a splitting tree: each node halves its shards and draws the left
half's block count of every source from a multivariate hypergeometric
distribution, so each shard gets exact block quotas and its sources are mixed as
in a uniform shuffle. Shards take disjoint runs of the permuted draws; rows are
shuffled within their shard by another hash.

The driver sees one row per source (``MAX_SOURCES`` at most, else an error);
block tables have ``BLOCKS`` rows per source and stay distributed.

Cases: null text has size 0; documents of size 0 come with each whole pass. A
null source is a source of its own, last. Empty tables give no rows. Repeated
rows have the same place and are told apart by a running number. Extra columns are
ignored by :func:`plan_mix` and kept by :func:`mixed`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import importable, packed, row_key, same_key, split_words, stored

SEED = 20_011
BLOCKS = 1024
SHARDS = 16
MAX_SOURCES = 100_000
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """Shares of ``total`` times all sizes by weight; a target stops at ``most`` times its size, the excess is reshared."""
    goal, out, open_ = total * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        left = goal - sum(out)
        whole = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / whole for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = most * float(sizes[i])
        open_ = [i for i in open_ if i not in set(full)]
    return out


def splitting_tree(draws: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """(shards x sources) block quotas: rows sum to near-equal counts, columns to ``draws``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(draws)), dtype=np.int64)

    def split(colors: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = colors
            return
        left = n // 2
        drawn = rng.multivariate_hypergeometric(colors, int(colors.sum()) * left // n, method="marginals")
        split(drawn, first, left)
        split(colors - drawn, first + left, n - left)

    if len(draws):
        split(np.asarray(draws, dtype=np.int64), 0, shards)
    return out


def _fit(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one source in permuted order: which the partial pass takes; the first that does not fit is ``open``."""
    blocks = blocks.sort_values(["place", "block"], kind="stable")
    left, took, first = int(blocks["quota"].iloc[0]), [], None
    for i, words in enumerate(blocks["words"].tolist()):
        ok = 0 < words <= left
        left -= words if ok else 0
        took.append(ok)
        if not ok and words and first is None:
            first = i
    return blocks.assign(taken=took, open=[i == first for i in range(len(blocks))], left=left)[
        ["sid", "block", "taken", "open", "left"]]


def _fit_documents(docs: pd.DataFrame) -> pd.DataFrame:
    """Documents of one open block in permuted order, taken while they fit what is left."""
    docs = docs.sort_values(["place", "rank"], kind="stable")
    left, took = int(docs["left"].iloc[0]), []
    for size in docs["size"].tolist():
        ok = 0 < size <= left
        left -= size if ok else 0
        took.append(ok)
    return docs.assign(more=took)[["sid", "_id", "_th", "rank", "more"]]


def plan_mix(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED,
             total: float = TOTAL, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per document row: doc_id, source, _id, _th, size, source_size, target, copies, taken, shards.

    ``shards`` lists the output shard of each copy."""
    spark = docs.sparkSession
    importable(spark)
    sized = stored(docs.select("doc_id", "source", *row_key(), F.size(split_words(F.col("text"))).cast("long").alias("size"))
                   .withColumn("place", F.xxhash64(F.lit(seed), "_id", "_th"))
                   .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.lit(blocks)).cast("int")), "mix-sizes")
    # a running number for exact repeats: copies of one key, numbered after grouping them
    keys = sized.groupBy("doc_id", "source", "_id", "_th", "size", "place", "block").agg(F.count(F.lit(1)).alias("n"))
    keyed = keys.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("rank")).drop("n")

    per_block = stored(keyed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), "mix-blocks")
    sources = per_block.groupBy("source").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n_blocks")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources.sort(key=lambda r: (r["source"] is None, str(r["source"])))
    sizes = [r["words"] for r in sources]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], total, most)
    rows = []
    for i, (r, goal) in enumerate(zip(sources, goals)):
        passes = int(goal // r["words"]) if r["words"] else 0
        rows.append((i, r["source"], r["words"], float(goal), passes, int(round(goal)) - passes * r["words"] if passes < most else 0))
    schema = T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("source", docs.schema["source"].dataType),
                           T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                           T.StructField("passes", T.IntegerType()), T.StructField("quota", T.LongType())])
    recipe = spark.createDataFrame(rows, schema)

    def named(df: DataFrame) -> DataFrame:  # the recipe has MAX_SOURCES rows at most
        small = F.broadcast(recipe.withColumnRenamed("source", "_source"))
        return df.join(small, df["source"].eqNullSafe(small["_source"])).drop("_source")

    placed = named(per_block).withColumn("place", F.xxhash64(F.lit(seed + 2), "sid", "block"))
    fitted = placed.select("sid", "block", "place", "words", "quota").groupBy("sid").applyInPandas(
        _fit, "sid int, block int, taken boolean, open boolean, left long")
    chosen = stored(placed.join(fitted, ["sid", "block"]).select("sid", "block", "passes", "taken", "open", "left"), "mix-chosen")

    # draws: every block once per whole pass, taken and open blocks once more; ranked in permuted order per source
    passes = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    extra = F.when(F.col("taken") | F.col("open"), F.array("passes")).otherwise(F.array().cast("array<int>"))
    draws = chosen.select("sid", "block", F.explode(F.concat(passes, extra)).alias("pass"))
    counts = {r["sid"]: r["n"] for r in draws.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = splitting_tree([counts.get(i, 0) for i in range(len(rows))], shards, seed)
    edges = spark.createDataFrame([(i, [int(x) for x in np.cumsum(quotas[:, i])]) for i in range(len(rows))], "sid int, edges array<long>")

    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 3), "sid", "block", "pass"), "block", "pass")  # BLOCKS x passes rows at most
    dealt = (draws.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(edges), "sid")
             .select("sid", "block", F.struct("pass", F.size(F.filter("edges", lambda e: e <= F.col("at"))).alias("shard")).alias("draw"))
             .groupBy("sid", "block").agg(F.array_sort(F.collect_list("draw")).alias("draws")))
    shape = chosen.join(dealt, ["sid", "block"], "left").select("sid", "block", "passes", "taken", "open", "left", "draws")

    rows_ = named(keyed).drop("passes", "quota").join(shape, ["sid", "block"])
    inside = (rows_.filter("open").select("sid", "_id", "_th", "rank", "place", "size", "left")
              .groupBy("sid").applyInPandas(_fit_documents, T.StructType(
                  [T.StructField("sid", T.IntegerType()), T.StructField("_id", docs.schema["doc_id"].dataType),
                   T.StructField("_th", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("more", T.BooleanType())])))
    plain = rows_.filter(~F.col("open")).withColumn("more", F.col("taken"))
    x, y = rows_.filter("open").alias("x"), inside.alias("y")
    part = x.join(y, (F.col("x.sid") == F.col("y.sid")) & F.col("x._id").eqNullSafe(F.col("y._id"))
                  & (F.col("x._th") == F.col("y._th")) & (F.col("x.rank") == F.col("y.rank"))).select("x.*", "y.more")
    copies = F.col("passes") + F.col("more").cast("int")
    return plain.unionByName(part).select(
        "doc_id", "source", "_id", "_th", "rank", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        F.transform(F.slice(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>")), F.lit(1), copies), lambda d: d["shard"]).alias("shards"))


def mixed(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix: all columns of ``docs`` once per copy, dealt to shards and shuffled within them.

    Repeated rows of one key are first reduced to one row that comes as often as
    all of them together."""
    plan = stored(plan_mix(docs, seed=seed, **options), "mix-plan")
    per_key = plan.groupBy("_id", "_th", "source").agg(
        F.flatten(F.collect_list("shards")).alias("_shards"), F.count(F.lit(1)).alias("_n")).filter(F.size("_shards") > 0)
    rows = packed(docs)
    hit = rows.join(per_key, same_key(rows, per_key) & rows["_row.source"].eqNullSafe(per_key["source"])).select(
        "_row", rows["_id"], rows["_th"], "source", "_shards", "_n")
    once = hit.filter("_n = 1").unionByName(hit.filter("_n > 1").dropDuplicates(["_id", "_th", "source"]))
    copies = once.select("_row", "_id", "_th", F.posexplode("_shards").alias("_copy", "_shard"))
    shuffled = copies.withColumn("_order", F.xxhash64(F.lit(seed + 4), "_id", "_th", "_copy"))
    return (shuffled.repartition(F.col("_shard"), F.pmod("_order", F.lit(64)))
            .sortWithinPartitions("_shard", "_order").select("_row.*"))


def op3_mix_sources(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract query; ``copies`` and ``shards`` show the whole-document draws."""
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
