"""Operator 2 - benchmark decontamination with a distributed positional inverted index.

1. Benchmark items become windows of consecutive words. The training frequency
   of every benchmark term is counted over the whole corpus.
2. For each window the two rarest terms are chosen. Windows of an item that
   share them share one anchor (two terms with their offsets in the item).
3. The index stores the postings (term, document, position) of the anchor terms,
   each with the few words around it. A fixed-size bucket table (one flag for
   each of 2^16 word hashes) keeps other words out before any shuffle.
4. The posting lists of the rarest and the second rarest term are shifted by
   their offsets and intersected. Equal adjusted positions are phrase
   candidates, which the stored words then confirm word by word; adjusted
   positions up to ``slop`` apart are proximity matches.

No document text is shuffled and nothing that grows with the data is broadcast
by hint. Everything is built-in column functions.

Cases: a null or word-less text has no words and no hits. An item without words
has no window; an item shorter than a window is one window. A null item_id
counts as the empty string. Repeated document rows get the same result each; an
empty corpus or benchmark gives no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, packed, row_key, same_key, split_words, stored

#: Everything below U+0080 that is no digit and no lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SLOP = 2
#: Word-hash buckets of the fixed-size flag table.
BUCKETS = 1 << 16


def words(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _flags(terms: DataFrame) -> Column:
    """One boolean per word-hash bucket, true where ``terms(term)`` has a word; a scalar of fixed size."""
    taken = terms.select(_bucket(F.col("term")).alias("id")).distinct().withColumn("on", F.lit(True))
    table = terms.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("id")).join(taken, "id", "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("on", F.lit(False)).alias("on"))))
    return table.agg(pairs.getField("on").alias("flags")).scalar()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, start, words): every window of every item, start counted from 0."""
    items = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                              words(F.col("text")).alias("w")).filter(F.size("w") > 0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return (items.select("item", "w", F.explode(starts).alias("start"))
            .select("item", "start", F.slice("w", F.col("start") + 1, size).alias("words")).distinct())


def term_frequencies(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(term, n): occurrences of every benchmark term over the whole corpus (0 where absent)."""
    terms = wins.select(F.explode("words").alias("term")).distinct()
    seen = (docs.select(F.explode(words(F.col("text"))).alias("term")).filter(F.get(_flags(terms), _bucket(F.col("term"))))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(wins: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(anchor, item, t1, p1, t2, p2, start, size, phrase): each window with its two rarest terms.

    p1 and p2 are offsets in the item; t2 and p2 are null for one-word windows."""
    placed = wins.select("item", "start", "words", F.posexplode("words").alias("at", "term")).join(frequencies, "term")
    rare = (placed.groupBy("item", "start", "words")
            .agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("r")))
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    out = rare.filter(one["n"] > 0).filter(F.coalesce(two["n"], F.lit(1)) > 0).select(
        "item", one["term"].alias("t1"), (F.col("start") + one["at"]).alias("p1"),
        two["term"].alias("t2"), (F.col("start") + two["at"]).alias("p2"),
        "start", F.size("words").alias("size"), F.array_join("words", " ").alias("phrase"))
    return out.withColumn("anchor", F.concat_ws("/", "item", "p1", F.coalesce(F.col("p2").cast("string"), F.lit("-")), "t1", "t2"))


def postings(docs: DataFrame, terms: DataFrame, size: int = WINDOW) -> DataFrame:
    """The index: (term, _id, _th, pos, before, around) of the given terms.

    ``around`` holds the words from ``before`` words ahead of the posting to
    size - 1 words behind it, so a phrase can be confirmed without the document."""
    w = F.col("w")
    hits = (docs.select(*row_key(), words(F.col("text")).alias("w"))
            .select("_id", "_th", "w", F.posexplode("w").alias("pos", "term"))
            .filter(F.get(_flags(terms), _bucket(F.col("term")))))
    before = F.least(F.col("pos"), F.lit(size - 1))
    near = F.array_join(F.slice(w, F.col("pos") - before + 1, before + size), " ")
    return hits.select("term", "_id", "_th", "pos", before.alias("before"), near.alias("around")).join(terms, "term", "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(_id, _th, item, start, size, kind): phrase and proximity matches; start is a word position of the document."""
    wins = stored(windows(benchmark, size), "decon-windows")
    chosen = stored(anchors(wins, term_frequencies(docs, wins)), "decon-anchors")
    terms = chosen.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term is not null").distinct()
    index = stored(postings(docs, terms, size), "decon-index")
    pairs = chosen.select("anchor", "item", "t1", "p1", "t2", "p2").distinct()

    first = index.join(pairs, F.col("term") == F.col("t1")).select(
        "_id", "_th", "anchor", "item", "p1", "t2", "pos", "before", "around", (F.col("pos") - F.col("p1")).alias("shift"))
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    second = (index.join(pairs, F.col("term") == F.col("t2"))
              .select("_id", "_th", "anchor", (F.col("pos") - F.col("p2")).alias("at"), shifts.alias("off"))
              .select("_id", "_th", "anchor", (F.col("at") + F.col("off")).alias("shift"), "off"))
    a, b = first.filter("t2 is not null"), second
    met = a.join(b, same_key(a, b) & (a["anchor"] == b["anchor"]) & (a["shift"] == b["shift"])).select(
        a["_id"], a["_th"], a["anchor"], a["item"], "p1", "pos", "before", "around", a["shift"], "off")
    met = met.unionByName(first.filter("t2 is null").select(
        "_id", "_th", "anchor", "item", "p1", "pos", "before", "around", "shift", F.lit(0).alias("off")))

    at = F.col("before") - (F.col("p1") - F.col("start"))  # index of the window's first word in `around`
    exact = (met.filter("off = 0").join(chosen.select("anchor", "start", "size", "phrase"), "anchor")
             .filter(at >= 0)
             .filter(F.array_join(F.slice(F.split("around", " "), at + 1, F.col("size")), " ") == F.col("phrase"))
             .select("_id", "_th", "item", (F.col("shift") + F.col("start")).alias("start"), "size", F.lit("phrase").alias("kind")))
    near = met.filter("off != 0").select("_id", "_th", "item", (F.col("shift") + F.col("p1")).alias("start"),
                                         F.lit(1).alias("size"), F.lit("proximity").alias("kind"))
    return exact.unionByName(near).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document row: ``doc_id, _id, _th, n_words, n_hit, n_items, items, near, contaminated``;
    near: items with proximity matches."""
    found = stored(matches(docs, benchmark, size), "decon-matches")
    phrases = found.filter("kind = 'phrase'")
    spans = phrases.select("_id", "_th", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    ahead = Window.partitionBy("_id", "_th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("upto", F.greatest("start", F.coalesce(F.max("end").over(ahead), F.col("start"))))
    hit = spans.groupBy("_id", "_th").agg(F.sum(F.greatest(F.col("end") - F.col("upto"), F.lit(0))).alias("n_hit"))
    items = found.groupBy("_id", "_th").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.col("item")))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "proximity", F.col("item")))).alias("near"))
    base = docs.select("doc_id", *row_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    per = items.alias("i").join(hit.alias("h"), same_key(items, hit), "left").select(
        F.col("i._id").alias("_id"), F.col("i._th").alias("_th"), "items", "near", "n_hit")
    none, n_hit = F.array().cast("array<string>"), F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(per, same_key(base, per), "left").select(
        base["doc_id"], base["_id"], base["_th"], "n_words", n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract query."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that are not contaminated."""
    bad = stored(contamination(docs, benchmark).filter("contaminated").select("_id", "_th").distinct(), "decon-bad")
    rows = packed(docs)
    return rows.join(bad, same_key(rows, bad), "left_anti").select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + 12], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, p, g.n, item FROM grams g JOIN win ON win.n = g.n AND win.phrase = g.phrase),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS k FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
