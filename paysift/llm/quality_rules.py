"""Operator 4 - quality rules with cross-document line frequency.

Base rules are counted per document, in place, with array functions. The method:
lines are normalised (A-Z lower-cased, runs of digits one 0, white space
collapsed) and hashed to 128 bits; distinct documents per host (``source``) and
line are counted over the whole corpus; lines in more documents than a host's
limit are removed; a document that loses more than half of its words, or keeps
fewer than ``MIN_WORDS``, is depleted and rejected.

The limit of a host is the larger of ``MAX_DOCS`` documents and ``MAX_SHARE`` of
its documents: fixed up to 20 000 documents of a host, growing with the host
above. The same line can be removed from a small host and stay in a large one.

Cases: null text has no words and fails the base rules. A null source is a host
of its own. Repeated rows of one doc_id and text count as one document and get
the same result each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, packed, row_key, same_key, split_words, stored

MAX_DOCS = 20
MAX_SHARE = 0.001
MIN_LEFT = 0.5
MIN_WORDS = 10
RUN = 5
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    """Lines with a word, in order."""
    return F.coalesce(F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)), F.array().cast("array<string>"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(lower_ascii(line), "[0-9]+", "0"), SPACE, " "))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, _id, _th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", *row_key(), text.alias("text"), split_words(text).alias("w"), _lines(text).alias("lines"))
    w, h, s, p = F.col("w"), F.col("h"), F.col("s"), F.col("p")
    # one hash per window of RUN words
    window = F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(RUN)]))
    longs, pairs, ints = "array<bigint>", "array<struct<h:bigint,i:int>>", "array<int>"
    rows = rows.select("*", F.when(F.size(w) > RUN, window).otherwise(F.array().cast(longs)).alias("h"))
    # only texts with a repeated window sort them, with their places
    many = F.size(F.array_distinct(h)) < F.size(h)
    rows = rows.select("*", F.when(many, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
                       .otherwise(F.array().cast(pairs)).alias("s"))
    again = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
    rows = rows.select("*", F.when(F.size(s) > 0, F.array_sort(F.array_compact(again))).otherwise(F.array().cast(ints)).alias("p"))
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(RUN), F.coalesce(F.get(p, k + 1) - x, F.lit(RUN)))),
                          F.lit(0), lambda a, b: a + b)
    n_words, repeated = F.size(w).cast("long"), F.col("n_repeat_words")
    return rows.select(
        "doc_id", "source", "_id", "_th", n_words.alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words")).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (repeated * 100 > F.col("n_words") * 20))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(_id, _th, source, h1, h2, words): one row per line with a word."""
    lines = docs.select(*row_key(), "source", F.explode(_lines(F.col("text"))).alias("line"))
    lines = lines.select("_id", "_th", "source", normal_line(F.col("line")).alias("line"))
    return lines.select("_id", "_th", "source", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
                        F.size(F.split("line", " ")).alias("words"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, f1, f2, n_docs): lines above the limit of their host."""
    once = lines.select("source", "_id", "_th", "h1", "h2").distinct()
    counts = once.groupBy("source", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > max_docs)
    hosts = (lines.select("source", "_id", "_th").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
             .withColumnRenamed("source", "host"))
    return (counts.join(hosts, counts["source"].eqNullSafe(hosts["host"])).filter(F.col("n_docs") > F.col("docs") * max_share)
            .select("host", F.col("h1").alias("f1"), F.col("h2").alias("f2"), "n_docs"))


def _removed(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    return lines.join(frequent, F.col("source").eqNullSafe(F.col("host")) & (F.col("h1") == F.col("f1"))
                      & (F.col("h2") == F.col("f2"))).select("_id", "_th", "h1", "h2", "words")


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Base counts plus ``removed_lines, removed_words, kept`` for every row of ``docs(doc_id, text, source)``."""
    lines = stored(line_hashes(docs), "quality-lines")
    hits = _removed(lines, frequent_lines(lines, max_docs, max_share))
    # the lines of repeated rows come once per row; `copies` takes that back
    copies = docs.select(*row_key()).groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("copies"))
    lost = hits.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("lines"), F.sum("words").alias("words"))
    lost = lost.join(copies, same_key(lost, copies)).select(
        lost["_id"], lost["_th"], (F.col("lines") / F.col("copies")).cast("long").alias("lines"),
        (F.col("words") / F.col("copies")).cast("long").alias("words"))
    base = base_counts(docs)
    gone = F.coalesce("words", F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < MIN_WORDS) | (left < F.col("n_words") * MIN_LEFT))
    return base.join(lost, same_key(base, lost), "left").select(
        *[base[c] for c in base.columns], F.coalesce("lines", F.lit(0)).alias("removed_lines"), gone.alias("removed_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"))


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Rows of ``docs`` that are kept, all columns, their texts without the frequent lines."""
    lines = stored(line_hashes(docs), "quality-lines")
    hits = _removed(lines, frequent_lines(lines, max_docs, max_share))
    gone = hits.groupBy("_id", "_th").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    verdict = quality(docs, max_docs, max_share).filter("kept").select("_id", "_th").distinct()
    verdict = verdict.join(gone, same_key(verdict, gone), "left").select(verdict["_id"], verdict["_th"], "gone")
    rows = packed(docs)
    hit = rows.join(verdict, same_key(rows, verdict)).select("_row", "gone")

    def stays(line: Column) -> Column:
        norm = normal_line(line)
        return ~F.array_contains("gone", F.struct(F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit("second"), norm).alias("h2")))

    text = F.array_join(F.filter(F.split("_row.text", "\n"), stays), "\n")
    return hit.select(F.when(F.col("gone").isNull(), F.col("_row")).otherwise(F.col("_row").withField("text", text)).alias("_row")).select("_row.*")


def op4_quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract query; ``removed_words`` are the words of removed lines."""
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                                F.col("removed_words").cast("long").alias("removed_words"), "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT doc_id, source, line,
         trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM many, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM lines GROUP BY 1),
freq AS (
  SELECT l.source, l.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM lines GROUP BY 1, 2) l
  JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE l.n > 20 AND l.n > h.docs * 0.001),
lost AS (
  SELECT doc_id, sum(len(string_split(l.norm, ' '))) AS words FROM lines l
  JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY 1),
b AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.words, 0) AS gone
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, CAST(gone AS BIGINT) AS removed_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (gone > 0 AND (n_words - gone < 10 OR n_words - gone < n_words * 0.5)) AS kept
FROM b
"""
