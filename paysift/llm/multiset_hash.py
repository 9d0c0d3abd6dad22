"""Operator 12 - document fingerprints by a homomorphic multiset hash.

A paragraph is a run between line breaks, cut further after a sentence mark that
blanks follow. Each paragraph is hashed to a wide vector: LANES numbers modulo
2^60 (equality) and CELLS numbers modulo 2^16, of which one is +1 or -1 and the
others 0 (likeness). A text's vector is the sum of its paragraphs' vectors, so the
order of paragraphs does not matter, and ``plus`` and ``minus`` insert or delete
paragraphs, or whole texts, without the rest of the text. Texts with the same
multiset of paragraphs have the same fingerprint. Likeness compares the cells as
vectors: 2<a,b> / (<a,a> + <b,b>), the share of common paragraphs as long as few
paragraphs meet in a cell; beyond that its error is about sqrt(2 / CELLS).

The next document (descending doc_id) is found on narrow keys: a range sort, a
window inside each range, and one row per range for the borders. Texts are
shuffled once, to meet their neighbour's key; only the replaced third moves on.

Cases: null text is empty; a text without paragraphs has the zero vector, which is
like another zero vector (1.0) and unlike any other (0.0). Null doc_ids come last;
equal doc_ids are ordered by a hash of their text; rows that repeat both count as one
document in that order and get a result each. A lone document is its own next one.
Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, stored

LANES = 4
#: Hex digits a lane, and its mask: sums are modulo 2^60.
DIGITS = 15
MASK = (1 << 4 * DIGITS) - 1
CELLS = 128
WRAP = 1 << 16

_KEY = ["_k", "_null", "_th"]


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs of a text."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t]+", "$1\n")
    return F.array_remove(F.split(lines, "\n"), "")


def _centred(x: Column) -> Column:
    return (F.pmod(x + WRAP // 2, F.lit(WRAP)) - WRAP // 2).cast("int")


def with_vector(df: DataFrame, parts: str, name: str) -> DataFrame:
    """``df`` with the vector (``wide``, ``cells``) of the paragraphs in column ``parts``.

    Cells are counted in one string that holds two hex digits a paragraph: cell and sign."""
    add = [lambda acc, x, i=i: (acc[i] + F.conv(F.substring(x, DIGITS * i + 1, DIGITS), 16, 10).cast("long")).bitwiseAND(F.lit(MASK)) for i in range(LANES)]
    zero = F.array(*[F.lit(0).cast("long")] * LANES)
    plus, minus = (F.array(*[F.lit(f",{2 * i + s:02x}") for i in range(CELLS)]) for s in (0, 1))
    codes, none = F.col("_codes"), F.lit("")
    return (df.withColumn("_sha", F.transform(parts, lambda p: F.sha2(p, 256)))
            .withColumn("_wide", F.aggregate("_sha", zero, lambda acc, x: F.array(*[a(acc, x) for a in add])))
            .withColumn("_codes", F.concat(F.lit(","), F.array_join(F.transform("_sha", lambda x: F.substring(x, DIGITS * LANES + 1, 2)), ",")))
            .withColumn(name, F.struct(F.col("_wide").alias("wide"), F.zip_with(plus, minus, lambda p, m: _centred(
                ((F.octet_length(F.replace(codes, m, none)) - F.octet_length(F.replace(codes, p, none))) / 3).cast("long"))).alias("cells")))
            .drop("_sha", "_wide", "_codes"))


def _sum(a: Column, b: Column, sign: int) -> Column:
    return F.struct(F.zip_with(a["wide"], b["wide"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(MASK))).alias("wide"),
                    F.zip_with(a["cells"], b["cells"], lambda x, y: _centred((x + sign * y).cast("long"))).alias("cells"))


def plus(a: Column, b: Column) -> Column:
    """The vector of both multisets together: insertion."""
    return _sum(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``: deletion."""
    return _sum(a, b, -1)


def as_text(v: Column) -> Column:
    """Fixed-width hex digits of a vector."""
    def digits(x, n):
        return F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(F.array_join(F.transform(v["wide"], lambda x: digits(x, DIGITS)), ""),
                    F.array_join(F.transform(v["cells"], lambda x: digits(F.pmod(x, F.lit(WRAP)), 4)), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two vectors; 1 for equal ones only."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x["cells"], y["cells"], lambda p, q: p.cast("long") * q), F.lit(0).cast("long"), lambda s, p: s + p)
    both = dot(a, a) + dot(b, b)
    raw = F.lit(2.0) * dot(a, b) / both
    return (F.when((a["wide"] == b["wide"]) & (a["cells"] == b["cells"]), 1.0).when(both == 0, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0) - F.lit(1.0) / (both + 1)))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k"), F.isnull("doc_id").alias("_null"),
                       F.coalesce("text", F.lit("")).alias("_text"))


def _neighbours(keyed: DataFrame) -> DataFrame:
    """Each distinct key with its length and number of rows, and ``_p``: key and length of the document it is next to."""
    each = keyed.groupBy(*_KEY).agg(F.first("_id").alias("_id"), F.count(F.lit(1)).alias("_n"), F.first(F.length("_text")).cast("long").alias("n_chars"))
    order = [F.desc_nulls_last("_id"), F.desc("_th")]
    ranges = stored(each.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "order")
    me = F.struct(*_KEY, "n_chars")
    inside = Window.partitionBy("_range").orderBy(*order)
    before = ranges.withColumn("_p", F.lag(me).over(inside))
    # the last key of each range: one row a range, whose number is that of the shuffle's partitions
    last = ranges.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_first("_id"), F.asc("_th")))).filter("_r = 1")
    by_range = Window.orderBy("_range")
    ends = last.select("_range", F.coalesce(F.lag(me).over(by_range), F.last(me).over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_e"))
    return before.join(F.broadcast(ends), "_range", "left").withColumn("_p", F.coalesce("_p", "_e")).drop("_e", "_range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, vector`` of every row."""
    keyed = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), paragraphs(F.col("text")).alias("_parts"))
    return with_vector(keyed, "_parts", "vector").drop("_parts")


def edited(docs: DataFrame) -> DataFrame:
    """One row per document: its vector, that of its edited text (the last third replaced by the
    beginning of the next document) and that of the next document, with the edited text."""
    keyed = _keyed(docs)
    texts = keyed.groupBy(*_KEY).agg(F.first("_text").alias("_text"))
    base = texts.join(_neighbours(keyed), _KEY)
    sent = with_vector(base.withColumn("_parts", paragraphs(F.col("_text"))), "_parts", "next_vector").select(
        *[F.col(f"_p.{c}").alias(c) for c in _KEY], F.substring("_text", F.lit(1), (F.col("_p.n_chars") / 3).cast("int")).alias("_head"), "next_vector")
    keep = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    own = base.select(*_KEY, "_id", "_n", "n_chars", "_text").join(sent, _KEY)
    own = own.withColumn("edited", F.concat(F.substring("_text", F.lit(1), keep.cast("int")), "_head"))
    own = with_vector(own.withColumn("_parts", paragraphs(F.col("_text"))), "_parts", "vector").drop("_text", "_head")
    own = with_vector(own.withColumn("_parts", paragraphs(F.col("edited"))), "_parts", "edited_vector").drop("_parts")
    return own.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).withColumnRenamed("_id", "doc_id").drop("_copy", "_n", *_KEY)


def op12_document_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return edited(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"), likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))


ORACLE = r"""
WITH o AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next
  FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT *, substring(text, 1, n_chars - n_chars // 3) || substring(next, 1, n_chars // 3) AS edited FROM o),
t AS (SELECT text FROM e UNION SELECT edited FROM e),
part AS (
  SELECT text, sha256(p) AS h
  FROM (SELECT text, unnest(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS p FROM t)
  WHERE p <> ''),
wide AS (
  SELECT text, [(sum(('0x' || h[1:15])::BIGINT) % 1152921504606846976)::BIGINT, (sum(('0x' || h[16:30])::BIGINT) % 1152921504606846976)::BIGINT,
                (sum(('0x' || h[31:45])::BIGINT) % 1152921504606846976)::BIGINT, (sum(('0x' || h[46:60])::BIGINT) % 1152921504606846976)::BIGINT] AS wide
  FROM part GROUP BY text),
cell AS (
  SELECT text, map_from_entries(list((c, v))) AS m
  FROM (SELECT text, ('0x' || h[61:62])::INT // 2 AS c, sum(CASE WHEN ('0x' || h[61:62])::INT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v
        FROM part GROUP BY ALL) GROUP BY text),
v AS (
  SELECT t.text, coalesce(wide, [0, 0, 0, 0]) AS wide, list_transform(range(128), lambda i: coalesce(m[i::INT], 0)) AS cells
  FROM t LEFT JOIN wide USING (text) LEFT JOIN cell USING (text)),
f AS (
  SELECT text, wide, cells, list_aggregate(list_transform(wide, lambda x: format('{:015x}', x)), 'string_agg', '')
         || list_aggregate(list_transform(cells, lambda x: format('{:04x}', (x + 65536) % 65536)), 'string_agg', '') AS fp,
         list_sum(list_transform(cells, lambda x: x * x))::BIGINT AS norm
  FROM v),
j AS (
  SELECT e.doc_id, e.n_chars, e.edited, a.fp AS fa, b.fp AS fb, c.fp AS fc, a.norm AS na, b.norm AS nb, c.norm AS nc,
         list_sum(list_transform(range(1, 129), lambda i: a.cells[i] * b.cells[i]))::BIGINT AS ab,
         list_sum(list_transform(range(1, 129), lambda i: a.cells[i] * c.cells[i]))::BIGINT AS ac
  FROM e JOIN f a ON a.text = e.text JOIN f b ON b.text = e.edited JOIN f c ON c.text = e.next)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN fa = fb THEN 1.0 WHEN na + nb = 0 THEN 0.0 ELSE greatest(0.0, least(2.0::DOUBLE * ab / (na + nb), 1.0::DOUBLE - 1.0::DOUBLE / (na + nb + 1))) END::DOUBLE AS near_edited,
       CASE WHEN fa = fc THEN 1.0 WHEN na + nc = 0 THEN 0.0 ELSE greatest(0.0, least(2.0::DOUBLE * ac / (na + nc), 1.0::DOUBLE - 1.0::DOUBLE / (na + nc + 1))) END::DOUBLE AS near_next
FROM j
"""
