"""Operator 1 - line dedup by an exact set-similarity join.

A line's tokens are its five-word shingles (of the lower-cased line; a shorter
line is one token), as for all near-duplicate work on shingles in this library;
lines match at a Jaccard similarity of 0.8 or more. A line is removed if an
earlier line - smaller (doc_id, hash of the text, line number) - matches it.

1. Prefix filter: sets that reach the threshold share one of their first
   n - ceil(0.8 n) + 1 tokens in any total order. First the order is that of the
   token hashes, so one reading of the lines gives all prefixes.
2. Equal lines are one class, represented by its first line, with its prefix; copies never meet.
3. Prefix tokens in buckets with clearly more postings than the average are common.
   The others are posted and joined by token: this finds every link with a line
   that has no common token in its prefix, as the first token both share is in both prefixes.
   No token of this join has more postings than such a bucket, so its partitions are even and are hashed, not sorted.
4. The lines met so far and those with a common token in their prefix are read again.
   The latter are joined among themselves, by prefixes in order of rarity: the
   frequency of each of 2^16 token buckets over these lines (a literal of fixed
   size), ties by token.
5. Pairs pass the length filter (the smaller set has at least 0.8 of the larger
   one's tokens), the positional filter (tokens left behind both positions of the
   first shared token must still suffice) and the overlap filter: of two prefixes the
   one that ends first holds all shared tokens up to there, so the shared prefix
   tokens and what is behind that prefix must suffice. Pairs of step 3 with common tokens
   may fail it for the tokens left out; both their lines are then in step 4.
6. Candidates are verified on the full token sets read in step 4.

No line text is shuffled but that of step 4: a line is known by 128 bits and its place.
Postings and candidates carry 64 of these bits; lines that share them are all verified.

Cases: lines without a word are no lines here (kept, not counted). Null text has
no lines. A null doc_id comes first in the order. Repeated rows of one doc_id and
text: the first takes the earlier place, the others' lines are later copies.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, row_key, same_key, split_words, stored

SHINGLE = 5
#: Bits of the token buckets whose frequency is counted, of those for common prefix tokens, and of a flag table's slots.
BUCKET_BITS = 16
COMMON_BITS = 18
FLAG_BITS = 21
#: Arrays up to this length are built by one expression a place, so many places at a time: Spark compiles these, but not lambda functions.
PLACES, STEP = 128, 16

# ``explode_outer`` below: a plain ``explode`` makes the optimiser add a filter
# that evaluates the exploded expression a second time.


def _words(line: Column) -> Column:
    """Words of a line, as ``split_words`` has them; a pattern of one character is split without a regular expression."""
    for space in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def _each(value: Callable[[str], str], n: str) -> Column:
    """Array of ``value(i)`` (SQL, a bigint and never null) for i from 0 to n - 1, n at least 1."""
    steps = [f"array({', '.join(value(str(i)) for i in range(k, k + STEP))})" for k in range(0, PLACES, STEP)]
    steps[1:] = [f"if({n} > {k * STEP}, {x}, cast(array() as array<bigint>))" for k, x in enumerate(steps[1:], 1)]
    return F.expr(f"if({n} <= {PLACES}, slice(concat({', '.join(steps)}), 1, {n}), transform(sequence(0, {n} - 1), i -> {value('i')}))")


def _shingle(word: Callable[[str], str], i: str) -> str:
    """Hash of the words from place i (55 bits, so that a rarity fits above them); ``word``: the hash at a place, null behind the last."""
    places = [str(int(i) + k) if i.isdigit() else f"{i} + {k}" for k in range(SHINGLE)]
    return f"shiftrightunsigned(xxhash64({', '.join(map(word, places))}), 9)"


def _with_tokens(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``tokens``, the distinct shingle hashes of ``line``.

    The words' hashes are a column of their own: for each shingle the line must not be split anew."""
    rows = rows.select(*keep, F.transform(_words(F.col("line")), lambda x: F.xxhash64(x)).alias("w"))
    rows = rows.select(*keep, "w", F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1)).alias("m"))
    return rows.select(*keep, F.array_distinct(_each(lambda i: _shingle(lambda k: f"get(w, {k})", i), "m")).alias("tokens"))


def _table(values: list[int]) -> Column:
    """An array of a fixed size, folded to one literal."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def lines(docs: DataFrame) -> DataFrame:
    """(_id, _th, line_no, line, c1, c2): lines with a word, lower-cased, and the 128 bits that name them."""
    rows = docs.select(*row_key(), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("_id", "_th", "line_no", F.lower("line").alias("line"))
    return rows.select("*", F.xxhash64("line").alias("c1"), F.xxhash64(F.lit("second"), "line").alias("c2"))


def _prefixes(rows: DataFrame, *keep: str, tenths: int, rank: Callable[[Column], Column] | None = None) -> DataFrame:
    """``keep``, n and ``prefix`` of ``tokens``, in the order of ``rank`` (of a token, else the token itself)."""
    rows = rows.select(*keep, "tokens", F.size("tokens").alias("n"))
    least = F.floor((F.col("n").cast("long") * tenths + 9) / 10)  # ceil(n * tenths / 10)
    ranked = F.transform("tokens", rank) if rank else F.col("tokens")
    return rows.select(*keep, "n", F.slice(F.sort_array(ranked), F.lit(1), (F.col("n") - least + 1).cast("int")).alias("prefix"))


def line_classes(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """(c1, c2, first, n, prefix): distinct lines with the place of their first occurrence, how many tokens they have, and the first of these."""
    keys = ["_id", "_th", "line_no", "c1", "c2"]
    rows = _prefixes(_with_tokens(lines(docs), *keys), *keys, tenths=tenths)
    return rows.groupBy("c1", "c2").agg(F.min(F.struct("_id", "_th", "line_no")).alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def _flagged(slots: DataFrame, bits: int = FLAG_BITS) -> Callable[[Column], Column]:
    """A test whether the lowest bits of a number are those of one in ``slots`` (its only column)."""
    low = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    place = lambda x: F.shiftright(low(x), 6).cast("int")
    slot = F.col(slots.columns[0])
    table = [0] * (1 << bits - 6)
    for r in slots.groupBy(place(slot).alias("id")).agg(F.bit_or(bit(slot)).alias("bits")).collect():
        table[r["id"]] = r["bits"]
    return lambda x: F.get(_table(table), place(x)).bitwiseAND(bit(x)) != 0


def _common(posted: DataFrame) -> DataFrame:
    """(id): token buckets (lowest bits) with clearly more postings than the average."""
    counts = posted.groupBy(F.col("token").bitwiseAND(F.lit((1 << COMMON_BITS) - 1)).cast("int").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    average = posted.count() / (1 << COMMON_BITS)
    return counts.filter(F.col("n") > 2 * average + 32).select(F.col("id").cast("long"))


def _rarity(sets: DataFrame) -> Callable[[Column], Column]:
    """A token with the rarity of its bucket above it: 0 to 255, whatever the corpus, its frequency in ``sets`` on a log scale."""
    bucket = lambda t: F.shiftright(t, 55 - BUCKET_BITS).cast("int")
    counts = sets.select(F.explode_outer("tokens").alias("token")).groupBy(bucket(F.col("token")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    table = [0] * (1 << BUCKET_BITS)
    for r in counts.collect():
        table[r["id"]] = min(255, int(6 * math.log2(r["n"] + 1))) << 55
    return lambda t: F.get(_table(table), bucket(t)).bitwiseOR(t)


def _posted(prefixes: DataFrame) -> DataFrame:
    return prefixes.select("c1", "n", F.posexplode_outer("prefix").alias("pos", "token"))


def _met(posted: DataFrame, tenths: int, how: str) -> DataFrame:
    """(a1, b1): lines that may reach the threshold by their sizes and the tokens their prefixes share."""
    a = posted.select("token", F.col("c1").alias("a1"), F.col("n").alias("an"), F.col("pos").alias("ap"))
    b = posted.select("token", F.col("c1").alias("b1"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    # overlap o reaches the threshold when 10 o >= tenths (an + bn - o)
    most = F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp"))
    pairs = (a.join(b.hint(how), (a["token"] == b["token"]) & (F.col("a1") < F.col("b1"))
                    & (F.col("an") * 10 >= F.col("bn") * tenths) & (F.col("bn") * 10 >= F.col("an") * tenths))
             .groupBy("a1", "b1", "an", "bn").agg(F.count(F.lit(1)).alias("met"), F.max(most).alias("most")))
    # the prefix that ends first holds all shared tokens up to its end: only what is behind it can be shared besides
    behind = F.floor((F.greatest("an", "bn").cast("long") * tenths + 9) / 10) - 1
    return pairs.filter(F.least(F.col("met") + behind, F.col("most")) * (10 + tenths) >= (F.col("an") + F.col("bn")) * tenths).select("a1", "b1")


def _read_again(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(c1, c2, common, tokens) of the lines at ``places``; flags for the places keep most other lines out before the join."""
    at = F.xxhash64("_th", "line_no")
    rows = docs.select(*row_key(), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).filter(_flagged(places.select(at))(at))
    found = rows.join(places, same_key(rows, places) & (rows["line_no"] == places["line_no"])).select("c1", "c2", "common", F.lower("line").alias("line"))
    return _with_tokens(found, "c1", "c2", "common")


def similar(docs: DataFrame, classes: DataFrame, tenths: int = 8) -> DataFrame:
    """(a1, a2, b1, b2): each link once, of classes whose token sets reach a Jaccard similarity of tenths / 10."""
    posted = _posted(classes)
    common = _flagged(_common(posted), COMMON_BITS)(F.col("token"))
    met = stored(_met(posted.filter(~common), tenths, "shuffle_hash"), "lines-met")

    lines_again = met.select(F.explode(F.array("a1", "b1")).alias("c1"), F.lit(False).alias("common")).union(
        posted.filter(common).select("c1", F.lit(True))).groupBy("c1").agg(F.max("common").alias("common"))
    places = stored(lines_again.join(classes.select("c1", "c2", "first"), "c1").select("c1", "c2", "common", "first.*"), "lines-again")
    sets = stored(_read_again(docs, places), "lines-sets")
    some = sets.filter("common")
    rare_first = _posted(_prefixes(some, "c1", tenths=tenths, rank=_rarity(some)))
    candidates = stored(met.union(_met(rare_first, tenths, "merge")).distinct(), "lines-candidates")

    left = sets.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("tokens").alias("at"))
    right = sets.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("tokens").alias("bt"))
    shared = F.size(F.array_intersect("at", "bt"))
    return (candidates.join(left, "a1").join(right, "b1")
            .filter(shared * (10 + tenths) >= (F.size("at") + F.size("bt")) * tenths).select("a1", "a2", "b1", "b2").distinct())


def judged(docs: DataFrame) -> DataFrame:
    """(c1, c2, first, n_links, kept): every class; a class is kept if no linked class starts earlier."""
    classes = stored(line_classes(docs), "lines-classes")
    links = stored(similar(docs, classes), "lines-links")
    ends = links.select(F.col("a1").alias("c1"), F.col("a2").alias("c2"), F.col("b1").alias("o1"), F.col("b2").alias("o2")).unionByName(
        links.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("a1").alias("o1"), F.col("a2").alias("o2")))
    other = classes.select(F.col("c1").alias("o1"), F.col("c2").alias("o2"), F.col("first").alias("their"))
    best = ends.join(other, ["o1", "o2"]).groupBy("c1", "c2").agg(F.min("their").alias("their"), F.count(F.lit(1)).alias("n_links"))
    earlier = F.coalesce(F.col("their") < F.col("first"), F.lit(False))
    return classes.select("c1", "c2", "first").join(best, ["c1", "c2"], "left").select(
        "c1", "c2", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), (~earlier).alias("kept"))


def deduped(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, their texts without the removed lines (lines without a word stay)."""
    keep = judged(docs).filter("kept").select("first.*").groupBy("_id", "_th").agg(F.collect_list("line_no").alias("keep"))
    rows = packed(docs)
    hit = rows.join(keep, same_key(rows, keep), "left").select("_row", F.coalesce("keep", F.array().cast("array<int>")).alias("keep"))
    all_lines = F.split("_row.text", "\n")
    chosen = F.filter(all_lines, lambda x, i: (split_words(x) == F.array().cast("array<string>")) | F.array_contains("keep", i))
    text = F.when(F.col("_row.text").isNotNull(), F.array_join(chosen, "\n"))
    return hit.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")


def op1_line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: n_lines, n_kept, n_removed and n_links.

    n_links counts the links of the distinct lines that occur first in the
    document; a link joins two different lines and shows at both ends."""
    per = judged(docs).groupBy(F.col("first._id").alias("_id"), F.col("first._th").alias("_th")).agg(
        F.sum(F.col("kept").cast("long")).alias("n_kept"), F.sum("n_links").alias("n_links"))
    n_lines = F.size(F.coalesce(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.array().cast("array<string>")))
    # exact repeats of a row: the first of them holds the kept lines
    base = docs.select("doc_id", *row_key(), n_lines.cast("long").alias("n_lines")).groupBy("doc_id", "_id", "_th", "n_lines").agg(
        F.count(F.lit(1)).cast("int").alias("rows"))
    base = base.select("doc_id", "_id", "_th", "n_lines", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    first = F.col("copy") == 1
    kept = F.when(first, F.coalesce("n_kept", F.lit(0))).otherwise(0).cast("long")
    return base.join(per, same_key(base, per), "left").select(
        "doc_id", "n_lines", kept.alias("n_kept"), (F.col("n_lines") - kept).alias("n_removed"),
        F.when(first, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, line_no, lower(line) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (
  SELECT norm, min((doc_id, line_no)) AS first, row_number() OVER (ORDER BY norm) AS id FROM l GROUP BY norm),
t AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS token
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT id, regexp_extract_all(norm, '[^\x20\x09-\x0D]+') AS w FROM c))),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM t a JOIN t b ON a.token = b.token AND a.id != b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.id = o.a JOIN n y ON y.id = o.b WHERE 18 * o.o >= 8 * (x.n + y.n)),
judged AS (
  SELECT c.id, c.first, count(links.b) AS n_links, coalesce(bool_or(d.first < c.first), false) AS gone
  FROM c LEFT JOIN links ON links.a = c.id LEFT JOIN c d ON d.id = links.b GROUP BY 1, 2),
per AS (SELECT first[1] AS doc_id, count(*) FILTER (NOT gone) AS n_kept, sum(n_links) AS n_links FROM judged GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
       CAST(coalesce(n_lines, 0) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN per USING (doc_id)
"""
