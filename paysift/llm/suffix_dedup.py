"""Operator 7 - repeated passages by a sparse suffix array.

Words (ASCII white space, A-Z lower-cased) of every text are hashed. A suffix is
retained only where a minimiser falls: the smallest hash of ``LEAD`` consecutive
words in a window of ``STRIDE`` places. Any ``PASSAGE`` = LEAD + STRIDE - 1 words
contain a retained suffix with LEAD of these words to its right, so equal
passages retain suffixes at equal places.

1. Retained suffixes are grouped by the hash of their first LEAD words, not
   sorted; suffixes whose group has another text are candidates. About one word
   in STRIDE / 2 takes part.
2. No neighbours are compared. A passage around a candidate can start up to
   STRIDE - 1 words before the suffix, so the hash of the PASSAGE words is taken
   at each of these starts, and passages that two different texts share stay.
3. Overlapping passages are merged into maximal spans.

Exact copies are one text: a task leaves out texts it has met, places are sets, and
the windows of step 2 come from one row of each text. A copied text of PASSAGE
words or more is one span. No pair of documents is ever listed: a passage that a
third of all documents share costs one row per document.

Cases: null, empty and short texts have no passage. Repetition inside one text
alone is not reported. Rows of one doc_id with different texts are different
texts; exact repeats of a row count as copies. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, split_words, stored

LEAD = 25
STRIDE = 26
PASSAGE = LEAD + STRIDE - 1
#: Words whose hashes a Python worker remembers.
REMEMBERED = 1_000_000
#: Rows of an output batch.
ROWS = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_WORDS = _Hashes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hash of any word range of one text in constant time (polynomial modulo 2^64 over 64-bit word hashes)."""

    def __init__(self, text: str | None):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        x = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
        self.n = len(x)
        if self.n >= PASSAGE:
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * _powers(_BASE, self.n), dtype=np.uint64)])
            self.back = _powers(_INVERSE, self.n)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        h ^= h >> np.uint64(32)  # low bits of a product depend on low bits alone
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def retained(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the retained suffixes."""
        if self.n < PASSAGE:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        h = self.at(np.arange(self.n - LEAD + 1), LEAD)
        view = np.lib.stride_tricks.sliding_window_view(h, STRIDE)
        places = np.unique(np.concatenate([view[a:a + 4096].argmin(axis=1) + np.arange(a, min(a + 4096, len(view)))
                                           for a in range(0, len(view), 4096)]))
        return places, h[places]


def _text_key() -> list:
    """128 bits that name a text."""
    return [F.xxhash64("text").alias("c1"), F.xxhash64(F.lit("second"), "text").alias("c2")]


def retained_suffixes(texts: DataFrame) -> DataFrame:
    """(c1, c2, pos, h) of ``texts(c1, c2, text)``; a text that a task meets again is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            c1, c2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes, places, hashes = [], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
            for key, t in zip(zip(c1.tolist(), c2.tolist()), batch.column(2)):
                if key in met:
                    sizes.append(0)
                    continue
                met.add(key)
                p, h = Rolling(t.as_py()).retained()
                sizes.append(len(p))
                places.append(p)
                hashes.append(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(c1, sizes)), pa.array(np.repeat(c2, sizes)), pa.array(np.concatenate(places).astype(np.int32)),
                 pa.array(np.concatenate(hashes).view(np.int64))], names=["c1", "c2", "pos", "h"])

    return map_arrow(texts, run, "c1 long, c2 long, pos int, h long")


def passages_around(candidates: DataFrame) -> DataFrame:
    """(c1, c2, low, start, g): hash of PASSAGE words at every start around the places of ``candidates(c1, c2, low, text, places)``."""
    low = candidates.schema["low"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, met = [], 0, set()
        for batch in batches:
            low_type = batch.column(2).type
            for c1, c2, low, text, places in zip(*(batch.column(k) for k in range(5))):
                if (key := (c1.as_py(), c2.as_py())) in met:  # a row that repeats id and text
                    continue
                met.add(key)
                r = Rolling(text.as_py())
                if r.n < PASSAGE:
                    continue
                at = np.asarray(places.values.to_numpy(), dtype=np.int64)
                starts = np.unique((at[:, None] - np.arange(STRIDE)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts <= r.n - PASSAGE)]
                held.append((c1.as_py(), c2.as_py(), low.as_py(), starts, r.at(starts, PASSAGE)))
                rows += len(starts)
                if rows >= ROWS:
                    yield pack(held, low_type)
                    held, rows = [], 0
        if held:
            yield pack(held, low_type)

    def pack(held, low_type):
        sizes = [len(h[3]) for h in held]
        of = pa.array(np.repeat(np.arange(len(held)), sizes))
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()).take(of), pa.array([h[1] for h in held], pa.int64()).take(of), pa.array([h[2] for h in held], low_type).take(of),
             pa.array(np.concatenate([h[3] for h in held]).astype(np.int32)), pa.array(np.concatenate([h[4] for h in held]).view(np.int64))],
            names=["c1", "c2", "low", "start", "g"])

    return map_arrow(candidates, run, f"c1 long, c2 long, low {low}, start int, g long")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that rows of two different texts have, with the smallest document that has each.

    Stored before it is joined: a join of two plain tables can split the rows of a passage that many texts share."""
    differ = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    low = [F.min("low").alias("first")] if "low" in rows.columns else []
    return rows.groupBy(key).agg(differ.alias("differ"), *low).filter("differ").drop("differ")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(c1, c2, start, end, first): maximal spans, in words, that another text or copy holds too."""
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).select("doc_id", "text", *_text_key())
    texts = stored(rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "suffix-texts")

    # copies of a text in different tasks repeat its rows; the sets of places drop them once few rows are left
    suffixes = stored(retained_suffixes(rows.select("c1", "c2", "text")), "suffix-places")
    places = (suffixes.join(stored(_shared(suffixes, "h"), "suffix-shared"), "h").groupBy("c1", "c2").agg(F.array_sort(F.collect_set("pos")).alias("places")))
    wanted = places.join(texts, ["c1", "c2"]).select("c1", "c2", "places", "low")
    # the text comes from one document of each class, so that a class of many copies is no hot key
    a, b = rows.alias("a"), wanted.alias("b")
    one = a.join(b, (F.col("a.c1") == F.col("b.c1")) & (F.col("a.c2") == F.col("b.c2")) & F.col("a.doc_id").eqNullSafe(F.col("b.low")))
    # windows that come twice all the same (one text in two tasks) have equal starts and make one span
    windows = stored(passages_around(one.select("a.c1", "a.c2", "b.low", "a.text", "b.places")), "suffix-windows")
    hits = windows.select("c1", "c2", "start", "g").join(stored(_shared(windows, "g"), "suffix-hits"), "g").select("c1", "c2", "start", "first")

    order = Window.partitionBy("c1", "c2").orderBy("start")
    apart = F.coalesce(F.col("start") > F.lag("start").over(order) + PASSAGE, F.lit(True))
    spans = (hits.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(order))
             .groupBy("c1", "c2", "span").agg(F.min("start").alias("start"), (F.max("start") + PASSAGE).alias("end"), F.min("first").alias("first"))
             .select("c1", "c2", "start", "end", "first"))
    copied = texts.filter("copies > 1")
    # lengths are taken before the join: it moves no text
    lengths = rows.select(F.col("c1").alias("l1"), F.col("c2").alias("l2"), "doc_id", F.size(split_words(F.col("text"))).alias("end"))
    whole = (copied.join(lengths.filter(F.col("end") >= PASSAGE), (F.col("c1") == F.col("l1")) & (F.col("c2") == F.col("l2"))
                         & F.col("doc_id").eqNullSafe(F.col("low")))
             .select("c1", "c2", F.lit(0).alias("start"), "end", F.col("low").alias("first")).distinct())
    return spans.join(copied.select("c1", "c2"), ["c1", "c2"], "left_anti").unionByName(whole)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document row with repeated passages: doc_id, n_dup_words, spans (array of start, end, first).

    ``first`` is the smallest doc_id that holds a part of the span."""
    spans = stored(repeated_spans(docs), "suffix-spans")
    per = spans.groupBy("c1", "c2").agg(F.sum(F.col("end") - F.col("start")).alias("n_dup_words"),
                                        F.array_sort(F.collect_list(F.struct("start", "end", "first"))).alias("spans"))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).select("doc_id", *_text_key())
    return rows.join(per, ["c1", "c2"]).select("doc_id", "n_dup_words", "spans")


def op7_suffix_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with passages of PASSAGE words or more that repeat across documents.

    spans: ``start:end`` in words, comma-joined; first_doc_id: smallest document that holds any of them."""
    rows = repeated_passages(docs)
    return rows.select(
        "doc_id", F.col("n_dup_words").cast("long").alias("n_dup_words"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        F.array_min(F.transform("spans", lambda s: s["first"])).alias("first_doc_id"))
