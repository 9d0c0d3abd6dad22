"""Operator 10 - language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language inside the tasks and sums them with
one shuffle; what reaches the driver is the (languages x buckets) count matrix,
whose size is fixed by two parameters. The log-probability matrix is broadcast.
Scoring works on Arrow batches: all n-gram buckets of a batch form one sparse
index array, gathered from the matrix and summed per document with ``reduceat``.

Cases: null text or a text without letters gives ``und`` with score 0. No
labelled rows at all gives ``und`` for every row. Languages are any strings;
more than ``max_langs`` distinct ones raise an error. Extra columns are ignored
and repeated rows each get their own result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, map_arrow, packed, release_memory, stored

BUCKET_BITS = 16
MAX_LANGS = 256
#: Code points hashed at once; bounds the memory of a batch with very long texts.
CHUNK = 1 << 20
SMOOTHING = 0.5
UNDETERMINED = "und"

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _normal(text: str | None) -> str | None:
    """Lower-cased letters, every run of anything else one space; None without a letter."""
    first = _LETTER.search(text) if text else None
    # the class also holds number signs such as superscripts, which are no letters
    if first is None or not first[0].isalpha() and not any(map(str.isalpha, text)):
        return None
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def _buckets(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all character 2- and 3-grams of a normalised text, chunk by chunk."""
    shift = np.uint64(64 - bits)
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at:at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        two = c[:-1] * _MULT[0] + c[1:] * _MULT[1]
        three = two[:-1] + c[2:] * _MULT[2]
        yield ((two[:CHUNK] * _MULT[1]) >> shift).astype(np.int64)
        yield ((three[:CHUNK] * _MULT[0]) >> shift).astype(np.int64)


def fit(labelled: DataFrame, bits: int = BUCKET_BITS, max_langs: int = MAX_LANGS) -> dict:
    """Train on every row of ``labelled(text, lang)`` with a non-null lang."""
    rows = labelled.select(F.col("text").alias("text"), F.col("lang").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                t, lang = _normal(text.as_py()), lang.as_py()
                if t is None:
                    continue
                if lang not in totals:
                    if len(totals) >= max_langs:
                        raise ValueError(f"more than {max_langs} languages")
                    totals[lang] = np.zeros(1 << bits, dtype=np.int64)
                docs[lang] = docs.get(lang, 0) + 1
                for b in _buckets(t, bits):
                    totals[lang] += np.bincount(b, minlength=1 << bits)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(n[at], docs[lang]))],
                names=["lang", "bucket", "n"])

    counts = stored(map_arrow(rows, count, "lang string, bucket long, n long")
                    .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid-counts")
    langs = sorted(r[0] for r in counts.filter("bucket = -1").select("lang").limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    # at most max_langs x 2^bits rows, whatever the corpus
    table = counts.toArrow()
    matrix = np.zeros((1 << bits, len(langs)))
    prior = np.zeros(len(langs))
    place = {x: i for i, x in enumerate(langs)}
    col = np.array([place[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    b, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    prior[col[b < 0]] = n[b < 0]
    matrix[b[b >= 0], col[b >= 0]] = n[b >= 0]
    matrix += SMOOTHING
    return {"langs": langs, "bits": bits, "prior": np.log(prior / max(prior.sum(), 1)),
            "logp": np.log(matrix / matrix.sum(axis=0)).astype(np.float32)}


def _score_texts(texts: pa.Array, m: dict) -> tuple[pa.Array, pa.Array]:
    """Prediction and score of every text."""
    langs, bits, prior, logp = m["langs"], m["bits"], m["prior"], m["logp"]
    sums, sizes = np.zeros((len(texts), len(langs))), np.zeros(len(texts))

    def flush(parts, owners):
        if not parts:
            return
        index = np.concatenate(parts)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        part = np.add.reduceat(logp[index], starts, axis=0)
        np.add.at(sums, owners, part)
        np.add.at(sizes, owners, [len(p) for p in parts])

    # a gathered n-gram is as wide as the number of languages, so more languages gather fewer at once
    most = max(1, 8 * CHUNK // max(8, len(langs)))
    parts, owners, held = [], [], 0
    for i, value in enumerate(texts):
        t = _normal(value.as_py())
        for whole in _buckets(t, bits) if t is not None and langs else ():
            for at in range(0, len(whole), most):
                b = whole[at:at + most]
                parts.append(b)
                owners.append(i)
                held += len(b)
                if held >= most:
                    flush(parts, owners)
                    parts, owners, held = [], [], 0
    flush(parts, owners)
    pred, conf = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    seen = np.flatnonzero(sizes)
    if len(seen):
        logs = sums[seen] + prior
        best = logs.argmax(axis=1)
        z = (logs - logs.max(axis=1, keepdims=True)) / np.sqrt(sizes[seen])[:, None]
        conf[seen] = 1 / np.exp(z).sum(axis=1)
        for i, k in zip(seen, best):
            pred[i] = langs[k]
    return pa.array(pred, pa.string()), pa.array(conf)


def predict(docs: DataFrame, model: dict, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns plus the prediction and its score (``names``) for every row of ``docs`` (text).

    score: the posterior of the predicted language, with the log-likelihood
    tempered by the square root of the number of n-grams (naive Bayes counts
    overlapping n-grams as independent, so plain posteriors are all 0 or 1)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cols = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*cols).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, conf = _score_texts(batch.column(batch.num_columns - 1), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pred, conf], names=[*keep, *names])

    out = schema.add(names[0], "string").add(names[1], "double")
    return map_arrow(docs.select(*cols, F.col("text")), score, out)


def accepted(docs: DataFrame, model: dict, min_score: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is determined with ``min_score`` or more.

    Only the texts go to the Python workers; the rows wait in Spark."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def verdict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.StructArray.from_arrays(_score_texts(batch, shared.value), names=["pred", "score"])
        release_memory()
    verdict.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judged = packed(docs).select("_row", F.arrow_udf(verdict, "pred string, score double")(F.col("_row.text")).alias("_v"))
    return judged.filter((F.col("_v.pred") != UNDETERMINED) & (F.col("_v.score") >= min_score)).select("_row.*")


def op10_language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract query: train where crc32(doc_id as text) mod 3 is not 1, predict every document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model, "doc_id", "held_out")
