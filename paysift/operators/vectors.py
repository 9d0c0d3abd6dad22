"""Document chunks and exact cosine search.

Chunking explodes a ``sequence`` of start offsets per document and takes
substrings: whole texts, every chunk, no Python. Cosine similarity of one vector
uses higher-order array functions on ``ARRAY<FLOAT>`` and a TakeOrdered. Many
vectors are searched in blocks: each pair of a query block and a vector block is
one matrix product over Arrow buffers that leaves its best rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 64
#: Vectors a block; a pair of blocks takes the memory of two blocks and their scores.
BLOCK = 2048

# Chunk size and overlap of the knowledge index.
CHUNK_CHARS, CHUNK_OVERLAP = 1800, 200


def chunk(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = CHUNK_CHARS,
          overlap: int = CHUNK_OVERLAP, title_col: str | None = None, kind_col: str | None = None) -> DataFrame:
    """L1: overlapping chunks of every document (whole text).

    A text no longer than ``size`` is one chunk; a longer one has chunks
    starting every ``size - overlap`` characters. Titles get ' [part i/n]'
    when a document has several chunks."""
    step = max(1, size - overlap)
    t = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    d = docs.select(F.col(id_col).alias("doc_id"),
                    (F.col(title_col) if title_col else F.col(id_col).cast("string")).alias("_title"),
                    (F.col(kind_col) if kind_col else F.lit("doc")).alias("kind"), t.alias("_t"))
    d = d.filter(F.length("_t") > 0)
    n = F.length("_t")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    ex = d.select("doc_id", "_title", "kind", "_t", F.posexplode(starts).alias("_i", "_s"),
                  F.size(starts).alias("n_chunks"))
    title = F.when(F.col("n_chunks") > 1, F.format_string("%s [part %d/%d]", F.col("_title"), F.col("_i") + 1,
                                                           F.col("n_chunks"))).otherwise(F.col("_title"))
    return ex.select("doc_id", F.col("_title").cast("string").alias("path"), title.alias("title"), "kind",
                     (F.col("_i") + 1).cast("long").alias("chunk_no"), F.col("n_chunks").cast("long").alias("n_chunks"),
                     F.substring("_t", F.col("_s") + 1, F.lit(size)).alias("content"))


def upsert_chunks(new: DataFrame, old: DataFrame, keys=("path", "title", "kind")) -> DataFrame:
    """L2: new chunks replace old ones with the same (path, title, kind)."""
    keys = list(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def _norm(a: Column) -> Column:
    n = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                           lambda acc, x: acc + x))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine_topk(emb: DataFrame, query: DataFrame, k: int = 8, vec_col: str = "embedding",
                id_col: str = "vec_id") -> DataFrame:
    """L3: exact cosine top-k of each query vector over the whole table.

    ``query`` has the vectors in ``q`` and, for several of them, a ``query_id``
    that the result carries (``cosine_topk_blocks``); two rows without one are an error."""
    if "query_id" in query.columns:
        return cosine_topk_blocks(emb, query, k, vec_col, id_col)
    if query.limit(2).count() > 1:
        raise ValueError("several query vectors need a query_id")
    j = emb.crossJoin(F.broadcast(query.select("q")))
    score = _dot(F.col(vec_col), F.col("q")) / (_norm(F.col(vec_col)) * _norm(F.col("q")))
    scored = j.select(id_col, *[c for c in emb.columns if c not in (id_col, vec_col)], F.round(score, 6).alias("score"))
    return scored.orderBy(F.desc("score"), F.col(id_col)).limit(max(1, k))


def _blocks(df: DataFrame, id_col: str, vec_col: str, prefix: str) -> DataFrame:
    """Rows of up to BLOCK unit vectors of one length: their ids and one matrix. Vectors that are null, empty or hold a null are left out."""
    kind = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            ids, rows = held.pop(dim)
            m = np.array(rows, dtype=np.float64)
            norm = np.sqrt((m * m).sum(axis=1))
            m /= np.where(norm == 0, 1.0, norm)[:, None]
            return pa.RecordBatch.from_pydict({f"{prefix}_ids": [ids], f"{prefix}_dim": pa.array([dim], pa.int32()), f"{prefix}_m": pa.array([m.tobytes()], pa.binary())},
                                              schema=pa.schema([(f"{prefix}_ids", pa.list_(id_type)), (f"{prefix}_dim", pa.int32()), (f"{prefix}_m", pa.binary())]))
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if v and None not in v:
                    ids, rows = held.setdefault(len(v), ([], []))
                    ids.append(i)
                    rows.append(v)
                    if len(rows) == BLOCK:
                        yield block(len(v))
        for dim in list(held):
            yield block(dim)
    return df.select(id_col, vec_col).mapInArrow(pack, f"{prefix}_ids array<{kind}>, {prefix}_dim int, {prefix}_m binary")


def cosine_topk_blocks(emb: DataFrame, query: DataFrame, k: int = 8, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """L3 for any number of query vectors: ``query_id``, id, other columns of ``emb`` and score.

    Both tables are packed into blocks, and every query block meets every vector block
    in one matrix product, spread over the cluster; nothing goes through the driver and
    neither side is broadcast. A pair of blocks keeps k rows a query, and a query's rows
    are ranked in salted parts before they are ranked together, so no task ranks a
    whole table. Ties go to the smaller id."""
    k = max(1, k)
    id_kind, q_kind = emb.schema[id_col].dataType.simpleString(), query.schema["query_id"].dataType.simpleString()
    pairs = _blocks(emb, id_col, vec_col, "v").crossJoin(_blocks(query, "query_id", "q", "q"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_type, q_type = batch.schema.field("v_ids").type.value_type, batch.schema.field("q_ids").type.value_type
            for row in range(batch.num_rows):
                dim = batch.column("v_dim")[row].as_py()
                if dim != batch.column("q_dim")[row].as_py():  # as a join condition it would send all blocks to one task
                    continue
                v, q = (np.frombuffer(batch.column(n)[row].as_buffer(), dtype=np.float64).reshape(-1, dim) for n in ("v_m", "q_m"))
                score = np.round(q @ v.T, 6)
                n = min(k, score.shape[1])
                edge = -np.partition(-score, n - 1, axis=1)[:, n - 1:n]
                at = np.nonzero(score >= edge)  # all rows that tie at the edge: the ids decide later
                vi, qi = batch.column("v_ids")[row].values, batch.column("q_ids")[row].values
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(at[0])).cast(q_type), vi.take(pa.array(at[1])).cast(ids_type), pa.array(score[at])],
                                                 names=["query_id", id_col, "score"])
    found = pairs.select("v_ids", "v_dim", "v_m", "q_ids", "q_dim", "q_m").mapInArrow(best, f"query_id {q_kind}, {id_col} {id_kind}, score double")
    order = [F.desc("score"), F.col(id_col)]
    found = found.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(SALT_BUCKETS)))
    for parts in (["query_id", "_b"], ["query_id"]):
        w = Window.partitionBy(*parts).orderBy(*order)
        found = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    others = [c for c in emb.columns if c not in (id_col, vec_col)]
    found = found.drop("_b")
    if not others:
        return found
    return found.join(emb.select(id_col, *others), id_col).select("query_id", id_col, *others, "score")
