"""Operator 13 - alignment of the tokens of two tokenizers, over Arrow.

Each text is encoded by a byte-level BPE (A, with a blank before the text) and by a
piece model (B, which adds that blank). Token ids lie in flat Arrow arrays with the
index of their document; token byte lengths are summed along each document (a cumulative
sum less the sum at the document's start), which gives (document, end) keys. An Acero
full outer join of A's and B's keys, in order, is the finest common cut of the text:
each of its rows is one overlapping A-B pair (nulls take the next token of their side),
and rows with both sides are the group borders. ``Table.group_by`` counts pairs per
document and the documents of a pair per block of texts; Spark adds the blocks' counts,
finds the highest count of every A id, and brings each block only the counts of its own
distinct pairs. Blocks lie in the shared folder in between, so no text is encoded twice.

Memory: a block is a few MB whatever the input. Each is a row group of its own, so that writers and
readers hold one at a time, and its long arrays pass the JVM compressed. Blocks and counts meet
block by block behind a sort that can spill; no list of counts is built on the heap.

A is cut by tiktoken over the ranks of the tokenizer file if that file is a plain
byte-level BPE whose ids follow its merges (far less CPU, same ids), else by the
tokenizers library. Broadcast: one highest count per A id, at most the vocabulary.

Cases: null and empty texts, and texts that A's or B's bytes do not give back (U+2581,
characters the piece model normalises), have zeros and ''. Strings of special tokens are
plain text. Repeated rows and ids each get a result, and each counts as a document.
Empty tables give no rows; other columns are not read. A text is one unit: a task needs
about 60 bytes of memory per byte of its longest text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import importable, map_arrow, release_memory, stored

#: Bytes of text aligned at once, and in a block that shares one list of pairs.
CHUNK = 2 << 20
BLOCK = 8 << 20
#: A row counts as so many bytes more, so that blocks of short and empty texts end too.
_ROW = 64
#: Of the arrays that only Python reads.
_PACK = pa.Codec("zstd", compression_level=1)
#: Place of the document number in a (document, end) key.
_DOC = 40

Encode = Callable[[list[str]], list[list[int]]]


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder and token bytes by id of a byte-level BPE file."""
    from public_tokenizers import PATTERN
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    char = _byte_of_char()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    token = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
    for t, i in vocab.items():
        token[i] = bytes(char[c] for c in t)
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    before = spec.get("pre_tokenizer") or {}
    if (merged == sorted(set(merged)) and all(len(token[i]) == 1 for i in set(vocab.values()) - set(merged)) and not spec.get("normalizer")
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)):
        ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(token) if b}, special_tokens={})
        return (lambda texts: [ranks.encode_ordinary(t) for t in texts]), token
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return (lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]), token


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder and token bytes by id of a sentencepiece model."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    token = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
             for i in range(model.get_piece_size())]
    return (lambda texts: model.encode(texts, num_threads=1)), token


def _ids(lists: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


def _joined(ids: pa.ListArray, token: pa.Array, by) -> pa.Array:
    """One string per list: its tokens, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, token.take(ids.values)), by)


def _ends(ids: pa.ListArray, size: pa.Array, name: str) -> pa.Table:
    """``(document, end)`` key and id of every token."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    run = pc.cumulative_sum(size.take(flat))
    total = pa.concat_arrays([pa.array([0], pa.int64()), run])
    end = pc.subtract(run, total.take(ids.offsets.slice(0, len(ids))).take(doc))
    return pa.table({"key": pc.add(pc.shift_left(doc, _DOC), end), name: flat})


def align(texts: list[str], a: tuple[Encode, list[bytes]], b: tuple[Encode, list[bytes]]) -> dict:
    """Aligned tokens of non-empty texts.

    ``ok`` (texts both give back), and of those ``n_a, n_b, n_groups, n_links, groups`` by text
    and ``links``: doc, a, b of all links in text order."""
    whole = pa.array([" " + t for t in texts], pa.string()).cast(pa.binary())
    ids = [_ids(a[0]([" " + t for t in texts])), _ids(b[0](texts))]
    token = [pa.array(x[1], pa.binary()) for x in (a, b)]
    ok = pc.and_(*[pc.equal(_joined(i, t, b""), whole) for i, t in zip(ids, token)])
    ids = [_ids_of(i.filter(ok)) for i in ids]
    ends = [_ends(i, pc.binary_length(t).cast(pa.int64()), n) for i, t, n in zip(ids, token, "ab")]
    cut = ends[0].join(ends[1], keys="key", join_type="full outer", use_threads=False).combine_chunks()
    cut = cut.take(pc.sort_indices(cut, [("key", "ascending")])).combine_chunks()
    both = pc.and_(pc.is_valid(cut["a"]), pc.is_valid(cut["b"]))
    doc = pc.shift_right(cut["key"], _DOC).combine_chunks()
    groups = _group_strings(cut, both, ids)
    n = len(ids[0])
    per_doc = [np.bincount(d.to_numpy(), minlength=n) for d in (doc, doc.filter(both.combine_chunks()))]
    bounds = pa.array(np.concatenate(([0], np.cumsum(per_doc[1]))).astype(np.int32))
    return {"ok": ok.to_numpy(zero_copy_only=False), "n_a": np.diff(ids[0].offsets.to_numpy()), "n_b": np.diff(ids[1].offsets.to_numpy()),
            "n_links": per_doc[0], "n_groups": per_doc[1], "groups": pc.binary_join(pa.ListArray.from_arrays(bounds, groups), ";"),
            "links": pa.table({"doc": doc, "a": pc.fill_null_backward(cut["a"].combine_chunks()), "b": pc.fill_null_backward(cut["b"].combine_chunks())})}


def _ids_of(lists: pa.ListArray) -> pa.ListArray:
    """The same lists with offsets from 0 over exactly their values."""
    sizes = pc.list_value_length(lists).to_numpy()
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pc.list_flatten(lists))


def _group_strings(cut: pa.Table, both: pa.ChunkedArray, ids: list[pa.ListArray]) -> pa.Array:
    """``a1,a2|b1`` of every group, in text order."""
    sides = []
    for name in "ab":
        own = pc.is_valid(cut[name])
        last = np.flatnonzero(both.filter(own).to_numpy()) + 1  # behind the last token of each group
        values = cut[name].filter(own).combine_chunks()
        digits = pa.array([str(i) for i in range(int(pc.max(values).as_py() or 0) + 1)])
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], last)).astype(np.int32)), digits.take(values)), ","))
    return pc.binary_join_element_wise(*sides, "|")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Id and text of every row; few at a time are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    a, b = byte_bpe(a_path), pieces(b_path)
    base, number = TaskContext.get().partitionId() << 32, 0
    wide = len(b[1])
    docs, tables, size = [], [], 0
    held, held_size = [], 0

    def chunk():
        full = [(i, t) for i, t in enumerate(held, len(docs)) if t[1]]
        docs.extend((doc_id, 0, 0, 0, 0, "", 0) for doc_id, _ in held)
        if not full:
            return
        got = align([t for _, (_, t) in full], a, b)
        at = np.array([i for i, _ in full])[got["ok"]]
        links = got["links"]
        pair = pc.add(pc.multiply(links["a"].cast(pa.int64()), wide), links["b"].cast(pa.int64()))
        mine = pa.table({"doc": pa.array(at).take(links["doc"]), "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        mine = mine.take(pc.sort_indices(mine, [("doc", "ascending")]))
        n_pairs = np.bincount(mine["doc"].to_numpy(), minlength=len(docs))
        for j, i in enumerate(at.tolist()):
            docs[i] = (docs[i][0], int(got["n_a"][j]), int(got["n_b"][j]), int(got["n_groups"][j]), int(got["n_links"][j]),
                       hashlib.sha256(got["groups"][j].as_buffer()).hexdigest(), int(n_pairs[i]))
        tables.append(mine)

    def block():
        mine = pa.concat_tables(tables).combine_chunks() if tables else pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "count_all": pa.array([], pa.int64())})
        counts = mine.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair").combine_chunks()
        at = pc.index_in(mine["pair"], value_set=counts["pair"].combine_chunks())

        def one(values, kind):
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))

        def bytes_of(values):
            return pa.array([_PACK.compress(np.ascontiguousarray(values.to_numpy(), dtype=np.int32), asbytes=True)], pa.binary())
        columns = list(zip(*docs))
        rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *[pa.int64()] * 4, pa.string(), pa.int32()])],
                                          names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs"])
        return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), one(rows, rows.type), one(counts["pair"], pa.int64()),
                                           one(counts["count_all"], pa.int64()), bytes_of(at), bytes_of(mine["count_all"])],
                                          names=["block", "docs", "pair", "held", "at", "times"])

    for row in _rows(batches):
        held.append(row)
        held_size += len(row[1]) + _ROW
        if held_size >= CHUNK:
            chunk()
            size, held, held_size = size + held_size, [], 0
            if size >= BLOCK:
                yield block()
                docs, tables, size, number = [], [], 0, number + 1
    if held:
        chunk()
    if docs:
        yield block()


def _with_counts(blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """Rows of a block's documents from the block and the counts of its pairs."""
    docs = blocks["docs"].combine_chunks().flatten()
    stop = np.cumsum(docs.field("n_pairs").to_numpy())
    at, times = (np.frombuffer(_PACK.decompress(blocks[n][0].as_buffer(), int(stop[-1]) * 4), dtype=np.int32) for n in ("at", "times"))
    place = asked["pos"].to_numpy()

    def by_doc(name):
        value = np.zeros(len(place), dtype=np.int64)
        value[place] = asked[name].to_numpy()
        run = np.concatenate(([0], np.cumsum(times * value[at])))
        return run[stop] - run[np.concatenate(([0], stop[:-1]))]
    fields = {n: docs.field(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return pa.table(fields | {"n_best": pa.array(by_doc("best"), pa.int64()), "count_sum": pa.array(by_doc("count"), pa.int64())})


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    wide = len(pieces(b_path)[1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = stored(map_arrow(rows, lambda batches: _blocks(batches, a_path, b_path, arrow),
                              f"block long, docs array<struct<doc_id:{name},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,n_pairs:int>>, "
                              "pair array<bigint>, held array<bigint>, at binary, times binary"), "blocks", {"parquet.block.row.count.limit": "1"})
    counts = (blocks.select(F.explode(F.arrays_zip("pair", "held")).alias("p")).select("p.*")
              .groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.expr(f"pair div {wide}")))
    counts = stored(counts, "pairs")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))  # at most one row per A id
    counts = counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    asked = blocks.select("block", F.posexplode("pair").alias("pos", "pair")).join(counts, "pair").select(F.col("block").alias("of"), "pos", "count", "best")
    importable(spark)

    def run(mine, counted):
        out = _with_counts(mine, counted)
        release_memory()
        return out
    return (blocks.select("block", "docs", "at", "times").groupBy("block").cogroup(asked.groupBy("of"))
            .applyInArrow(run, f"doc_id {name}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"))


def op13_token_alignment(spark: SparkSession, docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers
    return alignment(docs, a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))
