"""Operators 11 to 13: twins, brute force, odd rows."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paysift.llm import collocations as C
from paysift.llm import multiset_hash as M
from paysift.llm import token_alignment as A
from tests.compare import assert_same, duck

from . import brute

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- 11 ---------------------------------------------------------------------------------------------------

def phrases(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations_twin(spark, sf, docs):
    assert_same(C.op11_collocations(spark, docs), duck(sf), C.ORACLE)


@pytest.mark.parametrize("words,shards,bits", [(4, 3, 4), (2, 1, 21), (3, 5, 10)])
def test_collocations_any_lengths_shards_and_buckets(spark, docs, words, shards, bits):
    some = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = phrases(C.collocations(docs, max_words=words, shards=shards, bits=bits, threshold=6))
    assert got == brute.collocations(some, max_words=words, threshold=6)


def test_collocations_overlaps_pieces_ties_and_null_lang(spark):
    rows = ([("en", "a " * 13 + "b")] + [("en", "New\tYork, new york! x.y z z")] * 9 + [(None, "Ünï cödé ünï cödé.\r\nünï cödé")] * 4
            + [("und", "ünï cödé")] * 2 + [("de", None), ("de", "")] + [("xx", "p q\x0br s\x0cp q r s")] * 10 + [("yy", "b c d b c d")] * 6)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = phrases(C.collocations(df))
    assert got == brute.collocations(rows)
    assert any(r[0] == "und" for r in got) and any(r[2] == "a a a" for r in got)


def test_collocations_exact_beyond_64_bits(spark):
    often = [("en", "w" + chr(97 + i % 5), 3_000_000_000 + i) for i in range(5)]
    a, left, right = 2_999_999_999, 3_000_000_001, 3_000_000_007
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        F.expr("(CAST(1000000 AS DECIMAL(38, 0)) * a * a) div (CAST(l AS DECIMAL(38, 0)) * r)").alias("s")).first().s
    assert len(often) == 5 and got == 1000000 * a * a // (left * right)


def test_collocations_long_texts_are_cut_at_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 64)
    text = "one two three. " * 40 + "no end of this piece " * 30
    chunks = list(C._chunks([__import__("pyarrow").record_batch({"lang": ["en", "fr"], "text": [text, "x"]})]))
    assert b"".join(t for c in chunks for lang, t in c if lang == "en").decode() == text
    assert all(len(t) <= 64 + 15 or b"." not in t[64:-1] for c in chunks for _, t in c)


def test_collocations_counts_are_stored_in_few_bytes():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 64, 1 << 18, dtype=np.uint64) & C._KEPT)
    counts = np.where(rng.random(len(keys)) < 0.01, 1 << 40, 1)
    table = pa.Table.from_batches([C._arrays(2, keys, np.ones(len(keys), dtype=np.int32), 64)])
    assert table.num_rows == 64 and sum(len(x.as_py()) for c in ("keys", "counts") for x in table[c]) < 7 * len(keys)
    for other in (counts, np.ones(len(keys), dtype=np.int32)):
        table = pa.Table.from_batches([C._arrays(2, keys, other, 64)])
        back = [C._table_arrays(table, i) for i in range(64)]
        assert (np.concatenate([k for k, _ in back]) == keys).all() and (np.concatenate([n for _, n in back]) == other).all()
    few = keys[[0, 5, 9]]
    merged = C._merge(pa.Table.from_batches([C._arrays(2, k, np.array([300] * len(k)), 1) for k in (few, few[1:], keys[-1:])]))
    assert [x.tolist() for x in C._table_arrays(merged, 0)] == [[*few.tolist(), int(keys[-1])], [300, 600, 600, 300]]


def test_collocations_texts_are_shuffled_in_few_bytes():
    rng = np.random.default_rng(11)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(3000)]
    docs = [(f"l{k % 3}", " ".join(rng.choice(words, 400)).encode()) for k in range(200)]
    ready = [np.zeros(1 << 10, dtype=np.uint8)] * 3
    plain = C._added_up(list(C._texts(docs, 3, ready, 10, 8)), "part")
    row = pa.Table.from_batches([C._packed(plain)])
    assert sorted(row["part"].to_pylist()) == list(range(8))
    back = pa.concat_tables(C._unpacked(row)).to_pylist()
    assert sorted(map(repr, back)) == sorted(map(repr, plain.select(["lang", "phrase", "c"]).to_pylist()))
    assert row.nbytes < 0.6 * plain.nbytes


def test_collocations_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert phrases(C.collocations(odd)) == brute.collocations(rows)
    assert C.collocations(nothing).count() == 0


# ---- 12 ---------------------------------------------------------------------------------------------------

def test_fingerprints_twin(spark, sf, docs):
    assert_same(M.op12_document_fingerprints(spark, docs), duck(sf), M.ORACLE)


def test_fingerprints_order_insertion_and_deletion(spark):
    one, two, more = "First line.\nSecond one here. Third!\n", "Third!\nFirst line. Second one here.", "extra\nextra"
    df = spark.createDataFrame([(one, two, more)], "a string, b string, c string")
    for n in "abc":
        df = M.with_vector(df.withColumn("_p", M.paragraphs(F.col(n))), "_p", "v" + n).drop("_p")
    df = M.with_vector(df.withColumn("_p", M.paragraphs(F.concat("b", F.lit("\n"), "c"))), "_p", "vbc")
    r = df.select(M.as_text(F.col("va")).alias("a"), M.as_text(F.col("vb")).alias("b"), M.as_text(F.col("vbc")).alias("bc"),
                  M.as_text(M.plus(F.col("va"), F.col("vc"))).alias("a_c"), M.as_text(M.minus(F.col("vbc"), F.col("vc"))).alias("bc_c"),
                  M.likeness(F.col("va"), F.col("vb")).alias("same"), M.likeness(F.col("va"), F.col("vbc")).alias("near"),
                  M.likeness(F.col("va"), F.col("vc")).alias("far")).first()
    assert r.a == r.b == r.bc_c != r.bc == r.a_c
    assert r.same == 1.0 and 0 < r.near < 1 and r.far < 0.5


def test_fingerprints_tell_edits_from_neighbours(spark, docs):
    r = M.op12_document_fingerprints(spark, docs.filter("n_chars > 500")).agg(
        F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("share")).first()
    assert r.e > 0.5 and r.n < 0.25 and r.share > 0.9


def test_fingerprints_odd_rows(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("\x00null")))).collect()]
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    following = {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    want = sorted(((r[0], len(r[1]), hashlib.sha256((r[1][:len(r[1]) - len(r[1]) // 3] + following[r][:len(r[1]) // 3]).encode()).hexdigest()) for r in rows), key=repr)
    got = M.op12_document_fingerprints(spark, odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {"0" * len(got[0].fingerprint)}
    assert M.op12_document_fingerprints(spark, nothing).count() == 0
    alone = M.op12_document_fingerprints(spark, odd.filter("doc_id = 4")).first()
    assert alone.near_next == 1.0


def test_fingerprints_neighbours_across_ranges(spark, docs):
    """Each document's neighbour, whatever the number of ranges."""
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r._k: r._p._k for r in M._neighbours(M._keyed(docs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    ids = sorted((int(i) for i in got), reverse=True)
    assert {str(ids[i]): str(ids[i - 1]) for i in range(len(ids))} == got


# ---- 13 ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(A_PATH)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    token = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
             for i in range(model.get_piece_size())]
    return lambda t: library.encode(t, add_special_tokens=False).ids, model.encode, A.byte_bpe(A_PATH)[1], token


STRANGE = [None, "", " ", "a", "<|endoftext|> <s></s>", "▁ mark", "tab\tand  two\n\n\nlines \r\n", "é ß 中文 😀 ́x", "nul \x00 in", "ﬁ ① ½   ​",
           "x" * 3000, " " * 500, "same", "same", "don't we'll I'M", "  ﻿ ", "١٢٣ 123 4567"]


def rows13(df):
    return [tuple(r) for r in df.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_alignment_against_token_by_token(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 5_000)  # workers fork with it: several chunks and blocks
    monkeypatch.setattr(A, "BLOCK", 20_000)
    texts = STRANGE + [r.text for r in docs.select("text").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = A.op13_token_alignment(spark, df)
    assert rows13(got.orderBy("doc_id")) == brute.alignment(texts, *plain)


def test_alignment_blocks(plain):
    """Chunk and block borders, without Spark."""
    texts = [t for t in STRANGE if t]
    got = A.align(texts, A.byte_bpe(A_PATH), A.pieces(B_PATH))
    want = [w for w in brute.alignment(texts, *plain)]
    assert [bool(x) for x in got["ok"]] == [w[-1] != "" for w in want]
    kept = [w for w in want if w[-1]]
    assert [hashlib.sha256(g.as_py()).hexdigest() if isinstance(g.as_py(), bytes) else hashlib.sha256(g.as_py().encode()).hexdigest() for g in got["groups"]] == [w[-1] for w in kept]
    assert got["n_links"].tolist() == [w[3] for w in kept]


def test_alignment_ids_are_the_library_s(docs, plain):
    encode = A.byte_bpe(A_PATH)[0]
    texts = [" " + t for t in STRANGE if t] + [" " + (r.text or "") for r in docs.select("text").collect()]
    assert encode(texts) == [plain[0](t) for t in texts]


def test_alignment_odd_rows(spark, odd, nothing, plain):
    rows = odd.select("doc_id", "text").collect()
    want = brute.alignment([r.text for r in rows], *plain)
    got = A.op13_token_alignment(spark, odd)
    assert sorted(rows13(got), key=repr) == sorted(want, key=repr)
    assert sorted((str(r.doc_id) for r in got.select("doc_id").collect())) == sorted(str(r.doc_id) for r in rows)
    assert A.op13_token_alignment(spark, nothing).count() == 0


def test_alignment_holds_one_block(spark):
    """Memory: a writer or reader holds one block at a time, and no list of counts is built on the heap."""
    import pyarrow.parquet as pq
    long = spark.range(6, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words 12 "), A.BLOCK // 28).alias("text"))
    got = A.op13_token_alignment(spark, long)
    files = {f.removeprefix("file://") for f in got.inputFiles() if "-blocks-" in f}
    assert [m.row_group(i).num_rows for m in map(pq.read_metadata, files) for i in range(m.num_row_groups)] == [1, 1, 1]
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert len({(r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()}) == 1
