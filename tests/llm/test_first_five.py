"""Operators 2, 3, 6, 8, 10 and the pipeline against plain versions."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from paysift.llm import decontaminate, language_id, mixing, simhash, token_files

from . import brute


# ---- 6 ----------------------------------------------------------------------------------------------------

def check_simhash(df):
    rows = df.select("doc_id", "text").collect()
    fps = [brute.simhash(r["text"]) for r in rows]
    roots = brute.groups(len(rows), ((i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4))
    low = {}
    for r, g in zip(rows, roots):
        if r["doc_id"] is not None:
            low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f"{f:016x}", low.get(g)) for r, f, g in zip(rows, fps, roots)), key=repr)
    got = sorted((tuple(r) for r in simhash.op6_simhash_near_dedup(df.sparkSession, df).collect()), key=repr)
    assert got == want


def test_simhash_equals_brute_force(docs):
    check_simhash(docs)


def test_simhash_odd_rows(odd, nothing):
    check_simhash(odd)
    assert simhash.op6_simhash_near_dedup(odd.sparkSession, nothing).count() == 0
    assert odd.columns == simhash.one_of_each(odd).columns
    assert simhash.one_of_each(nothing).count() == 0


def test_simhash_chunks_of_a_hot_run_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = {int(centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 24, 5).astype(np.uint64))) for _ in range(400)}
    far = {int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    fps = sorted(near | far)
    signed = np.array(fps, dtype=np.uint64).astype(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    want = brute.groups(len(fps), ((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4))
    index = {x: i for i, x in enumerate(signed)}
    for run in (20_000, 37):
        got = brute.groups(len(fps), ((index[r["a"]], index[r["b"]]) for r in simhash.links(df, 4, run).collect()))
        assert got == want


def test_one_document_of_each_group_stays(docs):
    groups = {r["component_id"] for r in simhash.op6_simhash_near_dedup(docs.sparkSession, docs).collect()}
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(groups)


# ---- 2 ----------------------------------------------------------------------------------------------------

def check_contamination(docs, benchmark):
    want = brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    got = [tuple(r) for r in decontaminate.op2_decontaminate(docs.sparkSession, docs, benchmark).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def test_contamination_equals_brute_force(docs, spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = check_contamination(docs, benchmark)
    assert any(x[-1] for x in want) and not all(x[-1] for x in want)
    assert decontaminate.clean(docs, benchmark).count() == sum(not x[-1] for x in want)


def test_contamination_odd_rows(odd, nothing, spark):
    items = [(1, "one"), (2, "same text here for ties and repeated rows"), (3, None), (None, "a b c d e"), (4, ""), (5, "word " * 20),
             (5, "word " * 20), (6, "É ß 中文"), (7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    check_contamination(odd, benchmark)
    check_contamination(odd, benchmark.limit(0))
    check_contamination(nothing, benchmark)


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    near = item.replace("gamma", "gamma inserted")
    docs = spark.createDataFrame([(1, item), (2, near), (3, "nothing of it")], "doc_id long, text string")
    rows = decontaminate.matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {(r["_id"], r["kind"]) for r in rows if r["kind"] == "phrase"} == {(1, "phrase")}
    assert {r["_id"] for r in rows if r["kind"] == "proximity"} <= {2}


# ---- 3 ----------------------------------------------------------------------------------------------------

def check_mix(docs, blocks=mixing.BLOCKS):
    rows = mixing.plan_mix(docs, blocks=blocks).collect()
    source = defaultdict(int)
    for r in docs.collect():
        source[r["source"]] += brute.count_words(r["text"])
    goal = brute.mix_targets(dict(source)) if source else {}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == source[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(1, largest[s]), (s, taken[s], g)
    assert len(rows) == docs.count()
    return rows


def test_mix_meets_its_targets(docs):
    for blocks in (mixing.BLOCKS, 4):
        rows = check_mix(docs, blocks)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(docs.repartition(5), blocks=blocks).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in mixing.plan_mix(docs).collect())


def test_mix_odd_rows(odd, nothing):
    rows = check_mix(odd)
    assert mixing.mixed(odd).count() == sum(r["copies"] for r in rows)
    assert mixing.mixed(odd).columns == odd.columns
    check_mix(nothing)
    assert mixing.mixed(nothing).count() == 0


def test_splitting_tree_quotas_are_exact():
    draws = [1000, 0, 37, 5]
    got = mixing.splitting_tree(draws, 16)
    assert got.sum(axis=0).tolist() == draws
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 4


# ---- 8 ----------------------------------------------------------------------------------------------------

def check_tokens(df):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {}
    rows = df.select("doc_id", "text").collect()
    want = []
    for r in rows:
        x = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
    got = token_files.op8_token_files(df.sparkSession, df).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


def test_token_files_round_trip(docs, odd, nothing):
    check_tokens(docs)
    check_tokens(odd)
    assert token_files.op8_token_files(odd.sparkSession, nothing).count() == 0


@pytest.mark.parametrize("n, kinds", [(0, 5), (1, 1), (7, 1), (token_files.LANES * token_files.STEPS, 9),
                                      (3 * token_files.LANES * token_files.STEPS + 777, 5000)])
def test_segment_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds * 7).astype("<u4")
    data = token_files.encode_segment(ids)
    seg = token_files.Segment(data)
    assert (seg.ids() == ids).all() and len(seg.ids()) == n
    if n:
        assert (np.concatenate([seg.block(k) for k in range(len(seg.blocks))]) == ids).all()
        last = len(seg.blocks[0][0]["marks"]) - 1
        first = last * token_files.MARK * token_files.LANES
        assert (seg.piece(0, last) == ids[first: seg.blocks[0][0]["n"]]).all()
        with pytest.raises(ValueError):
            token_files.Segment(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])


def test_pretokens_equal_the_library():
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = token_files.Encoder(path)
    chars = [chr(i) for i in range(0x24F)]
    texts = [f"a{c}b {c} {c}{c}x 1{c}2 '{c} {c}'s  {c}\n" for c in chars] + ["  lead", "trail  \n ", "it's 'tis we'll", "<|endoftext|> x", "̀é 中"]
    assert enc.encode(texts) == enc._library(texts)


def test_new_pretokens_go_to_the_library_many_to_a_text(monkeypatch):
    import public_tokenizers
    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(6000)]
    texts = [" ".join(words[i:i + 300]) for i in range(0, 6000, 300)]
    plain, given = enc._library, []
    want = plain(texts)
    monkeypatch.setattr(enc, "_library", lambda some: given.append(len(some)) or plain(some))
    assert enc.encode(texts) == want
    assert sum(given) < 100
    given.clear()
    assert enc.encode(texts[::-1]) == want[::-1] and sum(given) == 0


def test_cuts_of_mixed_characters_and_a_full_memory(monkeypatch):
    import public_tokenizers
    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_files, "REMEMBERED", 200)
    monkeypatch.setattr(token_files, "JOINED", 3)
    rng = np.random.default_rng(9)
    chars = list("' ' '\t\n\xa0stremvlldabSTé1²_.<|\x85\x1c")
    for _ in range(500):
        texts = ["".join(rng.choice(chars, rng.integers(0, 15))) for _ in range(4)]
        assert enc.encode(texts) == enc._library(texts)


def test_strings_of_added_tokens_equal_an_untouched_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|> \u4e2d", "<|endoftext", "no token"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [50256]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.Encoder(path).encode(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.op8_token_files(spark, df).collect()}
    assert got == {i: (len(w) + 1, zlib.crc32(np.array([*w, 2], dtype="<u4").tobytes())) for i, w in enumerate(want)}


# ---- 10 ---------------------------------------------------------------------------------------------------

def test_language_accuracy_on_held_out_rows(docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.op10_language_id(docs.sparkSession, docs).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == {d for d in truth if brute.crc(d) % 3 == 1}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("text, letters", [("²½ Ⅷ 12", False), ("² x", True), ("ß", True), ("中", True), ("_", False), ("", False), (None, False)])
def test_letters(text, letters):
    assert (language_id._normal(text) is not None) == letters


def test_language_odd_rows(odd, nothing):
    rows = language_id.op10_language_id(odd.sparkSession, odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 6))
    assert by[5]["lang_pred"] == "en"
    assert language_id.op10_language_id(odd.sparkSession, nothing).count() == 0
    assert language_id.accepted(odd, language_id.fit(odd)).columns == odd.columns


# ---- pipeline ---------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as p
    rows = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, rows, sf).persist()
        assert after.columns == docs.columns, name
        rows = after
    kept = {r["doc_id"] for r in rows.select("doc_id").collect()}
    bad = {x[0] for x in brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()],
                                             [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]) if x[-1]}
    assert kept and not kept & bad
    assert p.run(spark, sf).count() == rows.count()
    rows.unpersist()


def test_pipeline_stages_odd_rows(spark, sf, odd, nothing):
    import corpus_pipeline as p
    for rows in (odd, nothing):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, rows, sf)
            assert out.columns == rows.columns, name
            assert out.count() <= 2 * rows.count(), name
        assert p.STAGES[-1][1](spark, rows, sf).count() == rows.count()
