"""Operators 1, 4, 5, 7 and 9 against DuckDB twins and plain versions."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paysift.llm import chat_format, line_dedup, quality_rules, secrets, suffix_dedup
from paysift.llm.queries import oracle_sql, queries

from ..compare import assert_same, duck
from . import brute


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, sf, name):
    assert_same(queries()[name](spark, sf), duck(sf), oracle_sql()[name])


# ---- 1 ----------------------------------------------------------------------------------------------------

BASE = " ".join(f"w{i}" for i in range(60))


def test_line_links_equal_brute_force(spark):
    texts = [BASE, BASE.upper(), BASE.replace("w59", "x"), BASE.replace("w30", "y"), "short", "short line", "Short  line\n\n \t \nshort",
             None, "", BASE.replace("w0 ", "z "), "a b c d e f\na b c d e g\na b c d e f", BASE + " " + BASE]
    docs = list(enumerate(texts)) + [(None, "short\nnull id")]
    got = rows_of(line_dedup.op1_line_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    want = sorted(brute.line_links(docs), key=repr)
    assert got == want
    assert sum(r[4] for r in want) > 0 and sum(r[3] for r in want) > 3


def test_lines_with_a_common_passage(spark, monkeypatch):
    """One derivation of the lines gives all prefixes; lines whose prefix holds a common token are joined apart and lose no link."""
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(5)) for i in range(60)]
    texts += [texts[3] + " more", texts[4].replace(" ", "\t"), passage, passage + " p12", passage.upper()]
    long = " ".join(f"w{i % 97} {i}" for i in range(300))
    texts += [long, long + " end", long.replace(" 7 ", " seven\x0b"), long + " " + passage, BASE, BASE + " end"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    calls = []
    monkeypatch.setattr(line_dedup, "lines", lambda rows, f=line_dedup.lines: calls.append(1) or f(rows))
    got = rows_of(line_dedup.op1_line_dedup(spark, df))
    assert got == sorted(brute.line_links(docs), key=repr)
    assert sum(r[4] for r in got) >= 10
    assert len(calls) == 1
    assert line_dedup._common(line_dedup._posted(line_dedup.line_classes(df))).count() > 0


def test_line_dedup_odd_rows(odd, nothing):
    rows = line_dedup.op1_line_dedup(odd.sparkSession, odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["n_kept"] <= r["n_lines"] for r in rows)
    assert line_dedup.op1_line_dedup(odd.sparkSession, nothing).count() == 0
    out = line_dedup.deduped(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_deduped_texts(spark):
    df = spark.createDataFrame([(1, "keep\n\nthis line"), (2, "this line\nnew"), (3, None)], "doc_id long, text string")
    assert rows_of(line_dedup.deduped(df)) == [(1, "keep\n\nthis line"), (2, "new"), (3, None)]


# ---- 4 ----------------------------------------------------------------------------------------------------

def check_quality(df):
    want = brute.quality([(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()])
    assert rows_of(quality_rules.op4_quality_rules(df.sparkSession, df)) == sorted(want, key=repr)
    return want


def test_quality_of_frequent_lines(spark):
    rows = [(i, f"Terms of use {i}\nunique words of text {i} are here and there for ever {'x' * i}", "a" if i % 3 else None) for i in range(90)]
    rows += [(100 + i, "One very common line with quite some words in it indeed", "b") for i in range(30)] + [(200, "word " * 40, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = check_quality(df)
    assert any(w[7] and w[8] for w in want) and any(w[7] and not w[6] and not w[8] for w in want)
    out = {r["doc_id"]: r["text"] for r in quality_rules.cleaned(df).collect()}
    assert set(out) == {w[0] for w in want if w[8]}
    assert out[1] == "unique words of text 1 are here and there for ever x"


def test_quality_odd_rows(odd, nothing):
    check_quality(odd)
    assert quality_rules.op4_quality_rules(odd.sparkSession, nothing).count() == 0
    assert quality_rules.cleaned(odd).columns == odd.columns


# ---- 5 ----------------------------------------------------------------------------------------------------

RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages",
     [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"id": 5, "meta": {"x": [1]}, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "from_value",
     [("user", "q"), ("assistant", "")]),
    ({"system": "be kind", "conversations": [{"from": "gpt", "value": "hi"}]}, "from_value", [("system", "be kind"), ("assistant", "hi")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done", "score": 1.5}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"turns": [{"turn": 1, "role": "assistant", "text": "b"}, {"turn": 0, "role": "user", "text": "a"}]}, "turns", [("user", "a"), ("assistant", "b")]),
    ({"nothing": "known"}, None, []), ({}, None, []),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(98, None), (99, "no json")], "i int, record string")
    got = {r["i"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat_format.canonical(df).collect()}
    assert got == {i: (name, turns) for i, (_, name, turns) in enumerate(RECORDS)} | {98: (None, []), 99: (None, [])}


TEXTS = st.lists(st.sampled_from(["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "|im_end|>", "|im_start|>", "\n", "a", "<|x|>", "é", "\x00"]), max_size=12).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>", "\\n\\s", ""]), TEXTS), min_size=30, max_size=60))
def test_template_is_reversible(spark, turns):
    df = spark.createDataFrame([(0, [list(t) for t in turns])], "i int, turns array<struct<role:string,text:string>>")
    r = chat_format.read_back(chat_format.formatted(df)).first()
    assert [tuple(t) for t in r["read_turns"]] == turns
    assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
    bodies = [s["text"] for s in r["segments"]][1::3]
    assert not any(c in b for b in bodies for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>"))


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None, 1), (1, 0, "user", "twice", 2), (1, 0, "user", "twice", 2), (1, None, "user", "first", 3), (None, 1, "assistant", "x", 4),
            (2, 5, "assistant", "long " * 30_000, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, layout int")
    got = {r["conv_id"]: r for r in chat_format.op5_chat_format(spark, df).collect()}
    assert set(got) == {1, 2, None, -7}
    assert got[1]["n_turns"] == 4
    turns = [("user", "first"), ("", ""), ("user", "twice"), ("user", "twice")]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[2]["loss_chars"] == 150_000 and got[2]["loss_sha256"] == hashlib.sha256(("long " * 30_000).encode()).hexdigest()
    assert chat_format.op5_chat_format(spark, df.limit(0)).count() == 1


def test_turn_longer_than_the_json_limit(spark):
    long = F.concat(F.lit('{"prompt": "p", "completion": "'), F.repeat(F.lit("long "), 4_000_001), F.lit('"}'))
    row = chat_format.canonical(spark.range(1).select(long.alias("record"))).select("layout", F.length(F.col("turns")[1]["text"])).first()
    assert tuple(row) == ("prompt", 20_000_005)


def test_conversation_that_cannot_be_read_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "UNBOUNDED", {"maxStringLen": "1000"})
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "long " * 300)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="conversation not read: 1"):
        chat_format.op5_chat_format(spark, df).collect()


# ---- 7 ----------------------------------------------------------------------------------------------------

def check_passages(df):
    want = brute.shared_passages([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = [(r["doc_id"], r["n_dup_words"], r["spans"]) for r in suffix_dedup.op7_suffix_dedup(df.sparkSession, df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def test_passages_equal_brute_force(docs, odd, nothing):
    assert check_passages(docs)
    check_passages(odd)
    check_passages(nothing)


def test_passages_of_every_length_and_offset(spark):
    import random
    rnd = random.Random(3)

    def fresh(n):
        return [f"u{rnd.getrandbits(40)}" for _ in range(n)]

    rows = []
    for i, n in enumerate([*range(47, 56), 60, 75, 76, 77, 130]):
        passage = fresh(n)
        for k in range(3):
            rows.append((10 * i + k, " ".join(fresh(rnd.randrange(40)) + passage + fresh(rnd.randrange(40)))))
    hot = fresh(80)
    rows += [(1000 + k, " ".join(fresh(5) + hot[k % 7:] + fresh(30))) for k in range(60)] + [(2000, "same " * 400), (2001, "same " * 300)]
    want = check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert not any(d < 30 for d, *_ in want) and all(any(d == 30 + k for d, *_ in want) for k in range(3))


# ---- 9 ----------------------------------------------------------------------------------------------------

KEY = "password=hunter2hunter2"


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.mark.parametrize("wrap", [
    urllib.parse.quote, lambda s: urllib.parse.quote(urllib.parse.quote(s)), b64, lambda s: b64(b64(s)), lambda s: b64(gzip.compress(s.encode())),
    lambda s: b64(zlib.compress(s.encode())), lambda s: urllib.parse.quote(b64(gzip.compress(b64(s).encode())), safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: s.replace("=", "\\x3d"),
    lambda s: base64.urlsafe_b64encode(("ÿþ" * 8 + " " + s).encode()).decode()])
def test_secrets_in_layers(wrap):
    hidden = wrap(KEY)
    text = f"plain words {hidden} more"
    base, every = secrets.find(text)
    at = text.index(hidden)
    assert any(k == "assign" and at <= a < b <= at + len(hidden) for k, a, b in every)
    assert set(base) <= set(every)


def test_spans_through_escapes_are_exact():
    text = "see token%3Dabcdefgh12 and api%5Fkey:%20%22ABCDEFGH%22 end"
    _, every = secrets.find(text)
    assert [text[a:b] for k, a, b in every] == ["token%3Dabcdefgh12", "api%5Fkey:%20%22ABCDEFGH"]


@pytest.mark.parametrize("text", [
    "password: hunter%32hunter2", "token = s%33cretvalue1", "pass%77ord: hunter2hunter2", '"password": "\\u0068unter2hunter2"',
    "pass%77ord = \\x68unter2hunter2", "pass%2577ord : hunter2hunter2", "api&#95;key = &quot;abcdefgh"])
def test_blanks_around_an_escaped_assignment(text):
    base, every = secrets.find(f"words {text} more")
    assert base == [] and [f"words {text} more"[a:b] for _, a, b in every] == [text.strip('"')]


def wrapped(s, n=64, brk="\n"):
    s = b64(s)
    return brk.join(s[i:i + n] for i in range(0, len(s), n))


FILL = "plain words before it, " * 9


@pytest.mark.parametrize("hidden", [
    b64(gzip.compress(gzip.compress(KEY.encode()))), b64(gzip.compress(zstandard.compress(KEY.encode()))), b64(bz2.compress(lzma.compress(KEY.encode()))),
    b64(gzip.compress(b"first ") + gzip.compress(KEY.encode())), b64(gzip.compress(b"pass") + gzip.compress(b"word=hunter2hunter2")),
    b64(bz2.compress(b"first ") + bz2.compress(KEY.encode())), b64(lzma.compress(b"first ") + lzma.compress(KEY.encode())),
    b64(gzip.compress(b"first ") + KEY.encode()), b64(b"header" + zlib.compress(KEY.encode())), b64(gzip.compress(KEY.encode())[:-6] + b"broken"),
    *[b64(f"a{c}b {KEY}") for c in "\u00a0\u200b\0\x1b"], b64(b"a\xffb " + KEY.encode()), b64(("\0" * 9 + " " + KEY).encode("utf-8")),
    wrapped(FILL + KEY), wrapped(FILL + KEY, 76, "\r\n"), wrapped(FILL + KEY, 76, "\n    "), wrapped(FILL + KEY, 64, "\\n"), wrapped(gzip.compress((FILL + KEY).encode()), 10),
    *[f"path{c}{b64('x' + KEY)}" for c in "/-_"], "word\n" + b64(KEY)])
def test_no_layer_is_lost(hidden):
    text = f"plain words {hidden} more"
    at = text.index(hidden)
    assert any(k == "assign" and at <= a < b <= at + len(hidden) for k, a, b in secrets.find(text)[1])


def test_spans_of_wrapped_base64_are_its_lines():
    lines = [b64(FILL[:48]), b64(("x " + KEY).ljust(48)), b64(FILL[:48])]
    text = "\n".join(lines)
    assert [text[a:b] for _, a, b in secrets.find(text)[1]] == [lines[1]]


def test_escaped_key_after_another_value():
    _, every = secrets.find("secret: %70assword:hunter2hunter2")
    assert ("assign", 8, 33) in every


def test_base_spans_of_the_contract():
    text = f"Password: 'abcdefgh' x TOKEN=short secret==12345678 AKIA{'B' * 12} AKIA1 {'0a' * 16} {'f' * 31} apikey=\"zzzzzzzz"
    base, every = secrets.find(text)
    assert [(k, text[a:b]) for k, a, b in base] == [
        ("assign", "Password: 'abcdefgh"), ("assign", "secret==12345678"), ("access", "AKIA" + "B" * 12), ("hex", "0a" * 16), ("assign", 'apikey="zzzzzzzz')]
    assert base == every


def test_clean_text_and_cycles_and_bombs():
    assert secrets.find("The meaning of %20 is a space; look at \\u0041 and thonandtionerhaesou ABCDEFGHIJKLMNOPQRSTUVWX") == ([], [])
    assert secrets.find("%25" * 50 + " " + "%2525252525") == ([], [])
    bomb = b64(gzip.compress(b"0 " * (secrets.MAX_LAYER // 2 + 10)))
    assert [k for k, *_ in secrets.find("x " + bomb)[1]] == ["oversize"]


def test_secrets_odd_rows(odd, nothing):
    rows = secrets.op9_secret_scan(odd.sparkSession, odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == "" for r in rows)
    assert secrets.op9_secret_scan(odd.sparkSession, nothing).count() == 0
