"""Whole tables against plain versions: base secrets (9) and language predictions (10)."""

import base64
import gzip
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from paysift.llm import secrets
from paysift.llm.language_id import BUCKET_BITS, SMOOTHING, op10_language_id
from paysift.llm.secrets import op9_secret_scan

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_secrets_of_the_whole_table(spark, docs):
    kinds = ("assign", "access", "hex")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = op9_secret_scan(spark, docs).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        named = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",")) or not named


MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
WORD = (1 << 64) - 1


def grams(text):
    """Buckets of all 2- and 3-grams of the letters, other runs as one space; None without a letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    t = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    c = list(map(ord, t))
    two = [(a * MULT[0] + b * MULT[1]) & WORD for a, b in zip(c, c[1:])]
    three = [(x + b * MULT[2]) & WORD for x, b in zip(two, c[2:])]
    return [(x * MULT[1] & WORD) >> 64 - BUCKET_BITS for x in two] + [(x * MULT[0] & WORD) >> 64 - BUCKET_BITS for x in three]


def test_language_predictions_of_the_whole_table(spark, docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    counts, n_docs = defaultdict(Counter), Counter()
    for r in rows:
        g = grams(r.text)
        if not held[r.doc_id] and r.lang is not None and g is not None:
            counts[r.lang].update(g)
            n_docs[r.lang] += 1
    total = {k: sum(c.values()) + SMOOTHING * (1 << BUCKET_BITS) for k, c in counts.items()}
    want = {}
    for r in rows:
        g = grams(r.text)
        if g is None:
            want[r.doc_id] = ("und", 0.0)
            continue
        logs = {k: math.log(n_docs[k] / sum(n_docs.values())) + sum(math.log((counts[k][b] + SMOOTHING) / total[k]) for b in g) for k in counts}
        best = max(logs, key=logs.get)
        want[r.doc_id] = (best, 1 / sum(math.exp((x - logs[best]) / math.sqrt(len(g))) for x in logs.values()))
    got = op10_language_id(spark, docs).collect()
    assert len(got) == len(rows) and all(r.held_out == held[r.doc_id] for r in got)
    assert all(r.lang_pred == want[r.doc_id][0] for r in got)
    assert all(abs(r.score - want[r.doc_id][1]) < 1e-3 for r in got)


def b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("text", [
    "%u0070assword=hunter2hunter2", "&#x0000077;&#0000000119; &#x0070;assword=hunter2hunter2", "api&lowbar;key = hunter2hunter2", r"\160assword: hunter2hunter2",
    r"\U00000070assword: hunter2hunter2", "&#X70;assword:hunter2hunter2", "pass&NotAnEntity; &#112;assword&colon;hunter2hunter2",
    b64("password=hunter2hunter2 in UTF-16".encode("utf-16")), b64("password=hunter2hunter2 in UTF-16".encode("utf-16-be")),
    b64(gzip.compress("password=hunter2hunter2 in UTF-16".encode("utf-16-le"))), b64(zlib.compress(b64(b"password=hunter2hunter2 in base64").encode()))])
def test_secrets_in_more_layers(text):
    base, every = secrets.find(f"some words {text} and more")
    assert not base
    assert any(k == "assign" and 11 <= a < b <= 11 + len(text) for k, a, b in every)


def test_crafted_headers_take_bounded_work():
    """Each header opens a stream that holds all later ones."""
    seconds = []
    for n in (500, 2000):
        text = b64((b"\x78\x01\x00\xff\xff\x00\x00") * n + b" password=hunter2hunter2")
        t = time.perf_counter()
        _, every = secrets.find(text)
        seconds.append(time.perf_counter() - t)
        assert any(k == "assign" for k, _, _ in every)
    assert seconds[1] < 10 and seconds[1] < 40 * max(seconds[0], 0.05)


def test_a_false_header_hides_no_stream():
    hidden = zlib.compress(b"password=hunter2hunter2 " * 3)
    for junk in (b"\x78\x9c", b"\x78\x01\x03", b"\x1f\x8b\x08\0\0\0\0\0\0\3", b"BZh9"):
        assert any(k == "assign" for k, _, _ in secrets.find("x " + b64(junk + b"\x01\x02\x03" + hidden))[1]), junk
    broken = zlib.compress(bytes(range(256)) * 40)[:-200]
    assert any(k == "assign" for k, _, _ in secrets.find(b64(broken + hidden))[1])
