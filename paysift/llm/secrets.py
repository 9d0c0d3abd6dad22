"""Operator 9 - secret scans with a recursive decoding worklist.

The text is scanned for three kinds of secrets. Then a worklist unwraps encoded
runs - percent-encoding, Unicode, octal and character escapes, base64, and UTF-16 text or
gzip, zlib, bzip2, xz or zstd data inside base64 - into new layers, which are scanned and
unwrapped in turn until nothing new appears. Escapes are decoded in the whole
text, so that key, separator and value stay together, blanks between them too.
Base64 may go over several lines and start anywhere in a run; its bytes are a
layer whatever they are, and compressed data is looked for at every place of them. Layers already seen are not entered
again (cycle detection). Findings of a layer are mapped back to spans of the
text: character by character through escapes, to whole lines of the run through base64.

A layer that unpacks to more than ``MAX_LAYER`` bytes (a decompression bomb) is
scanned that far and reported as a span of kind ``oversize``.

Cases: null text is empty. A finding that a layer shares with the text itself is
reported once. Every row gets its own result; extra columns are ignored.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_arrow

MAX_LAYER = 64 << 20
#: Compressed bytes taken at a time, and the most that bzip2 and xz make of them at a time.
STEP, BLOCK = 1 << 10, 1 << 20

# The base patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "oversize")

Span = tuple[str, int, int]

_PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{0*[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}|%u[0-9A-Fa-f]{4}|"
                     r"&#[xX]0*[0-9A-Fa-f]{1,6};|&#0*[0-9]{1,7};|&[A-Za-z][A-Za-z0-9]{1,31};")
# A base64 run: one line of at least 16 characters, or lines that a break (also one written as \\n) parts.
_64, _LINE = "[A-Za-z0-9+/_-]", r"[\x20\t]*+(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+"
_BASE64 = re.compile(rf"(?<!{_64})(?:{_64}{{16,}}+(?:{_LINE}{_64}++)*+|{_64}++(?:{_LINE}{_64}++)++)={{0,2}}")
_BREAK = re.compile(_LINE)
_STANDARD = str.maketrans("-_", "+/")
# gzip, bzip2, xz, zstd and (window sizes of 256 to 32 768 bytes, no dictionary) zlib
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\x1f\x40-\x5f\x80-\x9f\xc0-\xdf]")
_PADDING = re.compile(rb"\0*")
# Bytes without this hold no finding and nothing to unwrap: findings, escaped or not, are ASCII and have 14 characters or more.
_WORTH = re.compile(rb"[\t\n\r\x20-\x7e]{14}|(?:[\t\n\r\x20-\x7e]\0){14}|" + _MAGIC.pattern)
# ASCII characters in UTF-16, either byte first; the zero bytes are what the layer leaves out.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){14,}|(?:\0[\t\n\r\x20-\x7e]){14,}")
#: Content from which on a stream is one beyond doubt: what lies in its bytes is looked for in its content only.
SOUND = 1 << 10


def scan(text: str) -> list[Span]:
    """Base findings: leftmost non-overlapping matches of each kind, the failing ones dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def scan_layer(text: str) -> list[Span]:
    """As :func:`scan`, and the assignments whose key is the end of another one's value: in a layer that
    value may be words that only stand before an escaped key."""
    out = [s for s in scan(text) if s[0] != "assign"]
    m = ASSIGN.search(text)
    while m:
        if m.end(2) - m.start(2) >= 8:
            out.append(("assign", m.start(), m.end()))
        m = ASSIGN.search(text, max(m.start() + 1, m.end() - len("password=")))
    return out


def _opened(head: bytes):
    """A decompressor for data that starts with ``head``, which :data:`_MAGIC` matches."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    if head[:2] == b"\x28\xb5":
        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(15) if int.from_bytes(head[:2], "big") % 31 == 0 else None


def _blocks(d, data: bytes, start: int) -> Iterator[bytes]:
    """What ``d`` makes of ``data[start:]``, as far as it is sound; returned are the place reached and whether the stream ended there."""
    at, bounded, step = start, isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)), STEP
    try:
        while not d.eof and at < len(data):
            chunk = data[at:at + step]
            at += len(chunk)
            if bounded:
                yield d.decompress(chunk, BLOCK)
                while not d.eof and not d.needs_input:
                    yield d.decompress(b"", BLOCK)
                continue
            before = d.copy() if step > 1 and hasattr(d, "copy") else None
            try:
                yield d.decompress(chunk)
            except zlib.error:
                if before is None:
                    raise
                d, at, step = before, at - len(chunk), 1  # byte by byte up to the break
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        return at, False
    return (at - len(d.unused_data), True) if d.eof else (at, False)


def _unpacked(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, content, cut) of all compressed data in ``data``, wherever it starts. Members that follow one
    another are one content; broken data gives what comes before the break. ``cut``: longer than MAX_LAYER.

    The search goes on behind a stream that ended or gave SOUND bytes, else at the next place, as what looks
    like a header may be none. Each sound stream is so entered once."""
    m = _MAGIC.search(data)
    while m:
        start, out, size, cut, end, behind, whole = m.start(), [], 0, False, None, 0, False
        while m and (d := _opened(m[0])) is not None:
            blocks = _blocks(d, data, m.start())
            while True:
                try:
                    got = next(blocks)
                except StopIteration as stop:
                    behind, whole = stop.value
                    break
                out.append(got[:MAX_LAYER - size])
                size += len(out[-1])
                if len(out[-1]) < len(got):
                    cut, whole, behind = True, False, len(data)
                    break
            if not whole:
                break
            end = behind
            m = _MAGIC.match(data, _PADDING.match(data, end).end())
        if size:
            yield start, end if whole else len(data), b"".join(out), cut
        m = _MAGIC.search(data, max(start + 1, end or 0, behind if size >= SOUND else 0))


class Layer:
    """A text; ``up`` turns a span of it into one of ``parent``, until the document (no parent) is reached.

    ``data`` are the bytes of a decoded layer, its text has one character for each: all that is looked for is ASCII."""

    def __init__(self, text: str, parent: "Layer | None" = None, up: Callable[[int, int], tuple[int, int]] | None = None,
                 data: bytes | None = None):
        self.text, self.parent, self.up, self.data = text, parent, up, data

    def span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end


_DOCUMENT = Layer("")


def _escaped(layer: Layer, pattern: re.Pattern, decode) -> Layer:
    """The whole text with every match of ``pattern`` decoded; characters of a match lie at all of it."""
    text, out, at, size = layer.text, [], 0, 0
    places, pieces = [], []  # first character of each piece; its span in ``text`` and whether it is plain

    def put(piece: str, a: int, b: int, plain: bool):
        nonlocal size
        if piece:
            out.append(piece)
            places.append(size)
            pieces.append((a, b, plain))
            size += len(piece)

    for m in pattern.finditer(text):
        put(text[at:m.start()], at, m.start(), True)
        put(decode(m[0]), m.start(), m.end(), False)
        at = m.end()
    put(text[at:], at, len(text), True)

    def up(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(places, start) - 1, bisect_right(places, end - 1) - 1
        first, last = pieces[i], pieces[j]
        return (first[0] + start - places[i] if first[2] else first[0], last[0] + end - places[j] if last[2] else last[1])

    return Layer("".join(out), layer, up)


def _decoded(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """The bytes of a base64 run from each of its first four characters on, so that whatever stands before
    the encoded data (a word, a path, a line) shifts only some of them. Spans are whole lines of the run."""
    breaks = [m.span() for m in _BREAK.finditer(layer.text, *m.span())] if "\n" in m[0] or "\\n" in m[0] else []
    lines = list(zip([m.start(), *[b for _, b in breaks]], [*[a for a, _ in breaks], m.end()]))
    run = "".join([layer.text[a:b] for a, b in lines]).rstrip("=").translate(_STANDARD)
    places = list(accumulate([b - a for a, b in lines], initial=0))
    for k in range(4):
        n = len(run) - k
        if n < 2:
            continue
        data = binascii.a2b_base64(run[k:len(run) - (n % 4 == 1)] + "=" * (-n % 4 if n % 4 > 1 else 0))
        if not _WORTH.search(data):
            continue

        def up(start: int, end: int, k=k) -> tuple[int, int]:
            first, last = k + start * 4 // 3, min(k + (end - 1) * 4 // 3 + 1, len(run) - 1)
            return lines[bisect_right(places, first) - 1][0], lines[min(bisect_right(places, last), len(lines)) - 1][1]

        yield Layer(data.decode("latin-1"), layer, up, data)


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _char(escape: str) -> str:
    if escape[0] == "&":
        return html.unescape(escape)
    if escape[1] in "0123":
        return chr(int(escape[1:], 8))
    code = int(escape[3:-1] if escape[2] == "{" else escape[2:], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def unwrap(layer: Layer) -> Iterator[Layer | Span]:
    """Layers one step below, and ``oversize`` spans."""
    text = layer.text
    if "%" in text and _PERCENT_RUN.search(text):
        yield _escaped(layer, _PERCENT_RUN, _percent)
    if ("\\" in text or "&" in text or "%u" in text) and _ESCAPE.search(text):
        yield _escaped(layer, _ESCAPE, _char)
    for m in _BASE64.finditer(text):
        yield from _decoded(layer, m)
    if layer.data is not None:
        for m in _WIDE.finditer(layer.data):
            data = m[0].replace(b"\0", b"")
            yield Layer(data.decode("latin-1"), layer, lambda a, b, at=m.start(): (at + 2 * a, at + 2 * b), data)
        for start, end, data, cut in _unpacked(layer.data):
            at = layer.span(start, end)
            if cut:
                yield ("oversize", *at)
            if _WORTH.search(data):  # all of a content lies at its stream, however deep that is
                yield Layer(data.decode("latin-1"), _DOCUMENT, lambda a, b, at=at: at, data)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each sorted by start, kind as listed, end."""
    text = text or ""

    def order(s: Span):
        return s[1], KINDS.index(s[0]), s[2]

    base = sorted(scan(text), key=order)
    every, seen, work = set(base), set(), deque([Layer(text)])
    while work:
        layer = work.popleft()
        for x in unwrap(layer):
            if isinstance(x, tuple):
                every.add(x)
                continue
            mark = (hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), x.span(0, len(x.text)) if x.text else None)
            if mark in seen:
                continue
            seen.add(mark)
            every.update((kind, *x.span(a, b)) for kind, a, b in scan_layer(x.text))
            work.append(x)
        layer.text, layer.data = "", None  # layers below need its map only
    return base, sorted(every, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for t in batch.column(1):
                b, e = find(t.as_py())
                base.append(b)
                every.append(joined(e))
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(every, pa.string())], names=schema.names)

    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return map_arrow(rows, run, schema)


def op9_secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract query."""
    return secret_spans(docs)
