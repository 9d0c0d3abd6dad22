"""Operator 8 - token-ID output in a static rANS format.

Documents are dealt by ranges of doc_id, sorted and tokenised inside the tasks.
Token ids gather into segments of whole documents. A segment has one static
frequency table, shared by its blocks; blocks are independent, each an
interleaved range asymmetric numeral system over ``LANES`` states. Every block
has a CRC-32 of its ids and checkpoints (word offset and states), so blocks, or
parts of a block, decode in parallel. Segments are rows of a Parquet table in
the shared folder: Spark's committer keeps the files whole when executors are lost.

Cases: null text is encoded as empty (the end id alone). Rows with equal doc_id
are ordered by a hash of their text; each gets its own result. Null doc_ids
come first. The string of an added token in a text is that token, as the library
has it by default. An empty table gives an empty file set. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysift.sources.sinks import work_dir

from .common import map_arrow, row_key, widths

BITS = 18
LANES = 512
STEPS = 256
#: Steps between checkpoints of a block.
MARK = 128
#: Ids after which a segment closes (at the end of a document).
SEGMENT = 1 << 22
END_ID = 2
#: Pretokens whose ids a Python worker remembers, and new ones that the library takes as one text.
REMEMBERED = 500_000
JOINED = 256

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


# ---- rANS -------------------------------------------------------------------------------------------------

def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^bits, near the given positive counts."""
    if len(counts) > 1 << bits:
        raise ValueError(f"{len(counts)} symbols need more than {bits} bits")
    spare = (1 << bits) - len(counts)
    exact = counts * (spare / counts.sum())
    f = np.floor(exact).astype(np.int64)
    most = np.argsort(f - exact, kind="stable")[: spare - int(f.sum())]
    f[most] += 1
    return f + 1


def _encode(f: np.ndarray, c: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Encode arrays (blocks, steps, lanes) of frequencies and starts.

    Returns the words of all blocks in decoding order, with the block of each,
    and the states at every checkpoint (marks, blocks, lanes) with word counts per step."""
    blocks, steps, lanes = f.shape
    x = np.full((blocks, lanes), _LOW, dtype=np.uint64)
    words, owners, marks = [], [], {}
    used = np.zeros((steps, blocks), dtype=np.int64)
    top = np.uint64(63 - bits)
    for t in range(steps - 1, -1, -1):
        ft, ct = f[:, t].astype(np.uint64), c[:, t].astype(np.uint64)
        # a frequency of 2^bits (one symbol) makes this limit 2^63, which no state reaches
        spill = x >= (ft << top)
        words.append((x[spill] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(np.nonzero(spill)[0])
        used[t] = spill.sum(axis=1)
        x[spill] >>= _WORD
        q = x // ft
        x = (q << np.uint64(bits)) + (x - q * ft) + ct
        if t % MARK == 0:
            marks[t] = x.copy()
    return np.concatenate(words[::-1]), [np.concatenate(owners[::-1]), used], np.stack([marks[t] for t in sorted(marks)])


def _decode(x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, lookup: np.ndarray, f: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """Symbols (blocks, steps, lanes) from states (blocks, lanes) and each block's next word position."""
    out = np.empty((x.shape[0], steps, x.shape[1]), dtype=np.uint32)
    at, mask = at.copy(), np.uint64((1 << bits) - 1)
    for t in range(steps):
        slot = x & mask
        s = lookup[slot.astype(np.int64)]
        out[:, t] = s
        x = f[s] * (x >> np.uint64(bits)) + slot - c[s]
        need = x < _LOW
        rank = np.cumsum(need, axis=1)
        if need.any():
            where = at[:, None] + rank - 1
            x[need] = (x[need] << _WORD) | words[where[need]].astype(np.uint64)
        at += rank[:, -1]
    return out


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, their place in that list for every id, and their counts."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    every = np.bincount(ids)  # vocabularies are small: a table instead of a sort
    symbols = np.flatnonzero(every)
    place = np.zeros(len(every), dtype=np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    return symbols.astype(ids.dtype), place[ids], every[symbols]


def encode_segment(ids: np.ndarray, bits: int = BITS) -> bytes:
    """One segment: header, shared frequency table, block index, checkpoints, words."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    symbols, dense, counts = _dense(ids)
    freq = quantise(counts, bits) if len(counts) else counts
    start = np.cumsum(freq) - freq
    block = LANES * STEPS
    head, parts = {"n": len(ids), "bits": bits, "lanes": LANES, "mark": MARK, "blocks": []}, []
    groups = [(0, len(ids) // block, block)] if len(ids) >= block else []
    if len(ids) % block:
        groups.append((len(ids) // block, 1, len(ids) % block))
    for first, many, size in groups:
        piece = dense[first * block: first * block + many * size].reshape(many, size)
        steps = -(-size // LANES)
        if size % LANES:  # the last step is filled up with the first symbol
            piece = np.concatenate([piece, np.zeros((many, steps * LANES - size), dtype=piece.dtype)], axis=1)
        piece = piece.reshape(many, steps, LANES)
        words, (owner, used), marks = _encode(freq[piece], start[piece], bits)
        by_block = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=many))
        before = np.cumsum(used, axis=0) - used  # words of the block ahead of each step
        for b in range(many):
            lo, hi = int(ends[b - 1]) if b else 0, int(ends[b])
            raw = ids[(first + b) * block: (first + b) * block + size]
            head["blocks"].append({"n": size, "words": hi - lo, "crc": zlib.crc32(raw.tobytes()),
                                   "marks": [int(before[t, b]) for t in range(0, steps, MARK)]})
            parts += [marks[:, b].astype("<u8").tobytes(), words[by_block[lo:hi]].astype("<u4").tobytes()]
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    head["symbols"], head["table"] = len(symbols), len(table)
    text = json.dumps(head, separators=(",", ":")).encode()
    body = b"".join([struct.pack("<4sI", b"rANS", len(text)), text, table, *parts])
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """Reads a segment; :meth:`block` decodes any one block, :meth:`piece` from a checkpoint on."""

    def __init__(self, data: bytes):
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]) or data[:4] != b"rANS":
            raise ValueError("damaged segment")
        size = struct.unpack("<I", data[4:8])[0]
        self.head, at = json.loads(data[8:8 + size]), 8 + size
        m = self.head["symbols"]
        table = np.frombuffer(zlib.decompress(data[at:at + self.head["table"]]), dtype="<u4")
        at += self.head["table"]
        self.symbols = np.cumsum(table[:m], dtype=np.int64).astype(np.uint32)
        self.freq = table[m:].astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq if m else self.freq
        self.lookup = np.repeat(np.arange(m, dtype=np.uint32), self.freq.astype(np.int64))
        self.blocks = []
        for b in self.head["blocks"]:
            k = len(b["marks"]) * self.head["lanes"]
            states = np.frombuffer(data, "<u8", k, at).reshape(len(b["marks"]), -1)
            words = np.frombuffer(data, "<u4", b["words"], at + 8 * k)
            at += 8 * k + 4 * b["words"]
            self.blocks.append((b, states, words))

    def _run(self, states, words, at, steps):
        return _decode(states.astype(np.uint64), words, at, steps, self.lookup, self.freq, self.start, self.head["bits"])

    def piece(self, block: int, mark: int) -> np.ndarray:
        """Ids of one block from checkpoint ``mark`` to the next."""
        b, states, words = self.blocks[block]
        lanes, first = self.head["lanes"], mark * self.head["mark"]
        steps = min(-(-b["n"] // lanes) - first, self.head["mark"])
        got = self._run(states[mark:mark + 1], words, np.array([b["marks"][mark]]), steps)
        return self.symbols[got.reshape(-1)[: b["n"] - first * lanes]]

    def block(self, block: int) -> np.ndarray:
        return self._checked(block, np.concatenate([self.piece(block, k) for k in range(len(self.blocks[block][0]["marks"]))]))

    def _checked(self, block: int, ids: np.ndarray) -> np.ndarray:
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.blocks[block][0]["crc"]:
            raise ValueError(f"block {block}: checksum differs")
        return ids

    def ids(self) -> np.ndarray:
        """All ids; blocks of one length are decoded side by side."""
        out = [np.empty(0, dtype=np.uint32)]
        todo = list(range(len(self.blocks)))
        while todo:
            n = self.blocks[todo[0]][0]["n"]
            same = [k for k in todo if self.blocks[k][0]["n"] == n]
            todo = todo[len(same):]
            words = np.concatenate([self.blocks[k][2] for k in same])
            at = np.cumsum([0] + [len(self.blocks[k][2]) for k in same[:-1]])
            got = self._run(np.stack([self.blocks[k][1][0] for k in same]), words, at, -(-n // self.head["lanes"]))
            for k, g in zip(same, got):
                out.append(self._checked(k, self.symbols[g.reshape(-1)[:n]]))
        return np.concatenate(out)


# ---- tokenising -------------------------------------------------------------------------------------------

# The pretoken pattern of byte-level BPE, its classes written out for code points below U+0250.
_WS = "\t-\r \x85\xa0"
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BEYOND = re.compile("[^\0-ɏ]")
_SPACES = frozenset(re.findall(f"[{_WS}]", "".join(map(chr, range(0x250)))))
#: Class of a code point: 0 white space, 1 letter, 2 number, 3 other.
_KIND = np.array([0 if c in _SPACES else 1 if re.match(f"[{_L}]", c) else 2 if re.match(f"[{_N}]", c) else 3 for c in map(chr, range(0x250))], dtype=np.uint8)


def _cuts(code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pretokens of texts below U+0250 begin, as the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^LNS]+|S+(?!\\S)|S+`` finds them; the last place is the end.

    ``code`` holds the code points of the texts in one array, ``begins`` the start of each text and the end."""
    kind, n = _KIND[code], len(code)
    border = np.zeros(n + 1, dtype=bool)
    border[begins] = True
    edge = border.copy()  # runs of one class
    edge[1:n] |= kind[1:] != kind[:-1]
    cut = edge.copy()
    # white space before a run leaves its last character, and a blank goes with that run
    last = np.flatnonzero((kind == 0) & edge[1:] & ~border[1:])
    cut[last] = True
    cut[last[code[last] == 32] + 1] = False
    # a contraction takes its letters from the run behind
    mark = np.flatnonzero((code == 39) & cut[:n] & edge[1:] & ~border[1:])
    if len(mark):
        one, two = code[mark + 1], np.where(border[mark + 2], 0, code[np.minimum(mark + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut[mark[short | long] + 1] = False
        cut[mark[short] + 2] = True
        cut[mark[long] + 3] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids as little-endian bytes. Pretokens of byte-level BPE are encoded once and remembered as Arrow arrays
    (the library keeps few of them); texts beyond U+024F or with the string of an added token go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_list(pa.uint32()))
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                         and not spec.get("normalizer"))
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        vocab = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.blank[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # byte level writes a blank so

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: pa.Array) -> pa.Array:
        """Lists of the ids of pretokens, each a text for the library."""
        raw = self._library(words.to_pylist())
        return pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, raw)]) // 4), pa.array(np.frombuffer(b"".join(raw), dtype="<u4")))

    def _joined(self, words: pa.Array) -> pa.Array:
        """The same for pretokens of a blank and other characters, many to a text: the library cuts them there again,
        and the tokens that begin with a blank are the first of each."""
        at, text = np.frombuffer(words.buffers()[1], dtype="<i8")[: len(words) + 1], words.buffers()[2].to_pybytes()
        groups = [*at[:-1:JOINED].tolist(), int(at[-1])]
        texts = [text[x:y].decode() for x, y in zip(groups, groups[1:])]
        raw = self._library(texts)
        flat = np.frombuffer(b"".join(raw), dtype="<u4")
        first = np.flatnonzero(self.blank[flat])
        ends = np.searchsorted(first, np.cumsum([0, *map(len, raw)]) // 4)
        wanted = np.minimum(np.arange(len(groups)) * JOINED, len(words))
        if not np.array_equal(ends, wanted) or any(a in t for t in texts for a in self.added):
            return self._each(words)
        return pa.LargeListArray.from_arrays(pa.array(np.append(first, len(flat))), pa.array(flat))

    def _fresh(self, words: pa.Array) -> pa.Array:
        """Lists of the ids of distinct pretokens."""
        at = np.frombuffer(words.buffers()[1], dtype="<i8")[words.offset: words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        second = raw[np.minimum(at[:-1] + 1, len(raw) - 1)]
        # a second character in U+0080 to U+00BF may be white space
        join = (raw[at[:-1]] == 32) & (np.diff(at) > 1) & (second > 32) & (second != 0xC2)
        order = np.argsort(~join, kind="stable")
        many = int(join.sum())
        ordered = words.take(pa.array(order))
        parts = [encode(w) for encode, w in ((self._joined, ordered[:many]), (self._each, ordered[many:])) if len(w)]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        text = "".join(texts)
        if not text:
            return [b""] * len(texts)
        code = np.frombuffer(text.encode("utf-16-le"), dtype="<u2")
        begins = np.cumsum([0, *map(len, texts)])
        cuts = _cuts(code, begins)
        place = cuts + np.searchsorted(np.flatnonzero(code >= 0x80), cuts)  # in UTF-8
        coded = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(place), pa.py_buffer(text.encode())]).dictionary_encode()
        known = len(self.words)  # distinct as they are, they get the first numbers
        every = pa.concat_arrays([self.words, coded.dictionary]).dictionary_encode()
        words, ids, number = every.dictionary, self.ids, every.indices[known:]
        if len(words) > known:
            ids = pa.concat_arrays([ids, self._fresh(words[known:])])
        used = ids.take(number)
        lists = used.take(coded.indices)
        # beyond the room, go on with those of these texts
        self.words, self.ids = (words, ids) if len(words) <= REMEMBERED else (coded.dictionary, used)
        raw = memoryview(lists.values.to_numpy()).cast("B")
        ends = 4 * lists.offsets.to_numpy()[np.searchsorted(cuts, begins)]
        return [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.by_piece or _BEYOND.search(t) or any(a in t for a in self.added)]
        rest = sorted(set(range(len(texts))).difference(whole))
        out: list[bytes] = [b""] * len(texts)
        for i, got in chain(zip(rest, self._by_piece([texts[i] for i in rest])), zip(whole, self._library([texts[i] for i in whole]))):
            out[i] = got
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- Spark ------------------------------------------------------------------------------------------------

def _some(texts: Iterator[tuple], most: int = 1 << 23) -> Iterator[list[tuple]]:
    """Groups of (id, text) of about ``most`` characters."""
    held, size = [], 0
    for row in texts:
        held.append(row)
        size += len(row[1]) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Tokenise ``docs(doc_id, text)`` and write segments in ascending doc_id order to ``path``.

    ``tokenizer`` is the path of a tokenizers JSON file that every executor can read."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()),
                           T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("data", T.BinaryType())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lengths, held, size, id_type = [], [], [], 0, None

        def close():
            raw = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([ids], pa.list_(id_type)),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([len(raw)], pa.int64()), pa.array([encode_segment(raw)], pa.binary())],
                names=schema.names)

        for batch in batches:
            id_type = batch.column(0).type
            rows = ((i.as_py(), t.as_py() or "") for i, t in zip(batch.column(0), batch.column(1)))
            for some in _some(rows):
                for (doc, _), got in zip(some, enc.encode([t for _, t in some])):
                    got += end
                    ids.append(doc)
                    lengths.append(len(got) // 4)
                    held.append(got)
                    size += len(got) // 4
                    if size >= SEGMENT:
                        yield close()
                        ids, lengths, held, size, seg = [], [], [], 0, seg + 1
        if ids:
            yield close()

    rows = (docs.select("doc_id", "text", *row_key()).repartitionByRange(widths(docs.sparkSession), "doc_id", "_th")
            .sortWithinPartitions("doc_id", "_th").select("doc_id", "text"))
    map_arrow(rows, run, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, seg, doc_id, at, ids): documents decoded from the files; ids are little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("doc_id", kind),
                           T.StructField("at", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seg, docs, lengths, data = (batch.column(k)[i] for k in range(5))
                lengths = np.array(lengths.as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                raw = Segment(data.as_py()).ids().astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(lengths), pa.int32()), pa.array([seg.as_py()] * len(lengths), pa.int32()), docs.values,
                     pa.array(ends - lengths), pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())], pa.binary())],
                    names=schema.names)

    return map_arrow(files.select("part", "seg", "doc_ids", "lengths", "data"), run, schema)


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files."""
    segments = spark.read.parquet(path).select("part", "seg", "n_tokens")
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per range partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "seg", (F.col("base") + F.col("ahead")).alias("base"))
    rows = read_token_files(spark, path).select("part", "seg", "doc_id", "at", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                                F.crc32("ids").alias("ids_crc32"))
    return rows.join(bases, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Contract query: write the token files to the shared folder, then report from what is read back."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = work_dir(spark, "token-files")
    write_token_files(docs, tokenizer, path)
    return token_report(spark, path)
