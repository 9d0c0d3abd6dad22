"""Operator 11 - phrase collocations by dynamic itemset counting.

The documents are written once as ``shards`` shards, which are scanned in a cycle.
Words are counted from the first scan on. At the stop after every scan a phrase
whose count has reached the threshold becomes ready; a longer phrase is counted
from the first scan on for which both its subphrases (without its last, without
its first word) are ready, and through one full cycle, so that it meets every shard
once. Lengths are interleaved: one scan counts words, pairs and longer phrases that
are open. The scans end when no phrase is open. A phrase at the threshold has
subphrases at the threshold, so none is missed.

The scans count by a 48-bit hash of language and phrase: only numbers are shuffled,
and phrases below the threshold, nearly all of them, never as text. Hashes that meet
can only make a phrase ready too early. A last scan of all shards brings the phrases
that became ready as text, and the counts that are returned are those of the texts.

Counts are kept as sorted arrays, one for each scan and range of hashes, in a table of
the shared folder that is bucketed by range: a scan adds its own arrays, and looking for
newly ready phrases brings the arrays of one range together without a shuffle. Hashes of
48 bits are shuffled and stored as the steps from one to the next, counts as they are,
both by bytes of equal weight and without the upper bytes that no value needs. Ranges of
a hash are even whatever the phrases are; ``ranges`` is how many there are, so that one
range's arrays fit a task.

Ready phrases are known to the scanning tasks by a table of ``2^bits`` buckets a length,
each with the stop at which its first phrase became ready; a phrase looks into two
buckets and takes the later stop. That table is the only thing broadcast, and its size is
fixed. A phrase that meets ready ones in both starts early (more is counted, nothing is
lost), and as a bucket's stop never changes, a phrase's first scan is the same in every task.

Cases: null text is empty, null lang is ``und``; repeated rows count as often as they
come; texts and pieces of any length are read whole (a long text is cut at piece
borders, where no phrase crosses); equal scores rank by count, then phrase in UTF-8
byte order; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paysift.sources.sinks import work_dir

from .common import importable, map_arrow, stored, widths

SHARDS = 4
WORDS = 3
THRESHOLD = 10
#: A phrase goes if a longer one that holds it comes at least this often, in percent of it.
ABSORB = 50
TOP = 2000
BITS = 23
#: Ranges of hashes a shuffle partition, and keys a task holds before it sends them on.
RANGES = 4
HELD = 1 << 20
#: Ranges of hashes a shuffle partition in the last scan, whose texts take more room.
TEXT_RANGES = 16
#: Bytes of text that a task takes at once.
CHUNK = 3 << 20
#: First ranks are taken in this many parts of a language, then in fewer.
SALTS = (64, 4)

COUNTS = "n_words int, part int, keys binary, counts binary"
TEXTS = "part int, names array<string>, langs binary, phrases binary, counts binary"
PHRASES = "lang string, phrase string, c long"

_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of a hash that are kept, the upper ones.
_SHORT = np.uint64(16)
_KEPT = ~np.uint64((1 << 16) - 1)
_CODEC = pa.Codec("zstd", 1)
#: Stops are kept in a byte.
_NEVER = 255


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    """(lang, text) pairs in lists of about CHUNK bytes; a longer text is cut after piece ends."""
    held, size = [], 0
    for batch in batches:
        for lang, value in zip(batch.column(0), batch.column(1)):
            lang, text, at = lang.as_py(), value.as_buffer().to_pybytes(), 0
            while len(text) - at > CHUNK and (end := _BREAK.search(text, at + CHUNK)):
                yield [(lang, text[at:end.end()])]
                at = end.end()
            held.append((lang, text[at:]))
            size += len(text) - at
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of all but its last word and of that word."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x2545F4914F6CDD1D))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Chunk:
    """Words of a list of texts, as numbers by position."""

    def __init__(self, docs: list[tuple[str, bytes]]):
        raw = np.frombuffer(b"\n".join(text for _, text in docs).translate(_FOLD), dtype=np.uint8)
        inside = (raw != 32) & (raw != 10)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        self.piece = np.cumsum(raw == 10, dtype=np.int32)[start]
        # the words as one Arrow array over the text without its gaps
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        del raw, inside, edges
        self.names = sorted({lang for lang, _ in docs})
        number = {name: i for i, name in enumerate(self.names)}
        begins = np.searchsorted(start, np.cumsum([0] + [len(text) + 1 for _, text in docs]))
        self.lang = np.repeat(np.array([number[name] for name, _ in docs], dtype=np.int32), np.diff(begins))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        n = max(1, len(distinct))
        key = self.lang.astype(np.int64) * n + coded.indices.to_numpy()
        if n * len(self.names) <= 8 * len(key) + 1024:  # a table of all (language, word) numbers instead of a sort
            every = np.bincount(key, minlength=n * len(self.names))
            used = np.flatnonzero(every)
            place = np.zeros(len(every), dtype=np.int32)
            place[used] = np.arange(len(used), dtype=np.int32)
            self.code, self.many = place[key], every[used]
        else:
            used, code, self.many = np.unique(key, return_inverse=True, return_counts=True)
            self.code = code.astype(np.int32)
        tags = [name.encode() + b"\x00" for name in self.names]
        self.one = np.fromiter((xxhash.xxh64_intdigest(tags[k // n] + distinct[k % n]) for k in used.tolist()), dtype=np.uint64, count=len(used)) & _KEPT
        self._used, self._distinct = used % n, coded.dictionary

    def hashes(self, max_words: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each length the hash of the phrase from every word on (also of those across a piece end)."""
        single = found = self.one[self.code]
        yield 1, found
        for length in range(2, max_words + 1):
            found = _mixed(found[:-1], single[length - 1:]) & _KEPT
            yield length, found

    def whole(self, length: int) -> np.ndarray:
        """Whether the phrase from a word on lies within a piece."""
        return self.piece[: len(self.piece) - length + 1] == self.piece[length - 1:]

    def texts(self, at: np.ndarray, length: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """Language, text and count of the distinct phrases at the given words, and the first of those words."""
        word = self._distinct.cast(pa.string()).take(pa.array(self._used))
        key = self.code[at].astype(np.int64)
        for i in range(1, length):
            if len(word) * (int(key.max()) + 1) >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(word) + self.code[at + i]
        _, first, many = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        words = [word.take(pa.array(self.code[first + i])) for i in range(length)]
        return pa.array(self.names).take(pa.array(self.lang[first])), pc.binary_join_element_wise(*words, " ") if length > 1 else words[0], many, first


def _buckets(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each key."""
    top = np.uint64(64 - bits)
    return (keys >> top).astype(np.int64), ((keys * np.uint64(0xD6E8FEB86659FD93)) >> top).astype(np.int64)


def _since(ready: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """The stop at which each key counts as ready, _NEVER if not yet."""
    one, two = _buckets(keys, bits)
    return np.maximum(ready[one], ready[two])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts[order], starts, dtype=np.int64)


def _open(chunk: _Chunk, scan: int, shards: int, max_words: int, ready: list[np.ndarray], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, hashes and counts of the phrases of a chunk that are open in this scan."""
    before = None
    for length, found in chunk.hashes(max_words):
        if length == 1:
            if scan < shards:
                yield 1, chunk.one, chunk.many
        else:
            since = _since(ready[length - 2], before, bits)  # the stop of the shorter phrase from each word on
            since = np.maximum(since[:-1], since[1:]).astype(np.int32)
            keys, many = np.unique(found[chunk.whole(length) & (since <= scan) & (since > scan - shards)], return_counts=True)
            if len(keys):
                yield length, keys, many
        before = found


def _planes(values: np.ndarray) -> bytes:
    """Numbers from 0 on, their lowest bytes first, then the next ones, as far as any number has such bytes."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(data: pa.Buffer) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    planes = raw[1:].reshape(int(raw[0]), -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


def _stored_keys(keys: np.ndarray) -> bytes:
    """The first of sorted keys, then the steps."""
    short = keys >> _SHORT
    return short[:1].astype("<u8").tobytes() + _planes(np.diff(short))


def _part(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key."""
    return ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int32)


def _arrays(length: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row for every range that sorted keys touch."""
    part = _part(keys, ranges)
    cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    spans = list(zip(cut[:-1], cut[1:]))
    return pa.RecordBatch.from_arrays([
        pa.array([length] * len(spans), pa.int32()), pa.array(part[cut[:-1]]),
        pa.array([_stored_keys(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in spans], pa.binary())],
        names=["n_words", "part", "keys", "counts"])


def _counted(batches, scan: int, shards: int, max_words: int, ready: list[np.ndarray], bits: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """A task of a scan: counts summed over its chunks, HELD keys at most at a time."""
    held: dict[int, list] = {}

    def out(length):
        parts = held.pop(length)
        yield _arrays(length, *_summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])), ranges)
    for docs in _chunks(batches):
        chunk = _Chunk(docs)
        if not len(chunk.code):
            continue
        for length, keys, many in _open(chunk, scan, shards, max_words, ready, bits):
            held.setdefault(length, []).append((keys, many.astype(np.int32)))
            if sum(len(k) for k, _ in held[length]) > HELD:
                yield from out(length)
    for length in list(held):
        yield from out(length)


def _table_arrays(table: pa.Table, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of one row."""
    keys = table["keys"][row].as_buffer()
    keys = np.cumsum(np.concatenate((np.frombuffer(keys, dtype="<u8", count=1), _unplaned(keys.slice(8)))), dtype=np.uint64)
    return keys << _SHORT, _unplaned(table["counts"][row].as_buffer()).astype(np.int64)


def _merge(table: pa.Table) -> pa.Table:
    """The arrays of one range from all tasks of a scan, as one."""
    parts = [_table_arrays(table, i) for i in range(table.num_rows)]
    keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    return table.slice(0, 1).select(["n_words", "part"]).append_column("keys", pa.array([_stored_keys(keys)], pa.binary())).append_column("counts", pa.array([_planes(counts)], pa.binary()))


def _newly_ready(last: int, threshold: int, bits: int):
    """Buckets of the keys of one range that reached the threshold with scan ``last``."""
    def check(table: pa.Table) -> pa.Table:
        scans = table["scan"].to_pylist()
        found = np.zeros(0, dtype=np.int64)
        if last in scans:
            keys, now = _table_arrays(table, scans.index(last))
            before = np.zeros(len(keys), dtype=np.int64)
            for row, scan in enumerate(scans):
                if scan != last:
                    old, counts = _table_arrays(table, row)
                    at = np.minimum(np.searchsorted(old, keys), len(old) - 1)
                    before += np.where(old[at] == keys, counts[at], 0)
            found = np.unique(np.concatenate(_buckets(keys[(before < threshold) & (before + now >= threshold)], bits)))
        return pa.table({"n_words": pa.array(np.full(len(found), table["n_words"][0].as_py(), dtype=np.int32)), "bucket": pa.array(found.astype(np.int32))})
    return check


def _texts(docs: list[tuple[str, bytes]], max_words: int, ready: list[np.ndarray], bits: int, parts: int) -> Iterator[pa.Table]:
    """Texts and counts of the phrases of one chunk that became ready; the empty phrase has the number of words of its language."""
    chunk = _Chunk(docs)
    if not len(chunk.code):
        return

    def rows(lang, phrase, counts, part):
        return pa.table({"lang": lang, "phrase": phrase, "c": pa.array(counts, pa.int64()), "part": pa.array(part, pa.int32())})
    counts = np.bincount(chunk.lang, minlength=len(chunk.names))
    yield rows(pa.array(chunk.names), pa.array([""] * len(counts)), counts, np.zeros(len(counts), dtype=np.int32))
    for length, found in chunk.hashes(max_words):
        at = np.flatnonzero(chunk.whole(length) & (_since(ready[length - 1], found, bits) != _NEVER))
        if len(at):
            lang, phrase, counts, first = chunk.texts(at, length)
            yield rows(lang, phrase, counts, _part(found[first], parts))


def _squeezed(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + _CODEC.compress(data, asbytes=True)


def _unsqueezed(data: pa.Buffer) -> bytes:
    return _CODEC.decompress(data.slice(8), struct.unpack("<q", data[:8])[0], asbytes=True) if data.size > 8 else b""


def _added_up(tables: list[pa.Table], *keys: str) -> pa.Table:
    return pa.concat_tables(tables).group_by([*keys, "lang", "phrase"], use_threads=False).aggregate([("c", "sum")]).rename_columns([*keys, "lang", "phrase", "c"])


def _packed(table: pa.Table) -> pa.RecordBatch:
    """A row for every part: its phrases, a line each (no phrase has a line break), their languages by number, their counts."""
    table = table.take(pa.array(np.argsort(table["part"].to_numpy(), kind="stable"))).combine_chunks()
    part, phrase = table["part"].to_numpy(), pc.cast(table["phrase"].combine_chunks(), pa.large_string())
    coded = table["lang"].combine_chunks().dictionary_encode()
    lang, counts = coded.indices.to_numpy(), table["c"].to_numpy()
    cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])).tolist()
    lines = pc.binary_join_element_wise(phrase, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    ends = np.frombuffer(lines.buffers()[1], dtype="<i8")[: len(lines) + 1]
    text = memoryview(lines.buffers()[2])
    spans = list(zip(cut, cut[1:]))
    return pa.RecordBatch.from_arrays([
        pa.array(part[cut[:-1]]), pa.array([coded.dictionary.to_pylist()] * len(spans), pa.list_(pa.string())),
        pa.array([_squeezed(_planes(lang[a:b])) for a, b in spans], pa.binary()),
        pa.array([_squeezed(bytes(text[ends[a]:ends[b]])) for a, b in spans], pa.binary()),
        pa.array([_squeezed(_planes(counts[a:b])) for a, b in spans], pa.binary())], names=["part", "names", "langs", "phrases", "counts"])


def _unpacked(table: pa.Table) -> Iterator[pa.Table]:
    """The phrases of each row of one part."""
    for row in range(table.num_rows):
        names = table["names"][row].values
        langs, counts = (_unplaned(pa.py_buffer(_unsqueezed(table[c][row].as_buffer()))) for c in ("langs", "counts"))
        raw = np.frombuffer(_unsqueezed(table["phrases"][row].as_buffer()), dtype=np.uint8)
        line = raw == 10
        ends = np.concatenate(([0], np.flatnonzero(line) - np.arange(len(langs)))).astype("<i8")
        phrase = pa.Array.from_buffers(pa.large_string(), len(langs), [None, pa.py_buffer(ends), pa.py_buffer(raw[~line])])
        yield pa.table({"lang": names.take(pa.array(langs.astype(np.int64))), "phrase": phrase, "c": pa.array(counts.astype(np.int64))})


def _ready_texts(batches, max_words: int, ready: list[np.ndarray], bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A task of the last scan: texts counted over its chunks, about HELD at most at a time."""
    held: list[pa.Table] = []
    for docs in _chunks(batches):
        held += _texts(docs, max_words, ready, bits, parts)
        if sum(t.num_rows for t in held) > HELD:
            yield _packed(_added_up(held, "part"))
            held = []
    if held:
        yield _packed(_added_up(held, "part"))


def _often(threshold: int):
    """Phrases of one part that come often enough, and the words of each language."""
    def check(table: pa.Table) -> pa.Table:
        total = _added_up(list(_unpacked(table)))
        total = total.filter(pc.or_(pc.greater_equal(total["c"], threshold), pc.equal(total["phrase"], "")))
        return total.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())]))
    return check


def ready_phrases(shard: DataFrame, max_words: int, threshold: int, shards: int, bits: int) -> list[np.ndarray]:
    """The scans: for each length the stop at which each bucket had its first ready phrase."""
    spark = shard.sparkSession
    importable(spark)
    buckets = widths(spark)
    ranges = RANGES * buckets
    table, place = f"paysift_phrases_{uuid.uuid4().hex}", work_dir(spark, "phrases")
    ready = [np.full(1 << bits, _NEVER, dtype=np.uint8) for _ in range(max_words)]
    scan, until = 0, shards
    try:
        while scan < until:
            known = spark.sparkContext.broadcast(ready[:-1])

            def task(batches, scan=scan, known=known):
                return _counted(batches, scan, shards, max_words, known.value, bits, ranges)
            counts = map_arrow(shard.filter(F.col("_shard") == scan % shards).select("lang", "text"), task, COUNTS)
            (counts.groupBy("n_words", "part").applyInArrow(_merge, COUNTS).withColumn("scan", F.lit(scan))
             .write.bucketBy(buckets, "n_words", "part").option("path", place).mode("append").saveAsTable(table))
            known.destroy()

            new = spark.table(table).groupBy("n_words", "part").applyInArrow(_newly_ready(scan, threshold, bits), "n_words int, bucket int").distinct().toArrow()
            scan += 1
            length, found = new["n_words"].to_numpy(), new["bucket"].to_numpy()
            for n in range(1, max_words + 1):
                first = found[length == n]
                first = first[ready[n - 1][first] == _NEVER]
                ready[n - 1][first] = scan
                if n < max_words and (length == n).any():
                    until = scan + shards
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return ready


def phrase_counts(docs: DataFrame, max_words: int = WORDS, threshold: int = THRESHOLD, shards: int = SHARDS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, f`` of all words and phrases with f >= threshold, and ``lang, n`` of all words."""
    if shards * max_words >= _NEVER:
        raise ValueError(f"{shards} shards for phrases of {max_words} words make too many stops")
    spark = docs.sparkSession
    path = work_dir(spark, "shards")
    (docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"), (F.monotonically_increasing_id() % shards).alias("_shard"))
     .filter("text <> ''").write.partitionBy("_shard").parquet(path))
    shard = spark.read.schema("lang string, text string, _shard int").parquet(path)
    ready = spark.sparkContext.broadcast(ready_phrases(shard, max_words, threshold, shards, bits))

    parts = TEXT_RANGES * widths(spark)

    def task(batches):
        return _ready_texts(batches, max_words, ready.value, bits, parts)
    counts = map_arrow(shard.select("lang", "text"), task, TEXTS).groupBy("part").applyInArrow(_often(threshold), PHRASES)
    # words of a language are in one part, as each phrase is
    often = stored(counts.withColumnRenamed("c", "f"), "often")
    ready.destroy()
    phrases = often.filter("phrase <> ''").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), "f")
    return phrases, often.filter("phrase = ''").select("lang", F.col("f").alias("n"))


def _parts(shortest: int):
    """Contiguous parts of ``_w`` of at least ``shortest`` words and fewer than all, as phrases."""
    n = F.size("_w")
    return F.flatten(F.transform(F.sequence(F.lit(shortest), n - 1), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice("_w", i, m), " "))))


def collocations(docs: DataFrame, max_words: int = WORDS, threshold: int = THRESHOLD, absorb: int = ABSORB, top: int = TOP,
                 shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by their lowest-scoring cut."""
    often, total = phrase_counts(docs, max_words, threshold, shards, bits)
    phrases = often.filter("n_words > 1").withColumn("_w", F.split("phrase", " "))
    inside = (phrases.filter("n_words > 2").select("lang", F.explode(_parts(2)).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    left = (phrases.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < absorb * F.col("f"), F.lit(True)))
            .select("lang", "phrase", F.col("f").alias("a"), "_w"))
    cuts = (left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_head"),
                    F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w") - F.col("k")), " ").alias("_rest")))
    heads = often.select("lang", F.col("phrase").alias("_head"), F.col("f").alias("l"))
    rests = often.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    score = F.expr("(CAST(1000000 AS DECIMAL(38, 0)) * a * a) div (CAST(l AS DECIMAL(38, 0)) * r)")
    scored = (cuts.join(heads, ["lang", "_head"]).join(rests, ["lang", "_rest"]).withColumn("score", score)
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scored
    for salts in SALTS:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        best = best.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH piece AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
phrase AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM piece
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM piece
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM piece),
f AS (SELECT lang, m, phrase, count(*) AS f FROM phrase GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
inner_pair AS (
  SELECT lang, p AS phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM cand WHERE m = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_pair i USING (lang, phrase) WHERE NOT coalesce(100 * i.longer >= 50 * c.a, false)),
cut AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS head, CASE WHEN m = 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS rest FROM kept
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE m = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
