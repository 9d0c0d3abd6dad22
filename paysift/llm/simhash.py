"""Operator 6 - SimHash near-dedup with a Gray-order hierarchical index.

1. Fingerprints: 4-word shingles hashed with XXH64, majority bit (numpy in tasks).
2. Rows are reduced to distinct fingerprints; copies never meet each other.
3. Two fingerprints within d bits agree on one of d + 1 bit blocks. For every
   block the fingerprint is rotated so that the block leads, rows are dealt by
   (block, its bits) and sorted by Gray rank. In each such run a hierarchical
   index is built: consecutive entries in Gray order share many bits, which are
   factored into the mask and value of their upper node; a node holds only the
   bits its parent has not. A query walks down with its accumulated differences
   and leaves a whole group as soon as they exceed d. The search is exact.
4. A run that holds more than ``RUN`` fingerprints is cut into chunks and every
   pair of chunks is searched by a task of its own; no link is lost.
5. The run reports a spanning forest of its links; connected components follow
   from alternating star contraction, checkpointed in the shared folder.

Cases: null or empty text has no words and gets fingerprint zero, linked like
any other; a text of fewer words than a shingle is one shingle. Null doc_ids
take part, but a component is named by its smallest non-null doc_id (null if it
has none). Repeated rows get the same result each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, one_row_each, packed, row_key, same_key, stored, widths

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of one run that one task searches; larger runs are cut into chunks.
RUN = 20_000
FANOUT = 16
#: Hashes whose bits are counted at once, and (query, node) pairs walked at once.
STEP = 1 << 16
FRONT = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:min(at + STEP, n)], ends[at + shingle - 1:])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_id, _th, fp): key and fingerprint (a signed 64-bit integer) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], names=["_id", "_th", "fp"])

    rows = docs.select(*row_key(), "text")
    return map_arrow(rows, run, rows.select("_id", "_th").schema.add("fp", "long"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence (prefix xor of its bits)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; ``run`` numbers the runs, no node spans two."""

    def __init__(self, fp: np.ndarray, run: np.ndarray):
        self.fp = fp
        level_and, level_or, owner = fp, fp, run
        first = np.arange(len(fp))
        self.levels = []  # from the level above the leaves upwards
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            inside = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            cut = np.flatnonzero(inside % FANOUT == 0)
            a, o = np.bitwise_and.reduceat(level_and, cut), np.bitwise_or.reduceat(level_or, cut)
            self.levels.append({"mask": ~(a ^ o), "value": a, "first": cut, "end": np.r_[cut[1:], len(owner)]})
            level_and, level_or, owner = a, o, owner[cut]
            if len(owner) == len(np.unique(owner)):
                break
        self.top_run = owner

    def pairs(self, side: np.ndarray | None, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs i < j of one run within ``d`` bits (only pairs of unlike ``side`` when given)."""
        top = self.levels[-1]
        leaf_end = np.arange(1, len(self.fp) + 1)
        last = []  # one past the last leaf below each node, per level
        for lv in self.levels:
            leaf_end = leaf_end[lv["end"] - 1]
            last.append(leaf_end)
        root = np.repeat(np.arange(len(top["first"])), np.diff(np.r_[0, last[-1]]))
        for at in range(0, len(self.fp), STEP):
            q = np.arange(at, min(at + STEP, len(self.fp)))
            yield from self._walk(q, root[q], np.zeros(len(q), dtype=np.uint8), np.zeros(len(q), dtype=np.uint64),
                                  len(self.levels) - 1, last, side, d)

    def _walk(self, q, node, acc, above, depth, last, side, d):
        lv = self.levels[depth]
        # bits this node adds to those its parents have already compared
        own = lv["mask"][node]
        acc = acc + np.bitwise_count((self.fp[q] ^ lv["value"][node]) & own & ~above)
        keep = (acc <= d) & (last[depth][node] > q + 1)
        q, node, acc, above = q[keep], node[keep], acc[keep], own[keep]
        width = lv["end"][node] - lv["first"][node]
        at = 0
        total = np.cumsum(width)
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FRONT)))
            w = width[at:to]
            child = np.repeat(lv["first"][node[at:to]], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            cq = np.repeat(q[at:to], w)
            if depth:
                yield from self._walk(cq, child, np.repeat(acc[at:to], w), np.repeat(above[at:to], w), depth - 1, last, side, d)
            else:
                ok = (child > cq) & (np.repeat(acc[at:to], w) + np.bitwise_count(
                    (self.fp[cq] ^ self.fp[child]) & ~np.repeat(above[at:to], w)) <= d)
                if side is not None:
                    ok &= (side[cq] != side[child]) | (side[cq] < 0)
                if ok.any():
                    yield cq[ok], child[ok]
            at = to


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each index; pairs are folded in as they come."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:  # pointer jumping
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def block_cuts(d: int) -> list[tuple[int, int]]:
    """(first bit, width) of the d + 1 blocks of 64 bits."""
    edges = [64 * i // (d + 1) for i in range(d + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, d: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(a, b): links of a spanning forest, per block run, of the fingerprints ``distinct(fp)`` within d bits."""
    cuts = block_cuts(d)
    fp = F.col("fp")
    turned = F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"),
                 (F.shiftrightunsigned(fp, 64 - a - w).bitwiseAND(F.lit((1 << w) - 1))).alias("bits"))
        for i, (a, w) in enumerate(cuts)])).alias("t")
    rows = distinct.select("fp", turned).select("fp", "t.block", "t.bits")
    sizes = rows.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["block", "bits"])
    # a run beyond `run` fingerprints: chunk x chunk tasks, each row goes to the tasks of its chunk
    k = F.ceil(F.col("n") / F.lit(run)).cast("int")
    mine = F.pmod(F.xxhash64(fp, F.lit("chunk")), k).cast("int")
    tasks = F.when(k <= 1, F.array(F.struct(F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(-1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(
            F.least(j, mine).alias("t1"), F.greatest(j, mine).alias("t2"),
            F.when(j == mine, F.lit(-1)).otherwise(mine).alias("side"))))
    dealt = (rows.select("fp", "block", "bits", F.explode(tasks).alias("t"))
             .select("fp", "block", "bits", "t.t1", "t.t2", "t.side")
             .repartition(widths(distinct.sparkSession), "block", "bits", "t1", "t2")
             .sortWithinPartitions("block", "bits", "t1", "t2"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cols):
            fps, block = cols[0].astype(np.uint64), cols[1]
            key = np.stack(cols[1:5], axis=1)
            number = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)])
            turn = np.array([a for a, _ in cuts], dtype=np.uint64)[block]
            lead = np.where(turn == 0, fps, (fps << turn) | (fps >> ((np.uint64(64) - turn) % np.uint64(64))))
            order = np.lexsort((gray_rank(lead), number))
            fps, number, side, lead = fps[order], number[order], cols[5][order], lead[order]
            root = _forest(len(fps), GrayIndex(lead, number).pairs(side, d))
            tied = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[tied].astype(np.int64)), pa.array(fps[root[tied]].astype(np.int64))],
                                              names=["a", "b"])

        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            change = np.zeros(len(held[0]), dtype=bool)
            for c in held[1:5]:
                change[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(change)
            if len(cut):  # all runs but the last are whole
                yield solve([c[:cut[-1]] for c in held])
                held = [c[cut[-1]:] for c in held]
        if held is not None and len(held[0]):
            yield solve(held)

    return map_arrow(dealt, search, "a long, b long").filter("a != b").distinct()


def components(edges: DataFrame, checkpoint) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges(a, b)``.

    Alternating large-star and small-star contraction; the number of rounds grows
    with the logarithm of the longest chain."""
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        # ordinary aggregate of the round: equal states have equal counts and sums
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(_id, _th, fp, root, component_id) for every row of ``docs(doc_id, text)``; root is a fingerprint of the group."""
    prints = stored(fingerprints(docs, shingle), "simhash-fp")
    classes = stored(prints.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-class")
    tied = components(links(classes.select("fp"), max_bits, run), lambda df: stored(df, "simhash-star"))
    named = classes.join(tied.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # one row per distinct fingerprint; a fingerprint shared by many rows is split by the skew join
    return prints.join(named.join(lows, "root").select("fp", "root", "component_id"), "fp").select(
        "_id", "_th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs``, all columns: of each group the row with the smallest doc_id (null last), one of exact repeats."""
    rows = stored(near_duplicates(docs, shingle, max_bits), "simhash-groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_th")).alias("k"))
    chosen = first.select(F.col("k._id").alias("_id"), F.col("k._th").alias("_th"))
    counts = rows.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("_n"))
    kept = chosen.join(counts, same_key(chosen, counts)).select(chosen["_id"], chosen["_th"], "_n")
    all_rows = packed(docs)
    hit = all_rows.join(kept, same_key(all_rows, kept)).select("_row", all_rows["_id"], all_rows["_th"], "_n")
    return one_row_each(hit).select("_row.*")


def op6_simhash_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
