"""SimHash near-dedup: bit-sliced comparison of 64-bit fingerprints, and connected components of the links.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words joined by one space (fewer
words: the whole sequence; none: fingerprint zero), XXH64 with seed 42; a bit is 1 if set in over half the hashes.

Links: two fingerprints within ``radius`` bits agree on ``blocks - radius`` of ``blocks`` bit blocks, so each is dealt
under every such choice of blocks (a mask) and compared within its buckets only; no link is lost.  A bucket that holds
more than ``BUCKET`` fingerprints is dealt anew by further blocks of its other bits, twice if need be, and one that is
still as large is compared in pairs of bounded parts.  Within a bucket, bit planes are stored vertically: one word
holds one bit of 64 candidates, carry-save counters add the differing bits, and a tile is abandoned once all its lanes
exceed the radius.  A bucket returns a forest of its links (a row per fingerprint at most), never all pairs.

Defined cases: an empty table gives an empty result; null text has no words; null ids never name a component unless
all its ids are null; repeated rows share a fingerprint.  Only id and text are read, whatever the other columns' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import small, without, written

SEED = 42
BUCKET = 2048
CHUNK = 1 << 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(whole)]))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[k:k + CHUNK], ends[k:k + CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, key (hash of the text), rid and fp (signed) per row."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"),
                     F.monotonically_increasing_id().alias("rid"), F.col(f"`{text_col}`").alias("text"))
    schema = rows.select("id", "key", "rid", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], batch["rid"], pa.array(fp.view(np.int64))], ["id", "key", "rid", "fp"])
    return rows.mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """All unions of ``agree`` of the ``blocks`` even parts of ``bits``, as bit masks."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(parts, agree)]


def first_masks(n: int, radius: int) -> list[int]:
    """The fewest blocks whose keys leave about 64 of ``n`` even fingerprints in a bucket."""
    for blocks in range(radius + 1, max(1, radius) + radius + 1):
        if n <= 64 * 2 ** (64 * (blocks - radius) / blocks):
            break
    return masks(list(range(64)), blocks, blocks - radius)


def planes(tiles: np.ndarray) -> np.ndarray:
    """[t, 64] fingerprints to [t, 64] bit planes: bit i of plane b is bit b of fingerprint i."""
    bits = np.unpackbits(tiles.astype("<u8").view(np.uint8).reshape(len(tiles), 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(len(tiles), 64, 8).copy().view("<u8")[:, :, 0]


def above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose carry-save counter is over ``radius``."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], ONES)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            more, same = more | (same & counter[k]), same & ~counter[k]
    return more


def tile_links(query: np.ndarray, plane: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile pair, query, candidate) of every link.  query [p, 64]; plane [p, 64]; lanes [p, 64]: candidates to compare."""
    alive, at = lanes.copy(), np.arange(len(query))
    counter = [np.zeros_like(query) for _ in range(radius.bit_length())]
    for b in range(64):
        carry = plane[:, b, None] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for k, c in enumerate(counter):
            counter[k], carry = c ^ carry, c & carry
        alive &= ~carry
        if b % 8 == 7:
            alive &= ~above(counter, radius)
            keep = alive.any(axis=1)
            if not keep.all():
                query, plane, alive, at = query[keep], plane[keep], alive[keep], at[keep]
                counter = [c[keep] for c in counter]
            if not len(at):
                break
    p, q = np.nonzero(alive)
    lane = np.unpackbits(alive[p, q].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, c = np.nonzero(lane)
    return at[p[hit]], q[hit], c


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over ``fp`` (uint64), rows of one bucket having one ``run`` number (sorted)."""
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[begin, len(run)])
    begin, size = begin[size > 1], size[size > 1]
    if not len(begin):
        return fp[:0], fp[:0]
    count = -(-size // 64)
    first = np.r_[0, np.cumsum(count)[:-1]]
    start = np.repeat(begin - 64 * first, count) + 64 * np.arange(count.sum())
    end = np.repeat(begin + size, count)
    at = start[:, None] + np.arange(64)
    full = at < end[:, None]
    tiles = np.where(full, fp[np.minimum(at, len(fp) - 1)], np.uint64(0))
    plane = planes(tiles)
    valid = np.packbits(full, axis=1, bitorder="little").view("<u8")[:, 0]
    later = ~((np.uint64(2) << np.arange(64, dtype=np.uint64)) - np.uint64(1))  # lanes after the query's own
    u = np.concatenate([np.repeat(f + np.arange(c), c - np.arange(c)) for f, c in zip(first, count)])
    v = np.concatenate([f + np.concatenate([np.arange(i, c) for i in range(c)]) for f, c in zip(first, count)])
    left, right = [], []
    for k in range(0, len(u), 1024):
        x, y = u[k:k + 1024], v[k:k + 1024]
        lanes = np.where((x == y)[:, None], valid[y][:, None] & later, valid[y][:, None])
        lanes = np.where(full[x], lanes, np.uint64(0))
        p, q, c = tile_links(tiles[x], plane[y], lanes, radius)
        left.append(start[x[p]] + q)
        right.append(start[y[p]] + c)
    label = forest(len(fp), np.concatenate(left), np.concatenate(right))
    child = np.flatnonzero(label != np.arange(len(fp)))
    return fp[child], fp[label[child]]


def compare(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of ``rows`` (mask, value, lo, hi, fp), bucket by bucket."""
    keys = ["mask", "value", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cols):
            change = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            a, b = bucket_links(cols[4].view(np.uint64), np.cumsum(change), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        held = None
        for batch in batches:
            cols = [batch[k].to_numpy(zero_copy_only=False) for k in [*keys, "fp"]]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) < 2 * BUCKET:
                continue
            last = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in held[:4]]))
            if len(last):  # the last bucket may go on in the next batch
                yield links([c[:last[-1] + 1] for c in held])
                held = [c[last[-1] + 1:] for c in held]
        if held is not None and len(held[0]):
            yield links(held)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def dealt(fps: DataFrame, by: list[int]) -> DataFrame:
    keys = [F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for m in by]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.mask", "k.value")


def links(fps: DataFrame, n: int, radius: int, bucket: int = BUCKET, refine: int = 2) -> DataFrame:
    """Links whose components are those of all pairs of the distinct ``fps`` (fp) within ``radius`` bits."""
    level = first_masks(n, radius)
    rows, found, none = dealt(fps, level), None, F.lit(0).cast("long")
    for step in range(refine + 1):
        counts = rows.groupBy("mask", "value").agg(F.count("*").alias("n"))
        heavy = written(counts.filter(F.col("n") > bucket), f"heavy{step}")
        light = rows.join(small(heavy.select("mask", "value"), 24), ["mask", "value"], "left_anti")
        got = compare(light.select("mask", "value", none.alias("lo"), none.alias("hi"), "fp"), radius)
        found = got if found is None else found.unionByName(got)
        crowd = rows.join(small(heavy, 32), ["mask", "value"])
        if heavy.isEmpty():
            break
        if step == refine:  # parts of at most about ``bucket`` rows, each compared with each
            parts = F.ceil(F.col("n") / bucket)
            own = F.pmod(F.xxhash64("fp"), parts)
            each = crowd.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            found = found.unionByName(compare(each.select("mask", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"), radius))
            break
        used = sorted({m for m in level})
        finer = {m: [m | s for s in masks([b for b in range(64) if not m >> b & 1], radius + 2, 2)] for m in used}
        table = fps.sparkSession.createDataFrame([(signed(m), signed(x)) for m, xs in finer.items() for x in xs], "mask long, finer long")
        crowd = crowd.join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"))
        rows, level = written(crowd.distinct(), f"dealt{step}"), sorted({x for xs in finer.values() for x in xs})
    return written(found.distinct(), "links")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node of each node's component, by neighbours' labels and pointer jumps."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    if labels.isEmpty():
        return labels
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = written(labels.join(near, "node", "left").select("node", "label", F.least("label", "low").alias("new")), "lower")
        up = lower.select(F.col("node").alias("new"), F.col("new").alias("top"))
        labels = written(lower.join(up, "new").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "labels")
        if labels.filter("moved").isEmpty():
            return labels.drop("moved")
        labels = labels.drop("moved")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``df``: id, key, fp, component_id and kept (the component's first row)."""
    rows = written(fingerprints(df, id_col, text_col, width), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first")
    nodes = written(rows.groupBy("fp").agg(first), "nodes")
    labels = components(links(nodes.select("fp"), nodes.count(), radius))
    tagged = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    tagged = written(tagged, "tagged")
    heads = tagged.groupBy("label").agg(F.min("first").alias("head"))
    named = tagged.join(heads, "label").select("fp", F.col("head.id").alias("component_id"), F.col("head.rid").alias("head_rid"))
    return rows.join(named, "fp").select("id", "key", "fp", "component_id", (F.col("rid") == F.col("head_rid")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay (one a component), with all their columns."""
    out = written(near_dedup(docs, id_col, text_col, width, radius), "decisions")
    return without(docs, id_col, F.xxhash64(F.col(f"`{text_col}`")), out.select("id", "key", "kept"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
