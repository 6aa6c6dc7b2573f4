"""Document fingerprints by Order MinHash, and each document's likeness to an edited text and to the next document.

A k-mer is ``K`` code points with its occurrence number in the text.  Each of ``SKETCHES`` hash orders selects the
``TUPLE`` smallest numbered k-mers; these, put back into text order, are hashed as a tuple to one 32-bit part of the
fingerprint.  Two texts agree on a part if they share the selected k-mers and their order, so the share of equal parts
falls with the edit distance, not only with the difference of the sets.

The edited text is the document's with its last floor(n / 2) code points replaced by the first as many of the next
document in ascending id (after the last: the first).  Documents are dealt into ranges of ids, cut at quantiles, and
the first rows of each range also go to the range before, so that each range is one sorted run and a document's
neighbour is the row behind it.  A task holds two texts at a time.

Defined cases: an empty table gives an empty result; null text is empty; empty text has a fingerprint of zeros and a
text shorter than ``K`` is one k-mer; repeated rows and equal ids follow each other in the order of a hash of the row;
null ids come last; a lone row is its own next.  Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import id_ranges, partitions
from trackframe.llm.langid import scatter

K = 5
TUPLE = 2
SKETCHES = 32
RANGE_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
FACTORS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def kmers(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of the k-mers of code points ``c`` (one of them all if there are fewer than K)."""
    k, x, out = min(K, len(c)), scatter(c), None
    for i in range(k):
        part = x[i:len(x) - k + 1 + i]
        out = part if out is None else out * np.uint64(BASE) + part
    return scatter(out)


def occurrence(h: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each (of hashes that agree in the bits above those that number the places)."""
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    group = both >> bits
    begin = np.r_[True, group[1:] != group[:-1]]
    at = np.arange(len(h))
    out = np.empty(len(h), np.uint64)
    out[(both & low).astype(np.int64)] = at - np.maximum.accumulate(np.where(begin, at, 0))
    return out


def fingerprint(text: str) -> np.ndarray:
    """The SKETCHES parts (uint32) of a text's fingerprint."""
    if not text:
        return np.zeros(SKETCHES, np.uint32)
    h = kmers(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
    x = (scatter(h + occurrence(h) * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32)
    step, picked = max(1, (1 << 22) // len(x)), []
    for s in range(0, SKETCHES, step):
        order = x[None, :] * FACTORS[s:s + step, None]
        row, places = np.arange(len(order)), []
        for _ in range(TUPLE):
            places.append(order.argmin(axis=1))
            order[row, places[-1]] = np.uint32(0xFFFFFFFF)
        picked.append(np.sort(np.stack(places, axis=1), axis=1))
    at, out = np.concatenate(picked), np.zeros(SKETCHES, np.uint64)
    for i in range(TUPLE):
        out = scatter(out * np.uint64(BASE) + h[at[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32)


def shown(parts: np.ndarray) -> str:
    return parts.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    n = len(text)
    return text[:n - n // 2] + following[:n // 2]


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text in sorted runs by range; ``tail`` rows repeat the first of the next range behind the last."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4 * partitions(spark), -(-size // RANGE_BYTES))
    rows = id_ranges(rows, "id", n, "range").withColumn("h", F.xxhash64("text"))
    first = rows.groupBy("range").agg(F.min(F.struct("id", "h")).alias("first")).orderBy("range").collect()  # at most n + 1
    found = [(r["range"], r["first"]["id"], r["first"]["h"], first[i - 1]["range"]) for i, r in enumerate(first)]
    kind = rows.schema["id"].dataType.simpleString()
    table = spark.createDataFrame(found, f"range int, id0 {kind}, h0 long, before int")
    copies = rows.join(F.broadcast(table), "range").filter(F.col("id").eqNullSafe(F.col("id0")) & (F.col("h") == F.col("h0")))
    copies = copies.select("id", "text", F.col("before").alias("range"), "h", F.lit(1).alias("tail"))
    both = rows.withColumn("tail", F.lit(0)).unionByName(copies)
    return both.repartition(n, "range").sortWithinPartitions("range", "tail", "id", "h")


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for i, text, where, tail in zip(batch["id"], batch["text"], batch["range"].to_pylist(), batch["tail"].to_pylist()):
                if held is None and tail:
                    continue
                text = text.as_py()
                parts = fingerprint(text)
                if held is not None:
                    own, before, sketch = held
                    new = edited(before, text)
                    other = fingerprint(new)
                    out.append((own, len(before), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), shown(sketch), shown(other),
                                likeness(sketch, other), likeness(sketch, parts)))
                held = None if tail else (i.as_py(), text, parts)
            cols = list(zip(*out)) or [[]] * 7
            kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    return compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
