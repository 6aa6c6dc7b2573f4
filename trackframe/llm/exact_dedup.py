"""Exact dedup: static binary-fuse filters per immutable snapshot, exact buckets and byte checks.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` is one space; null counts as empty.  Rows come
in batches.  Within a batch, copies are grouped by digest.  The groups of earlier batches are immutable snapshots,
dealt into buckets, each with a binary fuse filter over its digests.  A later batch's groups are screened by the
filters: what no filter knows is new and joins nothing, and what passes is joined with the exact buckets.  Last, every
digest that more than one row bears is checked by bytes: texts that share a digest but not their bytes are told apart.

Defined cases: an empty table gives an empty result; a null id never wins against a known one, and a group of null ids
keeps one of them; of repeated rows (one id, one text) exactly one is kept; ``group_size`` counts rows.  Only the id and
the text are read, so further columns may have any name.  No group is gathered: copies meet as partial counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from trackframe.llm import fuse_filter
from trackframe.llm.common import BROADCAST_BYTES, partitions, small, without, written

SPACE = r"[\x20\x09-\x0D]+"
BUCKET_KEYS = 200_000
FILTER = "bucket int, seed int, length int, segments int, table binary"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def build_filters(groups: DataFrame) -> DataFrame:
    """One row per bucket of ``groups`` (bucket int, h long): the filter over the bucket's keys."""
    def one(keys: pa.Table) -> pa.Table:
        h = keys["h"].to_numpy().view(np.uint64)
        seed, length, segments, table = fuse_filter.build(h)
        row = {"bucket": [keys["bucket"][0].as_py()], "seed": [seed], "length": [length], "segments": [segments], "table": [table.tobytes()]}
        return pa.table(row, pa.schema([("bucket", pa.int32()), ("seed", pa.int32()), ("length", pa.int32()), ("segments", pa.int32()), ("table", pa.binary())]))
    return groups.select("bucket", "h").groupBy("bucket").applyInArrow(one, FILTER)


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """``groups`` with ``known``: whether the bucket's filter passes the key (no bucket, no filter: false)."""
    schema = StructType([*groups.schema.fields, StructField("known", BooleanType())])

    def one(rows: pa.Table, fit: pa.Table) -> pa.Table:
        h = rows["h"].to_numpy().view(np.uint64)
        if fit.num_rows and len(h):
            f = fit.to_pylist()[0]
            hit = fuse_filter.contains(h, f["seed"], f["length"], f["segments"], np.frombuffer(f["table"], np.uint16))
        else:
            hit = np.zeros(len(h), bool)
        return rows.append_column("known", pa.array(hit))
    return groups.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(one, schema)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], variants: DataFrame | None) -> DataFrame:
    """id, text's digest, its 64-bit key and variant (0 unless byte checks found several texts under the digest)."""
    out = df.select(F.col(f"`{id_col}`").alias("id"), normal(F.col(f"`{text_col}`")).alias("norm"))
    out = out.withColumn("digest", digest(F.col("norm")))
    if variants is None:
        return out.withColumn("variant", F.lit(0))
    found = out.join(variants, ["digest", "norm"], "left")
    return found.withColumn("variant", F.coalesce("variant", F.lit(0)))


def _groups(rows: DataFrame, batches: int, buckets: int) -> DataFrame:
    """One row per text: its keeper (smallest known id, then first row) and its number of rows, batch by batch."""
    keeper = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("keeper")
    known = None
    for b in range(batches):
        got = rows.filter(F.col("batch") == b).groupBy("digest", "variant").agg(keeper, F.count("*").alias("n"))
        got = got.withColumn("h", F.xxhash64("digest", "variant"))
        got = written(got.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")), f"batch{b}")
        if known is None:
            known = got
            continue
        tried = written(screen(got, written(build_filters(known), f"filters{b}")), f"screened{b}")
        old = known.select("bucket", "digest", "variant", F.col("keeper").alias("keeper0"), F.col("n").alias("n0"), F.col("h").alias("h0"))
        both = old.join(tried.filter("known").drop("known"), ["bucket", "digest", "variant"], "full")
        merged = both.select("digest", "variant", F.least("keeper", "keeper0").alias("keeper"),
                             (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), F.coalesce("h", "h0").alias("h"), "bucket")
        fresh = tried.filter(~F.col("known")).select(*merged.columns)
        known = written(merged.unionByName(fresh), f"snapshot{b}")
    return known


def _collisions(texts: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Byte check: (digest, norm, variant) of texts that share a digest with other bytes, or None.

    Rows whose digest stands alone need no check: they are screened out by a fuse filter over the others, while that
    filter is small enough to broadcast; beyond that size all texts are grouped.
    """
    shared = groups.filter("n > 1 or variant > 0").select("digest").distinct()
    n = shared.count()
    if n == 0:
        return None
    if n * 3 <= BROADCAST_BYTES and n * 8 <= BROADCAST_BYTES:
        keys = np.array([r[0] for r in shared.select(F.xxhash64("digest")).toLocalIterator()], np.int64)
        fit = texts.sparkSession.sparkContext.broadcast(fuse_filter.build(keys.view(np.uint64)))

        @F.pandas_udf("boolean")
        def passes(h):
            import pandas as pd
            return pd.Series(fuse_filter.contains(h.to_numpy(np.int64).view(np.uint64), *fit.value))
        texts = texts.filter(passes(F.xxhash64("digest")))
    seen = texts.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    several = written(seen.groupBy("digest").agg(F.count("*").alias("texts"), F.collect_set(F.xxhash64("norm")).alias("keys")).filter("texts > 1"), "collided")
    if several.isEmpty():
        return None
    order = F.array_position(F.array_sort("keys"), F.xxhash64("norm")).cast("int").alias("variant")
    return written(seen.join(several, "digest").select("digest", "norm", order), "variants")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2,
          digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, digest.  ``batches``: snapshots, split by id hash."""
    spark = df.sparkSession
    variants = None
    while True:
        texts = _rows(df, id_col, text_col, digest, variants)
        rows = texts.select("id", "digest", "variant", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"),
                            F.monotonically_increasing_id().alias("rid"))
        rows = written(rows, "digests")
        buckets = max(partitions(spark), rows.count() // BUCKET_KEYS + 1)
        groups = _groups(rows, batches, buckets)
        if variants is not None:
            break
        variants = _collisions(texts, groups)
        if variants is None:
            break
    stay = groups.select("digest", "variant", F.col("keeper.id").alias("keep_id"), F.col("keeper.rid").alias("keep_rid"), F.col("n").alias("group_size"))
    out = rows.join(stay, ["digest", "variant"], "left")
    return out.select("id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "digest")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    out = written(dedup(docs, id_col, text_col), "decisions")
    return without(docs, id_col, sha256(normal(F.col(f"`{text_col}`"))), out.select("id", F.col("digest").alias("key"), "kept"))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
