"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly; copies of a text stay together.

A group is all rows of one text.  A group over ``1 / HEAVY`` of a shard's share of bytes, tokens or rows is an item of
its own, and one over a whole share is split into items of at most a quarter of it, dealt by a hash of its row's id.
The other groups are dealt by the hash of their text into ``BUNDLES`` items per shard.  Largest items first, each goes
to the shard where the dot product of its vector with the residual capacity (all in shares of the total) is highest,
among the shards that have room in each dimension; an item that fits nowhere goes where the most bytes are left.  The items are bounded by the number of shards,
whatever the rows, so the driver packs them; rows meet only as sums by text and by bundle.

Law ``bytes``: the shards' sizes come out near equal (measured in the README).

Defined cases: an empty table gives an empty result; null texts are one group with no bytes and no tokens and have the
CRC of no bytes, 0; the size of a row is its UTF-8 bytes plus 1; repeated rows and null ids are rows like others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import ranked, small, written

HEAVY = 64
BUNDLES = 512
SPLIT = 4


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item.  items [n, d]: shares of the totals; every shard's capacity is 1 / ``shards`` in each."""
    left = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        room = (left >= items[i]).all(axis=1)
        out[i] = np.argmax(np.where(room, left @ items[i], -np.inf)) if room.any() else np.argmax(left[:, 0])
        left[out[i]] -= items[i]
    return out


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """One row per row of ``df``: id, size, tokens, text_crc32, shard, slot."""
    spark = df.sparkSession
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                     F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
                     F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = written(rows, "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    dims = ["bytes", "tokens", "rows"]
    total = rows.agg(*sums).first()
    whole = np.array([max(1, total[d] or 0) for d in dims], float)
    share = whole / shards
    groups = rows.groupBy("h").agg(*sums)
    over = F.greatest(*[F.col(d) / float(s) for d, s in zip(dims, share)])
    heavy = written(groups.withColumn("over", over).filter(F.col("over") > 1 / HEAVY), "heavy")  # at most 3 x shards x HEAVY rows
    pieces = F.when(F.col("over") > 1, F.ceil(F.col("over") * SPLIT)).otherwise(1).cast("int")
    heavy = heavy.select("h", pieces.alias("pieces"))
    bundles = shards * BUNDLES
    tagged = rows.join(F.broadcast(heavy), "h", "left")
    tagged = tagged.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("id"), "pieces")).otherwise(-1).cast("int"))
    tagged = tagged.withColumn("item", F.when(F.col("piece") < 0, F.pmod("h", F.lit(bundles))).otherwise(F.col("h")))
    items = tagged.groupBy("item", "piece").agg(*sums).orderBy("piece", "item").toPandas()
    items["shard"] = pack(items[dims].to_numpy(float) / whole, shards) if len(items) else []
    where = spark.createDataFrame([(int(i), int(p), int(s)) for i, p, s in zip(items["item"], items["piece"], items["shard"])], "item long, piece int, shard int")
    out = tagged.join(small(where, 16), ["item", "piece"]).select("id", "size", "tokens", "text_crc32", "shard")
    return ranked(out, "shard", [F.col("id"), F.col("text_crc32")], "slot")


def query(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
