"""Mixing sources to target weights by Pfair windows and earliest deadline first.

A source's rows, in the order of a hash of their ids, form blocks of ``block_rows``; one block goes into one slot.  For a
target share w, taken as the exact fraction of the given weights, the source's block k (from 0) is released at slot
floor(k / w) and due at ceil((k + 1) / w).  In each slot the released block with the earliest deadline runs.  The shares sum
to 1, so no deadline is missed and after any number t of slots each source has had w t blocks, give or take less than one,
however large t is.

The driver works the order out with one step a block (a number a block in memory); a block has ``BLOCK_ROWS`` rows, or,
once there would be more than ``BLOCKS`` of them, as many as that takes, so its work stays bounded.  The rows get their
places by a join, broadcast while the blocks are few.  When the slot of a source comes and it has no block left, a phase ends: the other
sources go on with their weights made up to 1 again, from fresh windows.  There are at most as many phases as sources.
All rows stay.

Defined cases: an empty table gives an empty result; a null source or one without a target weight belongs to the source
``other``, whose weight is its share of the rows; rows with one id are told apart by a hash of all columns, full copies
share their places in any order; a null id is an id like any other.  Added columns: ``mix_source``, ``phase``, ``slot``
and ``position`` (gapless from 0 over all rows); of further columns only those of these names are replaced by ``mix``,
none by ``placed`` and ``mixed``.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import ranked, row_hash, small

OTHER = "other"
PERIOD = 1000
BLOCK_ROWS = 16
BLOCKS = 1 << 20
ADDED = ["mix_source", "phase", "slot", "position"]


def parts(weights: dict[str, float], period: int) -> dict[str, int]:
    """Positive integers near to proportion to ``weights`` with the sum ``period``; ``mix`` goes by ``exact``."""
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:period - sum(out.values())]:
        out[s] += 1
    return out


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportions of ``weights``."""
    whole = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in whole.values()))
    out = {s: int(w * scale) for s, w in whole.items()}
    common = math.gcd(*out.values())
    return {s: x // common for s, x in out.items()}


def turns(a: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot without end, by earliest deadline among the released blocks; ties go to the name."""
    q = sum(a.values())
    waiting, ready = [(0, -(-q // w), s, 0) for s, w in a.items()], []
    heapq.heapify(waiting)
    for slot in itertools.count():
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k
        k += 1
        heapq.heappush(waiting, (k * q // a[s], -(-(k + 1) * q // a[s]), s, k))


def one_period(a: dict[str, int]) -> list[str]:
    """The source of each slot of a period."""
    return [s for s, _ in itertools.islice(turns(a), sum(a.values()))]


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The slots and the phases of each source's blocks in order."""
    slots, phases, at, phase = {s: array("q") for s in blocks}, {s: [] for s in blocks}, 0, 0
    whole = exact({s: weights[s] for s in blocks}) if blocks else {}
    while left := {s: n - len(slots[s]) for s, n in blocks.items() if n > len(slots[s])}:
        for s, k in turns({s: whole[s] for s in left}):
            if k == left[s]:
                break
            slots[s].append(at)
            at += 1
        for s, n in left.items():
            phases[s].append((phase, len(slots[s]) - (blocks[s] - n)))
        phase += 1
    return {s: (np.array(slots[s], np.int64), np.repeat(*np.array(phases[s], np.int64).reshape(-1, 2).T)) for s in blocks}


def place_table(order: dict[str, tuple[np.ndarray, np.ndarray]], rows: dict[str, int], block_rows: int) -> pa.Table:
    """(source, block, phase, slot, position of its first row) of every block.

    A short last block of a source moves everything behind it up: the rows before a slot are the slots before it times
    the block's rows, less what the short blocks among them lack.
    """
    short = sorted((int(order[s][0][-1]), -n % block_rows) for s, n in rows.items() if n % block_rows)
    at, lack = np.array([t for t, _ in short], np.int64), np.r_[0, np.cumsum([n for _, n in short], dtype=np.int64)]
    schema = pa.schema([("source", pa.string()), ("block", pa.int64()), ("phase", pa.int32()), ("slot", pa.int64()), ("begin", pa.int64())])
    tables = [pa.table([pa.array([s] * len(t), pa.string()), np.arange(len(t)), phase.astype(np.int32), t, t * block_rows - lack[np.searchsorted(at, t)]], schema=schema)
               for s, (t, phase) in order.items()]
    return pa.concat_tables([schema.empty_table(), *tables])


def places(df: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None) -> DataFrame:
    """Every row of ``df`` as one column ``row``, so that no names clash, with ``source``, ``phase``, ``slot``, ``position``."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("give positive weights")
    spark = df.sparkSession
    known = spark.createDataFrame(pa.table({"name": pa.array(list(weights), pa.string())}))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{source_col}`").alias("given"),
                       F.col(f"`{id_col}`").alias("id"), row_hash(df).alias("tie"))
    named = packed.join(small(known, 64), F.col("given") == F.col("name"), "left").select("row", "id", "tie", F.coalesce("name", F.lit(OTHER)).alias("source"))
    rows = {r["source"]: r["n"] for r in named.groupBy("source").agg(F.count("*").alias("n")).collect()}
    n = sum(rows.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-n // BLOCKS))
    full = dict(weights)
    if OTHER not in full:
        full[OTHER] = sum(weights.values()) * rows.get(OTHER, 0) / max(1, n - rows.get(OTHER, 0)) or 1.0
    order = schedule(full, {s: -(-n // block_rows) for s, n in rows.items()})
    place_t = spark.createDataFrame(place_table(order, rows, block_rows))
    out = ranked(named, "source", [F.col("id")], "rank", F.col("tie")).withColumn("block", F.floor(F.col("rank") / block_rows))
    out = out.join(small(place_t, 48), ["source", "block"])
    return out.select("row", "source", "phase", "slot", (F.col("begin") + F.col("rank") % block_rows).alias("position"))


def mix(df: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source",
        block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """``df`` with the place of every row in the mix, by positive target weights.

    ``block_rows``: ``BLOCK_ROWS``, or as many as keep the blocks to about ``BLOCKS`` unless given.  ``period`` is taken
    for old callers' sake; the order has no period.
    """
    out = places(df, weights, id_col, source_col, block_rows)
    added = [F.col(c).alias(name) for c, name in zip(("source", "phase", "slot", "position"), ADDED)]
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ADDED], *added)


def tempered(df: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str, float]:
    """Target weights: each source's rows to ``power``, so that small sources gain."""
    counts = df.filter(F.col(f"`{source_col}`").isNotNull()).groupBy(F.col(f"`{source_col}`").alias("s")).agg(F.count("*").alias("n"))
    return {r["s"]: r["n"] ** power for r in counts.orderBy(F.desc("n"), "s").collect()}


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with ``mix_`` in front as often as it takes for ``df`` to have no such column."""
    while name in df.columns:
        name = f"mix_{name}"
    return name


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` in the order of the mix, with each row's place as ``position`` (``mix_position`` where ``docs`` has such a
    column); rows in one set get the same places each time."""
    out = places(docs, tempered(docs)).repartitionByRange("position").sortWithinPartitions("position")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("position").alias(free_name(docs, "position")))


def mixed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, written out in the order of the mix.  A reader may deal the files anew, so whoever needs
    the order takes it from ``placed``."""
    return placed(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", row_hash(docs).alias("rest"))  # the order needs no more of a row
    return mix(rows, tempered(docs)).select("doc_id", "source", *ADDED)
