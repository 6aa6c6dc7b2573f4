"""Merkle dataset manifest: trees of fan-out 16 by source and over the sources, built and proved by lag and lead windows.

A row's leaf is the SHA-256 of its columns; the leaves of a source stand in order of their ids.  At each level, lag and
lead columns of the fixed offsets 1 to 15, masked by a node's slot in its run and by the run's length, are the node's
siblings, and a run's first node hashes itself and the nodes that follow into the parent.  The subroots of the sources
form a tree of the same kind.  A proof is the list of siblings to the left and right at every level.

Places come from a range shuffle with counts: rows are dealt by ranges of (source, id, leaf) and written with their
range's number; within a range a row number counts, and the ranges' counts by source give each its first place.  Windows
are cut at runs, so a hot source is spread like all others, and equal rows may stand in any order, so a random last
sorting key splits them too.  Levels shrink sixteenfold; a level's siblings go down to the rows by joins on the run,
which reuse the windows' shuffle.
All of it is DataFrame code; only counts come to the driver.

Defined cases: an empty table gives an empty result; null ids come first within a source, null sources first of all;
rows with one id are ordered by their leaf, and repeated rows are leaves of their own with equal columns but places of
their own (so their proofs may differ).  Further columns are not read and may have any name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import partitions, small, written

FAN = 16
STEPS = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(cols: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its bytes' number, a colon and itself."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(part, cols)), 256)


def placed(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` (0-based, by ``order``) within ``tree`` and ``n``, the tree's number of nodes."""
    dealt = nodes.withColumn("_salt", F.rand(13)).repartitionByRange(partitions(nodes.sparkSession), tree, *order, "_salt")
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(tree, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(tree).orderBy("_range")
    first = counts.select(F.col(tree).alias("_tree"), F.col("_range").alias("_r"), (F.sum("_c").over(before) - F.col("_c")).alias("_first"),
                          F.sum("_c").over(Window.partitionBy(tree)).alias("n"))
    first = written(first, "first")
    rows = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(tree, "_range").orderBy(*order, "_salt")) - 1)
    out = rows.join(small(first, 64), F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("pos", F.col("_first") + F.col("_at")).drop("_tree", "_r", "_range", "_salt", "_first", "_at")


def runs(nodes: DataFrame, tree: str, digest: str) -> DataFrame:
    """``nodes`` with their run, the siblings to the ``left`` and ``right`` and, on a run's first node, the ``parent``."""
    slot = F.pmod("pos", F.lit(FAN))
    length = F.least(F.lit(FAN), F.col("n") - (F.col("pos") - slot))
    rows = nodes.withColumns({"run": F.floor(F.col("pos") / FAN), "_slot": slot, "_len": length})
    w = Window.partitionBy(tree, "run").orderBy("pos")
    ahead = {f"_a{k}": F.when(F.col("_slot") + k < F.col("_len"), F.lead(digest, k).over(w)) for k in range(1, FAN)}
    back = {f"_b{k}": F.when(F.col("_slot") >= k, F.lag(digest, k).over(w)) for k in range(1, FAN)}
    rows = rows.withColumns(ahead | back)
    rows = rows.withColumns({"left": F.concat_ws("", *[f"_b{k}" for k in range(FAN - 1, 0, -1)]), "right": F.concat_ws("", *[f"_a{k}" for k in range(1, FAN)])})
    parent = F.when(F.col("_slot") == 0, F.sha2(F.concat(F.col(digest), F.col("right")), 256))
    return rows.withColumn("parent", parent).drop("_slot", "_len", *ahead, *back)


def climb(nodes: DataFrame, tree: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above the nodes (tree, pos, n, digest), lowest first, and the one node left of each tree.

    A level's rows are the trees with several nodes below it; trees of one node are done and leave.
    """
    levels, done = [], []
    at = nodes.select(tree, "pos", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        done.append(at.filter("n <= 1").select(tree, "digest"))
        if most <= 1:
            break
        level = runs(at.filter("n > 1"), tree, "digest")
        up = level.filter("parent is not null").select(tree, F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.col("parent").alias("digest"))
        at, most = written(up, f"level{len(levels)}"), -(-most // FAN)
        levels.append(at)
    return levels, written(functools.reduce(DataFrame.unionByName, done), "roots")


def paths(levels: list[DataFrame], tree: str) -> DataFrame | None:
    """(tree, pos, steps) of the lowest level: the siblings [(left, right)] from there to the root."""
    above = None
    for level in reversed(levels):
        above = written(stepped(level.filter("n > 1"), tree, above, "digest").unionByName(
            level.filter("n <= 1").select(tree, "pos", "digest", F.array().cast(STEPS).alias("steps"))), "paths").select(tree, "pos", "steps")
    return above


def stepped(nodes: DataFrame, tree: str, above: DataFrame | None, digest: str) -> DataFrame:
    """``nodes`` of trees with several, with ``steps``: their own siblings, then those of their parents, ``above``."""
    kept = [c for c in nodes.columns if c != "n"]
    own = runs(nodes, tree, digest)
    step = F.array(F.struct("left", "right"))
    if above is None:
        return own.select(*kept, step.alias("steps"))
    up = above.select(F.col(tree).alias("_t"), F.col("pos").alias("_run"), F.col("steps").alias("_up"))
    on = (F.col(tree) == F.col("_t")) & (F.col("run") == F.col("_run"))
    return own.join(up, on).select(*kept, F.concat(step, "_up").alias("steps"))


def fold(start: Column, steps: Column) -> Column:
    """The root from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` has id, source, leaf and any further columns; they come back with subroot, root and ``steps``.

    ``steps`` are the siblings (left, right) by level, from the leaf's run through the sources' tree to the root.
    """
    keyed = rows.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))  # null: before all others, apart from them
    leaves = placed(keyed, "_src", ["id", "leaf"])
    leaves = written(leaves, "leaves")
    levels, subroots = climb(leaves.withColumn("digest", F.col("leaf")), "_src")
    above = paths(levels, "_src")
    single = leaves.filter("n <= 1")
    none = F.array().cast(STEPS)
    out = single.drop("n").withColumn("steps", none)
    if above is not None:
        out = stepped(leaves.filter("n > 1"), "_src", above, "leaf").select(*single.drop("n").columns, "steps").unionByName(out)
    # the sources' tree: one tree whose nodes are the subroots
    top = subroots.select(F.lit(0).alias("_one"), F.col("_src").alias("_s"), "digest")
    top = written(placed(top, "_one", ["_s"]), "sources")
    levels, root = climb(top, "_one")
    above = paths(levels, "_one")
    ends = top.withColumn("steps", none) if above is None else stepped(top, "_one", above, "digest")
    whole = F.lit(next((r["digest"] for r in root.collect()), None)).cast("string")  # the one root
    ends = written(ends.select("_s", F.col("digest").alias("subroot"), whole.alias("root"), F.col("steps").alias("_top")), "ends")
    out = out.join(small(ends, 4096), F.col("_src") == F.col("_s"))
    return out.withColumn("steps", F.concat("steps", "_top")).drop("_s", "_src", "_top", "pos")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = {c: F.col(f"`{c}`") for c in FIELDS}
    chosen = F.pmod(F.crc32(cols["doc_id"].cast("string").cast("binary")), F.lit(5)) == 0
    lowered = F.translate(cols["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(chosen, leaf_of([*[cols[c] for c in FIELDS[:-1]], lowered]))
    rows = docs.select(cols["doc_id"].alias("id"), cols["source"].alias("source"), leaf_of([cols[c] for c in FIELDS]).alias("leaf"), tampered.alias("changed"))
    out = manifest(rows)
    proof = F.sha2(F.concat_ws("", F.transform("steps", lambda s: F.concat(s["left"], s["right"]))), 256)
    out = out.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("steps")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree(name: str, tree: str, levels: int) -> list[str]:
    """CTEs of one kind of tree over ``{name}0`` (tree, pos, n, h): each level's nodes, then each level's paths, down."""
    def window(order: str) -> str:
        return f"coalesce(string_agg(h, '') OVER (PARTITION BY {tree}, pos // 16 ORDER BY pos ROWS BETWEEN {order}), '')"
    out = []
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT {tree}, pos // 16 AS pos, max((n + 15) // 16) AS n, "
                   f"CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h FROM {name}{k} GROUP BY ALL)")
    for k in range(levels - 1, -1, -1):
        own = (f"SELECT *, {window('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {window('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k}")
        up = "p.steps" if k + 1 < levels else "[]::STRUCT(l VARCHAR, r VARCHAR)[]"
        join = f" JOIN {name}_path{k + 1} p ON p.{tree} = o.{tree} AND p.pos = o.pos // 16" if k + 1 < levels else ""
        out.append(f"{name}_path{k} AS (SELECT o.{tree}, o.pos, o.h, CASE WHEN o.n > 1 THEN list_concat([{{'l': o.l, 'r': o.r}}], {up}) "
                   f"ELSE []::STRUCT(l VARCHAR, r VARCHAR)[] END AS steps FROM ({own}) o{join})")
    return out


def _sql(levels: int = 6, top: int = 3) -> str:
    """The manifest for up to 16 ** levels rows a source and 16 ** top sources."""
    def leaf(text: str) -> str:
        part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
        return "sha256(" + " || ".join(part.format(c) for c in (*FIELDS[:-1], text)) + ")"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform({bits}, lambda b: b::BIGINT)), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"d AS (SELECT doc_id, coalesce('=' || source, '-') AS src, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS changed FROM documents)",
             "s0 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n, leaf AS h FROM d)",
             *_tree("s", "src", levels),
             f"t0 AS (SELECT 0 AS one, src, row_number() OVER (ORDER BY encode(src)) - 1 AS pos, count(*) OVER () AS n, h FROM s{levels})",
             *_tree("t", "one", top),
             f"e AS (SELECT t0.src, t0.h AS subroot, (SELECT h FROM t{top}) AS root, p.steps FROM t0 JOIN t_path0 p USING (pos))",
             "a AS (SELECT s0.doc_id, s0.leaf, s0.changed, e.subroot, e.root, list_concat(p.steps, e.steps) AS steps "
             "FROM s0 JOIN s_path0 p ON p.src = s0.src AND p.pos = s0.pos JOIN e ON e.src = s0.src)",
             "f AS (SELECT *, list_reduce(list_concat([{'l': coalesce(changed, leaf), 'r': ''}], steps), "
             "lambda acc, x: {'l': sha256(x.l || acc.l || x.r), 'r': ''}).l AS folded_root FROM a)"]
    return "WITH " + ",\n".join(steps) + ("\nSELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x.l || x.r), ''), '')) AS proof_sha256, "
                                          "folded_root, folded_root = root AS verified FROM f")


SQL = _sql()
