"""Token counts, whitening and the Merkle manifest against brute force, and their defined cases on small tables."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import rows_of

from trackframe.llm import common, merkle, mixing, qd_solver, token_counts, whitening

PATH = public_tokenizers.path(token_counts.MODEL)
PARTS = ["'re", "'s", " ", "  ", "\n\n", "\t", "<|endoftext|>", "<|endof", "text|>", "abc", "é", "日本語", "123", " 45", "!!", "...", "'", "r", "e",
         "don't", " x", "😀", " aaaaaaaaaaaa", "||>", "I'LL", " ", "　 "]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, null ids and clashing names."""
    common.ship(spark)
    rows = [(1, "the cat", "en", "a", 7), (1, "the cat", "en", "a", 7), (1, "The Cat", "en", "a", 7), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "x", "fr", "b", 1),
            (4, "wörd " * 30_000, "en", "b", 150_000), (5, "a" * 70_000 + " b", None, "b", 2), (6, "Z", "en", None, 1), (None, None, "fr", "é", None), (7, "q", "fr", "", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long, n int, pos int, steps int, leaf string, id string, n_tokens int"
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4) for r in rows], names)


# ------------------------------------------------------------ token counts
def test_spliced_counts_are_those_of_the_whole_text():
    tok, size, margin = token_counts.load(PATH)
    rng = random.Random(5)
    spliced = 0
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 500)))
        n, chunks, _ = token_counts.count_long(tok, size, margin, text, rng.choice([40, 64, 150]), rng.choice([1, 8, 20]))
        assert n == len(tok.encode(text, add_special_tokens=False)), text
        spliced += chunks - 1
    assert spliced > 10_000


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000 + "x", "<|endoftext|>" * 300, "日本" * 2000, "x" + "\n" * 999])
def test_overlaps_widen_where_chunks_never_agree(text):
    tok, size, margin = token_counts.load(PATH)
    n, _, widened = token_counts.count_long(tok, size, margin, text, 100, 8)
    assert n == len(tok.encode(text, add_special_tokens=False)) and widened > 0


def test_counts_of_every_row(spark, odd):
    tok, *_ = token_counts.load(PATH)
    for df, chunk in ((odd, token_counts.CHUNK), (odd, 300), (spark.read.parquet(f"{SF_SMALL}/documents.parquet"), 500)):
        got = sorted((str(r["id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.counted(df, chunk=chunk, overlap=64).collect())
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        assert got == sorted((str(i), len(t.encode()), len(tok.encode(t, add_special_tokens=False))) for i, t in texts)
    assert token_counts.counted(odd.limit(0)).count() == 0


def test_tokenizers_that_look_back_are_refused():
    with pytest.raises(ValueError):
        token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


# --------------------------------------------------------------- whitening
@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_qd_solver_is_the_singular_value_decomposition(d):
    rng = np.random.default_rng(d)
    for x in (rng.normal(size=(d, d)), rng.normal(size=(d, d)) * np.logspace(0, -9, d), rng.normal(size=(d, d)) * np.logspace(-9, 0, d), np.eye(d),
              np.zeros((d, d)), np.outer(rng.normal(size=d), rng.normal(size=d)), np.diag(np.r_[np.full((d + 1) // 2, 3.0), np.ones(d // 2)]) @ np.linalg.qr(rng.normal(size=(d, d)))[0]):
        want = np.linalg.svd(x, compute_uv=False) ** 2
        diagonal, above, v = qd_solver.bidiagonal(x)
        assert np.allclose(qd_solver.dqds(diagonal, above), want, atol=1e-13 * max(want[0], 1e-300))
        values, vectors = qd_solver.leading(x, min(4, d))
        assert np.allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-12)
        assert np.allclose(x.T @ (x @ vectors.T), vectors.T * values, atol=1e-12 * max(want[0], 1e-300))


def test_small_values_keep_their_relative_accuracy():
    diagonal, above = np.logspace(0, -12, 13), np.logspace(-1, -12, 12) * 0.3
    got = qd_solver.dqds(diagonal, above)  # their product is the squared determinant of B, which is that of its diagonal
    assert math.isclose(math.fsum(np.log(got)), 2 * math.fsum(np.log(diagonal)), rel_tol=1e-13)


def brute_whitening(vectors, k=4):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True).reshape(fit.shape[1], -1)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ v / np.sqrt(e), e / np.trace(cov)


def test_whitening_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    rows = rows[:60] + rows[:7] + rows[10:11] * 30  # repeated vectors count once in the fit list
    df = spark.createDataFrame([(i, r["embedding"], "x") for i, r in enumerate(rows)], "vec_id int, embedding array<float>, whitened string").repartition(5)
    n, deviation, whitened, explained = brute_whitening([r["embedding"] for r in rows])
    got = whitening.whiten(df).toPandas().sort_values(["id", "component"])
    assert len(got) == 4 * len(rows) and (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    for k in range(4):
        part = got[got["component"] == k + 1]
        w = part["whitened"].to_numpy()
        assert np.allclose(w * np.sign(w @ whitened[:, k]), whitened[:, k], atol=1e-8)
        assert np.allclose(part["explained"], explained[k], rtol=1e-9)
        assert part["deviation"].tolist() == deviation.tolist()


def test_triangles_reduce_in_a_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-100, 100, size=(2000, 5))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(70)
    r = whitening.reduced(fit, 5, x.mean(axis=0))
    assert np.allclose(r.T @ r, np.cov(x.T, bias=True) * len(x), rtol=1e-10)


def test_whitening_defined_cases(spark):
    schema = "vec_id long, embedding array<double>, component int, id string"
    make = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], schema)).collect()
    assert make([]) == [] and make([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf")]), (5, [])]) == []
    one = make([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert len(one) == 6 and all(r["whitened"] == 0 and r["explained"] == 0 and r["identity_error"] == 1 and r["n"] == 1 and r["deviation"] == 0 for r in one)
    flat = make([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(77, [1.0])])  # rank one; another length is left out
    assert {r["id"] for r in flat} == set(range(9)) and len(flat) == 27
    assert all((abs(r["whitened"]) > 0.1) == (r["component"] == 1 and r["id"] != 4) for r in flat)
    assert all(math.isclose(r["explained"], 1.0) for r in flat if r["component"] == 1)
    big = make([(1, [2.0 ** 20, 0.0]), (2, [-(2.0 ** 20), 1.0]), (3, [0.0, 9.0])])
    x = np.array([[2 ** 28, 0], [-(2 ** 28), 256], [0, 2304]], dtype=object)
    want = [sum(int(c) ** 2 for c in 3 * row - x.sum(axis=0)) for row in x]
    assert [next(r["deviation"] for r in big if r["id"] == i) for i in (1, 2, 3)] == want


def test_deviations_beyond_a_long_are_refused():
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[2 ** 40, 0]]), 10, [1, 0])
    x = np.array([[2 ** 30, -5], [3, 4]])
    assert whitening.deviations(x, 2, [2 ** 30 + 3, -1]).tolist() == [sum((2 * int(c) - s) ** 2 for c, s in zip(r, [2 ** 30 + 3, -1])) for r in x]


# ---------------------------------------------------------------- manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(part(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def brute_levels(nodes):
    """All levels of one tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute_steps(levels, at):
    steps = []
    for level in levels[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        steps.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        at //= 16
    return steps


def brute_manifest(rows):
    none_first = lambda v, key=lambda v: v: (v is not None, key(v) if v is not None else 0)
    low = bytes(range(65, 91))
    by = {}
    for r in rows:
        text = r["text"]
        lowered = None if text is None else text.encode().translate(bytes.maketrans(low, low.lower())).decode()
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        by.setdefault(r["source"], []).append((none_first(r["doc_id"]), brute_leaf(r, text), brute_leaf(r, lowered) if hit else None, r["doc_id"]))
    trees = {s: (sorted(v, key=lambda x: x[:2]), brute_levels([x[1] for x in sorted(v, key=lambda x: x[:2])])) for s, v in by.items()}
    order = sorted(trees, key=lambda s: none_first(s, str.encode))
    top = brute_levels([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, leaf, changed, i) in enumerate(trees[s][0]):
            steps = brute_steps(trees[s][1], at) + brute_steps(top, k)
            h = changed or leaf
            for left, right in steps:
                h = sha(left, h, right)
            out.append((i, leaf, trees[s][1][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=str)


def query_rows(spark, df, tmp_dir):
    df.write.parquet(f"{tmp_dir}/documents.parquet")
    got = merkle.query(spark, tmp_dir)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_of_odd_rows(spark, odd, tmp_dir):
    assert query_rows(spark, odd, tmp_dir) == brute_manifest(odd.collect())


def test_manifest_of_an_empty_table(spark, odd, tmp_dir):
    assert query_rows(spark, odd.limit(0), tmp_dir) == []


@pytest.mark.parametrize("sources", [1, 40])
def test_manifest_of_several_levels(spark, tmp_dir, sources):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % sources))
    df = spark.range(1700).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"), hot.alias("source"), F.lit(6).cast("long").alias("n_chars"))
    if sources == 1:
        df = df.withColumn("source", F.lit(None).cast("string"))
    got = query_rows(spark, df, tmp_dir)
    assert got == brute_manifest(df.collect())
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_is_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    assert rows_of(merkle.query(spark, SF_SMALL).toPandas()) == rows_of(con.execute(merkle.SQL).df())


# ------------------------------------------------------- mixing, added cases
def test_mix_keeps_columns_with_the_names_of_its_own(spark):
    rows = [(k, f"t{k % 5}", "s" if k % 3 else None, k, -k, 7, "r", 1.5, "f", {"a": k}) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, position int, _rank int, mix_source string, phase double, row string, m map<string,int>")
    out = mixing.placed(docs)
    assert out.columns == [*docs.columns, "mix_position"]
    assert sorted(r["mix_position"] for r in out.collect()) == list(range(50))
    assert sorted(tuple(map(str, r)) for r in mixing.mixed(docs).collect()) == sorted(tuple(map(str, r)) for r in docs.collect())
    got = mixing.mix(docs, {"s": 2.0})
    assert got.columns == [*[c for c in docs.columns if c not in mixing.ADDED], *mixing.ADDED] and got.filter("_rank = 7 and row = 'f'").count() == 50


def test_thousands_of_sources_keep_their_own_weights(spark):
    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 2000)).alias("source"))
    out = mixing.mix(docs, mixing.tempered(docs), block_rows=4).select("source", "mix_source", "position").collect()
    assert sorted(r["position"] for r in out) == list(range(7000)) and all(r["source"] == r["mix_source"] for r in out)


def test_blocks_grow_so_that_their_number_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 10)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    out = mixing.mix(docs, {"s0": 1.0, "s1": 1.0}).collect()
    assert len({r["slot"] for r in out}) == 10 and sorted(r["position"] for r in out) == list(range(1000))
