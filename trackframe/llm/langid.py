"""Language ID: an interpolated Kneser-Ney character model per language, kept in sorted hash arrays.

Text is lower-cased; letters are symbols and every run of other characters is one space.  The model of a language has
5-grams: order 5 holds discounted counts, lower orders discounted numbers of distinct left neighbours, and each context
gives the mass that its discounts free to the next lower order, down to the uniform distribution.  N-grams are 64-bit
hashes in sorted arrays, found by binary search.  The language with the lowest cross-entropy per symbol wins.

Fitting reads a bounded sample of the labelled texts, cut into pieces of ``PIECE`` characters: pieces whose hash falls
below a share that brings each language to ``SAMPLE_CHARS`` / languages characters, and of every language its piece of
least hash, so each label is learned and the model (broadcast) is bounded by these and a piece a language.  Rejection is
calibrated on other pieces (``CALIBRATE_CHARS``): a text's excess over its language's mean cross-entropy, in units of the deviation
expected at its length (``LEAST_SPREAD`` between texts at least), must not pass ``SLACK`` times what 99.9 percent of
these rows show, and ``LEAST_LIMIT`` at least.

Defined cases: an empty table gives an empty result; null text or one without a letter is ``und`` with score 0 and is
rejected; without any labelled row every text is ``und``; only id, text and label are read, whatever the other columns'
names; repeated rows get equal results.  Ties go to the first language in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import small, without, written

ORDER = 5
SAMPLE_CHARS = 2_000_000
CALIBRATE_CHARS = 1_000_000
PIECE = 4_000
CHUNK = 1 << 20
SLACK = 2.0
LEAST_SPREAD = 0.15  # nats: texts that mix languages or repeat a word differ by as much and are no reason to reject
LEAST_LIMIT = 10.0
P = np.uint64(0x9E3779B97F4A7C15)
LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not LETTER:
        LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return LETTER[0]


def symbols(text: str | None) -> np.ndarray:
    """Code points of letters, one space for each run between them, a space at either end; empty without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(letters()[c], c, np.uint32(32))
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]] if len(c) else c
    c = c[int(c[0] == 32):] if len(c) else c
    if not len(c):
        return c
    return c if c[-1] == 32 else np.append(c, np.uint32(32))


def scatter(c: np.ndarray) -> np.ndarray:
    x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def grams(c: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of each order that end at each symbol (the first ORDER symbols lack some)."""
    x, out, power = scatter(c), [], np.uint64(1)
    for k in range(ORDER):
        shifted = np.zeros_like(x)
        shifted[k:] = x[:len(x) - k]
        out.append((out[-1] if out else np.uint64(0)) + shifted * power)
        power = np.uint64(int(power) * int(P) & 0xFFFFFFFFFFFFFFFF)
    return out


def flat(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols, each text behind ORDER spaces; the place of each scored symbol; symbols per text."""
    each = [symbols(t) for t in texts]
    n = np.array([len(c) for c in each])
    pad = np.full(ORDER, 32, np.uint32)
    c = np.concatenate([x for e in each for x in (pad, e)]) if len(each) else pad
    begin = np.cumsum(n + ORDER) - n
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return c, at, n


@dataclass
class Model:
    """Per language and order: sorted n-gram hashes with discounted shares, sorted context hashes with freed mass."""

    langs: list[str]
    gram: list[list[tuple[np.ndarray, np.ndarray]]]
    context: list[list[tuple[np.ndarray, np.ndarray]]]
    floor: float
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    limit: float

    def logs(self, h: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """[n, languages] natural logs of the last symbol's probability; h, before: hashes by order, ending at and before it."""
        out = np.empty((len(h[0]), len(self.langs)), np.float32)
        for j in range(len(self.langs)):
            p = np.full(len(h[0]), self.floor)
            for k in range(ORDER):
                p = found(*self.gram[j][k], h[k], 0.0) + p * found(*self.context[j][k], before[k - 1] if k else np.zeros_like(h[0]), 1.0)
            out[:, j] = np.log(p)
        return out

    def score(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy [texts, languages], its per-symbol variance, and the number of symbols."""
        c, at, n = flat(texts)
        h = grams(c)
        code, _ = pd.factorize(h[ORDER - 1][at])
        first = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
        first[code[::-1]] = at[::-1]
        log = self.logs([x[first] for x in h], [x[first - 1] for x in h])[code].astype(np.float64)
        some = n > 0
        begin = (np.cumsum(n) - n)[some]
        total, square = np.zeros((2, len(n), len(self.langs)))
        if len(begin):
            total[some] = np.add.reduceat(log, begin, axis=0)
            square[some] = np.add.reduceat(log * log, begin, axis=0)
        m = np.maximum(n, 1)[:, None]
        return -total / m, square / m - (total / m) ** 2, n


def found(keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), missing)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], missing)


def chunks(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """(first row, texts) parts of about CHUNK characters."""
    held, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= CHUNK:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, k, gram, suffix, context, n) over ``rows`` (lang, text): counted in tasks, then summed by n-gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"lang": batch["lang"].to_pandas(), "i": range(batch.num_rows)})
            for lang, part in frame.groupby("lang"):
                for _, texts in chunks(batch["text"].take(pa.array(part["i"]))):
                    c, at, _ = flat(texts)
                    h = grams(c)
                    for k in range(ORDER):
                        key, first, n = np.unique(h[k][at], return_index=True, return_counts=True)
                        suffix = h[k - 1][at[first]] if k else np.zeros_like(key)
                        context = h[k - 1][at[first] - 1] if k else np.zeros_like(key)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), k, np.int32)),
                                                          *(pa.array(x.view(np.int64)) for x in (key, suffix, context)), pa.array(n.astype(np.int64))],
                                                         ["lang", "k", "gram", "suffix", "context", "n"])
    got = rows.select("lang", "text").mapInArrow(run, "lang string, k int, gram long, suffix long, context long, n long")
    return got.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"), F.first("suffix").alias("suffix"), F.first("context").alias("context"))


def numbers(n: Column) -> Column:
    """The numbers of the pieces of a text of ``n`` characters."""
    return F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(n - 1, F.lit(0)) / PIECE))


def languages(labelled: DataFrame) -> DataFrame:
    """(lang, size, least): characters and the least hash of a piece of each language of ``labelled`` (lang, text, h)."""
    sized = labelled.select("lang", "h", F.length("text").alias("n"))
    own = sized.withColumn("low", F.array_min(F.transform(numbers(F.col("n")), lambda i: F.xxhash64("h", i))))
    return written(own.groupBy("lang").agg(F.sum("n").alias("size"), F.min("low").alias("least")), "languages")


def sampled(labelled: DataFrame, langs: DataFrame, fitting: bool, chars: int, seed: int) -> DataFrame:
    """(lang, text) pieces of ``labelled`` by hash, about ``chars`` / languages characters of each language; a quarter of
    the pieces is for calibrating, all others and each language's piece of least hash (always drawn) are for fitting."""
    each = chars / max(1, langs.count()) / (0.75 if fitting else 0.25)
    share = F.least(F.lit(1.0), F.lit(each) / F.greatest(F.col("size"), F.lit(1)))

    def drawn(i: Column) -> Column:
        h = F.xxhash64("h", i)
        some = F.pmod(F.xxhash64("h", i, F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000
        return (h == F.col("least")) | (F.pmod(h, F.lit(4)) > 0) & some if fitting else (h != F.col("least")) & (F.pmod(h, F.lit(4)) == 0) & some
    rows = labelled.select("lang", "text", "h").join(small(langs, 80), "lang")
    part = rows.select("lang", "text", F.explode(F.filter(numbers(F.length("text")), drawn)).alias("i"))
    return part.select("lang", F.col("text").substr((F.col("i") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("text"))


def fit(labelled: DataFrame) -> Model | None:
    """A model from ``labelled`` (lang, text, h: a hash that deals pieces to the fitting or the calibrating part)."""
    langs_t = languages(labelled)
    counts = written(count_grams(sampled(labelled, langs_t, True, SAMPLE_CHARS, 1)), "grams")
    left = counts.filter("k > 0").groupBy("lang", (F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(F.count("*").alias("left"))
    table = counts.join(left, ["lang", "k", "gram"], "left")
    used = F.when(F.col("k") == ORDER - 1, F.col("n")).otherwise(F.coalesce("left", F.lit(1)))
    got = table.select("lang", "k", "gram", "context", used.alias("c")).toPandas()
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    floor = 1.0 / (got.loc[got["k"] == 0, "gram"].nunique() + 1)
    gram, context = [], []
    for lang in langs:
        gram.append([])
        context.append([])
        for k in range(ORDER):
            t = got[(got["lang"] == lang) & (got["k"] == k)]
            c, key, ctx = t["c"].to_numpy(float), t["gram"].to_numpy().view(np.uint64), t["context"].to_numpy().view(np.uint64)
            one, two = (c == 1).sum(), (c == 2).sum()
            less = one / (one + 2 * two) if one and two else 0.5
            ctx_key, place, types = np.unique(ctx, return_inverse=True, return_counts=True)
            total = np.bincount(place, c)
            order = np.argsort(key)
            gram[-1].append((key[order], (np.maximum(c - less, 0) / total[place])[order]))
            context[-1].append((ctx_key, np.bincount(place, np.minimum(c, less)) / total))
    n = len(langs)
    model = Model(langs, gram, context, floor, np.zeros(n), np.ones(n), np.ones(n), math.inf)
    own = sampled(labelled, langs_t, False, CALIBRATE_CHARS, 2)
    rated = _rated(own.select("lang", "text"), model, ["lang"]).filter("n > 0").toPandas()
    worst = [1.0]
    for j, lang in enumerate(langs):
        t = rated[(rated["lang"] == lang) & (rated["lang_pred"] == lang)]
        if len(t) < 20:
            continue
        model.mean[j] = np.average(t["entropy"], weights=t["n"])
        model.noise[j] = np.average(t["variance"], weights=t["n"])
        model.spread[j] = max(LEAST_SPREAD ** 2, ((t["entropy"] - model.mean[j]) ** 2 - model.noise[j] / t["n"]).mean())
        worst.append(np.quantile((t["entropy"] - model.mean[j]) / np.sqrt(model.spread[j] + model.noise[j] / t["n"]), 0.999))
    model.limit = max(LEAST_LIMIT, SLACK * max(worst)) if len(worst) > 1 else math.inf
    return model


def _rated(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` with lang_pred, score, entropy, variance, n and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for begin, texts in chunks(batch["text"]):
                entropy, variance, n = m.score(texts)
                best = entropy.argmin(axis=1)
                row = np.arange(len(n))
                weight = np.exp(-(entropy - entropy[row, best][:, None]) * np.minimum(n, 50)[:, None])
                excess = (entropy[row, best] - m.mean[best]) / np.sqrt(m.spread[best] + m.noise[best] / np.maximum(n, 1))
                names = np.where(n > 0, np.array(m.langs, object)[best], "und")
                cols = [batch[k].slice(begin, len(texts)) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(np.where(n > 0, 1 / weight.sum(axis=1), 0.0)),
                                                  pa.array(entropy[row, best]), pa.array(variance[row, best]), pa.array(n.astype(np.int64)), pa.array((n == 0) | (excess > m.limit))],
                                                 [*keep, "lang_pred", "score", "entropy", "variance", "n", "rejected"])
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, "text").mapInArrow(run, f"{head}, lang_pred string, score double, entropy double, variance double, n long, rejected boolean")


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (hash of the text), lang_pred, score, entropy, rejected per row."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    if model is None:
        return rows.select("id", "key", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    return _rated(rows, model, ["id", "key"]).drop("variance", "n")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model from the labelled rows of ``df`` that are not held out."""
    ok = F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`"))
    return fit(df.filter(ok).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h")))


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    out = predict(docs, learned(docs))
    return without(docs, "doc_id", F.xxhash64(F.col("text")), written(out.select("id", "key", (~F.col("rejected")).alias("kept")), "decisions"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learned(docs))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
