"""LM scoring: a gated recurrent language model with a class-factored softmax, and a unigram baseline.

Tokens: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+``, then one end.  Counts of every token of all learning rows are
summed on Spark.  The ``HEAD`` most frequent tokens form equal classes; all others are one more class, within which a
token has its smoothed share of the counts.  The network (see ``gru``) gives P(class | text so far) and P(word | class,
text so far) and is fitted on all learning rows by ``ROUNDS`` data-parallel rounds: a round takes its share of the rows (all
of them while they have less than ``TRAIN_TOKENS`` tokens), deals them to shards of about ``SHARD_TOKENS``, runs truncated
backpropagation over each, and averages the weights in a tree.  Together the rounds take every learning row at least once.

Scoring deals the documents into blocks of about ``BLOCK_BYTES`` by the hash of their id and text.  Each block's
distinct words are joined with the counts, so the counts, which grow with the corpus, are never broadcast; then each
block's documents run in step, whole texts from a zero state.

Defined cases: an empty table gives an empty result; null text is empty (its only token is the end); without learning
rows N = V = 0 and both scores are the base's; repeated rows get equal results; a null id counts as a learning row;
only the id and the text are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm import gru
from trackframe.llm.common import partitions, written

CLASSES = 32
PER_CLASS = 32
HEAD = CLASSES * PER_CLASS
HIDDEN = 16
TRAIN_TOKENS = 800_000  # of a round, at least
SHARD_TOKENS = 800_000
SHARDS = 8
STREAMS = 128
ROUNDS = 3
TURNS = 333_333 * ROUNDS
TREE = 16
BLOCK_BYTES = 24 << 20
PIECE_BYTES = 4 << 20  # of text split at a time
END = b""
ADD = 0.1


def tokens(text: str | None) -> list[bytes]:
    """The tokens of one text; ``split`` cuts many at once."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and the words of all in order: what ``tokens`` gives, without the ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at the six characters of the pattern; may give empty words
    size, words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64), lists.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[full.to_numpy(zero_copy_only=False)], minlength=len(size))
        words = words.filter(full)
    return size, words


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """Runs of texts of about ``PIECE_BYTES`` (a longer text is one of its own)."""
    for texts in getattr(column, "chunks", [column]):
        run = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // PIECE_BYTES
        at = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        yield from (texts.slice(i, j - i) for i, j in zip(at, at[1:]) if j > i)


def with_ends(size: np.ndarray, codes: np.ndarray, end: int) -> np.ndarray:
    """The words' ``codes`` with ``end`` after each text of ``size`` words."""
    out = np.full(len(codes) + len(size), end, codes.dtype)
    word = np.ones(len(out), bool)
    word[np.cumsum(size + 1) - 1] = False
    out[word] = codes
    return out


def head_codes(words: pa.Array, head: dict[bytes, int]) -> pa.Array:
    """Each word's number in ``head`` (words in the order of their numbers), null for others."""
    return pc.index_in(words, value_set=pa.array(list(head), pa.binary()))


def count_tokens(rows: DataFrame) -> DataFrame:
    """(word, c) over ``rows`` (text): counted in each batch, then summed by word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.chunked_array([split(t)[1] for t in pieces(batch["text"])], pa.binary()).value_counts()
            words, c = found.field("values"), found.field("counts")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([c, pa.array([len(batch)])])], ["word", "c"])
    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def averaged(table: pa.Table) -> pa.Table:
    """The token-weighted mean of weights (shard, w, n) in one row."""
    table = table.sort_by("shard")
    n = table["n"].to_numpy()
    total: dict = {}
    for raw, k in zip(table["w"], n):
        for name, x in pickle.loads(raw.as_py()).items():
            total[name] = total.get(name, 0.0) + x.astype(float) * (k / n.sum())
    mean = pickle.dumps({k: x.astype(np.float32) for k, x in total.items()})
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "w": pa.array([mean], pa.binary()), "n": pa.array([int(n.sum())])})


def fit(rows: DataFrame, head: dict[bytes, int], counts: np.ndarray, n: int) -> tuple[dict, list[int]]:
    """Weights from the learning ``rows`` (h, text), and the tokens of each round; counts: of the head words in order."""
    sc = rows.sparkSession.sparkContext
    share = max(TURNS // ROUNDS, min(TURNS, TURNS * TRAIN_TOKENS // max(1, n)))
    shards = max(SHARDS, -(-n * share // (TURNS * SHARD_TOKENS)))
    known, head_end = sc.broadcast(head), head.get(END, HEAD)
    part = F.pmod(F.xxhash64("h", F.lit(5)), F.lit(shards)).cast("int").alias("shard")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for texts in pieces(batch["text"]):
                size, words = split(texts)
                codes = pc.fill_null(head_codes(words, known.value), HEAD).to_numpy().astype(np.uint16)
                at = np.append(0, 2 * np.cumsum(size + 1)).astype(np.int32)
                ids.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(with_ends(size, codes, head_end))]))
            yield pa.RecordBatch.from_arrays([batch["shard"], batch["h"], pa.concat_arrays(ids) if ids else pa.array([], pa.binary())], ["shard", "h", "ids"])
    mass = np.zeros(HEAD)
    mass[:len(counts)] = counts
    w = gru.fresh(mass.reshape(CLASSES, PER_CLASS), max(0.0, n - counts.sum()), HIDDEN)
    schema, seen = "shard int, w binary, n long", []
    for k in range(ROUNDS):
        now = sc.broadcast(w)

        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by("h")
            stream = np.frombuffer(b"".join(table["ids"].to_pylist()), np.uint16).astype(np.int64)
            new, _ = gru.train(now.value, stream, head_end, max(32, min(STREAMS, len(stream) // 3125)))
            return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "w": pa.array([pickle.dumps(new)], pa.binary()), "n": pa.array([len(stream)])})
        turn = F.pmod(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(TURNS)) + F.lit(TURNS - k * TURNS // ROUNDS), F.lit(TURNS))
        picked = rows.filter(turn < share).select(part, "h", "text")
        new, left = picked.mapInArrow(number, "shard int, h long, ids binary").groupBy("shard").applyInArrow(one, schema), shards
        while left > TREE:
            new, left = new.withColumn("shard", F.floor(F.col("shard") / TREE).cast("int")).groupBy("shard").applyInArrow(averaged, schema), -(-left // TREE)
        got = new.toArrow()
        seen.append(sum(got["n"].to_pylist()))
        if got.num_rows:
            w = pickle.loads(averaged(got)["w"][0].as_py())
    return w, seen


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score per row; ``learn``: which rows of ``df`` to learn from."""
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), learn.alias("learn"))
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    learning = rows.filter("learn")
    counts = written(count_tokens(learning), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head = {bytes(r["word"]): i for i, r in enumerate(top)}
    often = np.array([r["c"] for r in top], np.int64)
    weights = fit(learning, head, often, n)[0] if n else None
    n_rare, v_rare = n - int(often.sum()), v - len(top)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * partitions(spark), -(-size // BLOCK_BYTES))
    dealt = rows.select("id", "text", F.pmod("h", F.lit(blocks)).cast("int").alias("block"))
    model = sc.broadcast((weights, head, often))

    def words(table: pa.Table) -> pa.Table:
        found = [pa.array([END], pa.binary())]
        for texts in pieces(table["text"]):
            each = split(texts)[1]
            found.append(each.filter(pc.is_null(head_codes(each, model.value[1]))).unique())
        out = pa.chunked_array(found).unique()
        out = out.filter(pc.is_null(head_codes(out, model.value[1])))  # the end, if it is a head word
        return pa.table({"block": pa.array([table["block"][0].as_py()] * len(out), pa.int32()), "word": out})

    def block(docs: pa.Table, vocab: pa.Table) -> pa.Table:
        w, head, often = model.value
        c = np.concatenate([often, vocab["c"].to_numpy().astype(np.int64), [0]])  # the last: not in the counts
        base = np.log10((c + ADD) / (n + ADD * (v + 1)))
        rare = np.log10((c + ADD) / (n_rare + ADD * (v_rare + 1)))
        rare[:len(head)] = 0.0
        size, codes, others = [], [], [pa.array([END], pa.binary())]
        for texts in pieces(docs["text"]):
            count, words = split(texts)
            near = head_codes(words, head)
            size.append(count)
            codes.append(pc.fill_null(near, -1).to_numpy().astype(np.int64))
            others.append(words.filter(pc.is_null(near)))
        far = pc.index_in(pa.chunked_array(others), value_set=vocab["word"].combine_chunks().cast(pa.binary()))
        far = pc.fill_null(far, -1 - len(head)).to_numpy().astype(np.int64) + len(head)
        flat, size = np.concatenate(codes), np.concatenate(size)
        flat[flat < 0] = far[1:]
        flat, size = with_ends(size, flat, head.get(END, int(far[0]))), size + 1
        begin = np.cumsum(size) - size
        sums = lambda x: np.add.reduceat(x[flat], begin)
        base_score = sums(base)
        total = base_score
        if w is not None:
            ids = np.split(np.where((flat >= len(head)) | (flat < 0), HEAD, flat), begin[1:])
            total = gru.document_logs(w, ids, head.get(END, HEAD)) / np.log(10) + sums(rare)
        known = sums((c > 0).astype(np.int64))
        return pa.table({"id": docs["id"], "n_tokens": size, "n_known": known.astype(np.int64), "train_tokens": np.full(len(size), n, np.int64),
                         "base_score": base_score.astype(float), "score": total.astype(float)})
    # grouped with the columns that the blocks need below, so that both read one shuffle of the texts
    found = dealt.groupBy("block").applyInArrow(words, "block int, word binary")
    vocab = found.join(counts, "word").select("block", "word", "c")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(vocab.groupBy("block")).applyInArrow(block, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, ~held_out(F.col("doc_id")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
