"""Token counts by overlap resynchronisation: a huge document is encoded in overlapping chunks, spliced where both agree.

Texts of up to ``CHUNK`` code points are counted by units, cut where the pattern alone proves a boundary (``Counter``),
so that a stretch that many texts share is encoded once.  A longer one is cut into chunks that overlap, and each chunk is
encoded by itself with the byte offsets at which its words (the pre-tokenizer's pieces, within which alone merges
happen) start.  Two neighbours are spliced at an offset in their overlap at which both start a word.  That is enough:

* The word pattern of a byte-level tokenizer never looks back, so from a word's start on, words and tokens depend only
  on what follows; the right chunk sees all of that up to its own end, where the next seam takes over.
* Words that end before the offset are the left chunk's.  Its cut end can change only what looks past it, and the
  pattern looks past a word's end by less than ``MARGIN`` code points: three for a contraction, one after white space,
  the length of a special string.  Offsets nearer to the cut are not used.
* A special string has no words inside, so an offset within one is never a start in a chunk that sees it whole.

Where an overlap has no common start (a run of letters or of white space longer than it), the overlap doubles, and once
it would fill the chunk, the left chunk does, so the last resort is the whole text in one piece.  Memory is that of one
row and two chunks' encodings.  Counting is a single pass over the rows without a shuffle.

Defined cases: a null text counts as empty and has no tokens and one chunk; ids may be null or repeat, every row has its
own result; an empty table gives an empty result.  Only the id and the text are read, so further columns may have any
name.  Tokenizers other than byte-level ones without normaliser, prefix space and truncation raise ``ValueError``.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

MODEL = "byte_bpe_50k.json"
CHUNK = 1 << 16
OVERLAP = 1 << 10
MARGIN = 16
LIMIT = 512
BATCH_CHARS = 1 << 20
KEPT_CHARS = 1 << 24
GAP = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"\A | \Z| \s|\s ")


@functools.lru_cache(maxsize=4)
def load(path: str):
    """(tokenizer, bytes of each id's token, margin in code points) of a byte-level tokenizer file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    spec = json.loads(tok.to_str())
    cut = spec["pre_tokenizer"] or {}
    added = spec["added_tokens"]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["normalizer"] \
            or spec["truncation"] or spec["padding"] or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError(f"{path} is not a plain byte-level tokenizer, whose words look only forward")
    vocab = tok.get_vocab(with_added_tokens=True)
    size = np.zeros(max(vocab.values()) + 1, np.int64)
    special = {a["content"] for a in added}
    for token, i in vocab.items():  # a byte-level token has one character for each byte
        size[i] = len(token.encode()) if token in special else len(token)
    return tok, size, MARGIN + max((len(s) for s in special), default=0)


class Counter:
    """Token counts of texts as the sums over their units, the library being asked once for each distinct unit.

    Every alternative of the pattern keeps a space before a letter, digit or sign with what follows and takes in none
    after them, so a single space with no other white space beside it starts a word, whatever stands around.  Texts are
    cut there.  The counts of a worker's units are kept while their letters number ``KEPT_CHARS`` at most, then dropped.
    """

    def __init__(self, tok, size: np.ndarray):
        self.tok, self.size, self.first, self.after, self.chars = tok, size, {}, {}, 0

    def learn(self, known: dict[str, int], units: set[str], lead: str) -> None:
        """Units that follow such a space and end in no white space stand in one text, whose tokens' ends tell them apart;
        the others are encoded one by one."""
        fresh = list(units - known.keys())
        alone = [u for u in fresh if not lead or u[-1:].isspace()]
        for part in groups(alone):
            known.update(zip(part, map(len, self.tok.encode_batch([lead + u for u in part], add_special_tokens=False))))
        for part in groups([u for u in fresh if lead and not u[-1:].isspace()]):
            ends = np.cumsum([len(u.encode()) + len(lead) for u in part])
            tokens = np.cumsum(self.size[self.tok.encode(lead + lead.join(part), add_special_tokens=False).ids])
            known.update(zip(part, np.diff(np.searchsorted(tokens, ends, side="right"), prepend=0).tolist()))
        self.chars += sum(map(len, fresh))

    def count(self, texts: list[str]) -> list[int]:
        if self.chars > KEPT_CHARS:
            self.first, self.after, self.chars = {}, {}, 0
        cut = [(GAP.split(t) if ODD.search(t) else t.split(" ")) for t in texts]
        self.learn(self.first, {u[0] for u in cut}, "")
        self.learn(self.after, {x for u in cut for x in u[1:]}, " ")
        return [self.first[u[0]] + sum(map(self.after.__getitem__, u[1:])) for u in cut]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about ``BATCH_CHARS``."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def starts(tok, size: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Byte offset of each word's start, the number of tokens before it, and the number of all tokens of ``text``."""
    got = tok.encode(text, add_special_tokens=False)
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    ids, words = np.array(got.ids), np.array([-1 if w is None else w for w in got.word_ids])
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)])
    return np.r_[0, np.cumsum(size[ids])][first], first, len(ids)


def count_long(tok, size: np.ndarray, margin: int, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks spliced, times an overlap was widened) of a text of any length."""
    total, chunks, widened = 0, 1, 0
    at, length, reach = 0, min(chunk, len(text)), overlap
    left = starts(tok, size, text[:length])
    since, skipped = 0, 0  # where this chunk takes over: byte offset in it, and its tokens before that
    while at + length < len(text):
        if 2 * reach > length:  # the overlap would fill the chunk
            length = min(2 * length, len(text) - at)
            left, widened = starts(tok, size, text[at:at + length]), widened + 1
            continue
        cut = at + length - reach
        right = starts(tok, size, text[cut:cut + max(chunk, 2 * reach)])
        before = len(text[at:cut].encode())
        safe = len(text[at:at + length - margin].encode())
        common, i, j = np.intersect1d(left[0], right[0] + before, assume_unique=True, return_indices=True)
        good = np.flatnonzero((common > since) & (common <= safe))
        if not len(good):
            reach, widened = 2 * reach, widened + 1
            continue
        k = good[len(good) // 2]
        total += int(left[1][i[k]]) - skipped
        since, skipped = int(common[k]) - before, int(right[1][j[k]])
        at, length, reach, left, chunks = cut, min(max(chunk, 2 * reach), len(text) - cut), overlap, right, chunks + 1
    return total + left[2] - skipped, chunks, widened


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
            chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, n_chunks, n_widened."""
    path = path or public_tokenizers.path(MODEL)
    load(path)  # a file that does not fit raises here
    pairs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("n_chunks", IntegerType()), StructField("n_widened", IntegerType())]
    schema = StructType([StructField("id", pairs.schema["id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, size, margin = load(path)
        counter = Counter(tok, size)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = np.ones((4, len(texts)), np.int64)
            out[0], out[3] = [len(t.encode()) for t in texts], 0
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            out[1, short] = [n for part in groups([texts[k] for k in short]) for n in counter.count(part)]
            for k in set(range(len(texts))).difference(short):
                out[1:, k] = count_long(tok, size, margin, texts[k], chunk, overlap)
            cols = [pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", *[f.name for f in fields]])
    return pairs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chunks", "n_widened")
