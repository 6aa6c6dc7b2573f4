"""SentencePiece encoding and decoding with n-best segmentation over the piece lattice.

The vocabulary file gives the pieces in order of rank; a piece's log-probability follows Zipf's law over the ranks,
``-log(rank + 1)`` less the log of their sum.  A segmentation's score is the sum over its pieces.  A character that no
piece spells goes by its UTF-8 bytes, a byte piece each (at the last rank), so decoding gives back the text exactly;
spaces are written U+2581, one stands before the text, and a U+2581 of the text itself goes by bytes.

N-best: a forward Viterbi pass scores every prefix of a unit, and these scores are exact heuristics of a backward A-star
search, which yields its segmentations from the best downwards.  Pieces may hold runs of spaces; a run belongs to the word
behind it, so words begin at each space that follows another character (a vocabulary with pieces across such a place
makes a text one word).  No piece crosses a pair of characters that no piece joins, so a text's lattice is a chain of units.  Each unit's gap between its best two segmentations comes
from forward and backward scores; a text's ``nbest`` segmentations can deviate from its best only in the ``nbest - 1``
units of least gap, so the search runs on these and the lists merge to the text's.  Rows of known words and units are kept in bounded
tables; the new units of about a megabyte of text go through Viterbi together, by length.

Defined cases: an empty table gives an empty result; null text has null ids and no segmentation, empty text no pieces
and one segmentation; fewer segmentations than asked for give a shorter list; equal scores go in order of their
ids (which of those that tie at the list's end are given is up to the search, alike each time).
Added columns (replacing those of these names): ``ids``, ``n_pieces``, ``score``, ``nbest`` (score and the words that
differ from ``ids``, each with its number and its pieces), ``round_trip`` (decoding gave the text back).
"""

from __future__ import annotations

import gc
import heapq
import itertools
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
CACHE = 1_200_000
CACHE_LETTERS = 1 << 25
LISTS = 40_000
BATCHED = 64  # longest unit that is looked at together with others
OTHER = re.compile(r"[\W\d_]")
NO_PREFIX = (-1, -math.inf)
CHUNK = 1 << 20
SPACE = "▁"
MARK = "\ud800"  # within this module a U+2581 of the text, which UTF-8 text cannot hold
RUN = re.compile(f"{SPACE}+[^{SPACE}]*")
ADDED = ["ids", "n_pieces", "score", "nbest", "round_trip"]
CHANGE = pa.list_(pa.struct([("word", pa.int32()), ("ids", pa.list_(pa.int32()))]))
NBEST_TYPE = pa.list_(pa.struct([("score", pa.float64()), ("changes", CHANGE)]))
SCHEMA = "ids array<int>, n_pieces int, score double, nbest array<struct<score:double,changes:array<struct<word:int,ids:array<int>>>>>, round_trip boolean"


def spelled(c: str) -> bytes:
    return SPACE.encode() if c == MARK else c.encode("utf-8", "replace")


class Pieces:
    """The lattice of a vocabulary: pieces with their scores, and the units that no piece crosses."""

    def __init__(self, model: str = MODEL):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        byte, ranked = {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ranked.append((-sp.get_score(i), i, piece))
        ranked.sort()
        mass = math.log(sum(1 / (r + 1) for r in range(len(ranked) + 1)))
        self.byte, self.byte_score = byte, -math.log(len(ranked) + 1) - mass
        self.node: dict[str, tuple[int, float] | None] = {}
        self.glue: set[str] = set()
        self.spelled: dict[int, bytes] = {i: bytes([b]) for b, i in byte.items()}
        for r, (_, i, piece) in enumerate(ranked):
            for k in range(1, len(piece)):
                self.node.setdefault(piece[:k], None)
                self.glue.add(piece[k - 1:k + 1])
            self.node[piece] = (i, -math.log(r + 1) - mass)
            self.spelled[i] = piece.replace(SPACE, " ").encode()
        self.trie: dict[str, tuple] = {}  # character to (characters below, id or None, score)
        for r, (_, i, piece) in enumerate(ranked):
            below = self.trie
            for c in piece[:-1]:
                below = below.setdefault(c, ({}, None, 0.0))[0]
            below[piece[-1]] = (below.get(piece[-1], ({},))[0], i, self.node[piece][1])
        self.table()
        self.joins = any(g[1] == SPACE != g[0] for g in self.glue)  # a piece holds a space behind another character
        self.forget()
        self.lists: dict[tuple[str, int], list] = {}  # n-best by word

    def table(self) -> None:
        """The trie in arrays: characters by number, the children of a place in one sorted list of keys."""
        letters = sorted({c for piece in self.node for c in piece})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        ids, scores, keys, below, queue = [-1], [0.0], [], [], [(0, self.trie)]
        for at, children in queue:  # grows while it is walked
            for c, (under, one, s) in children.items():
                keys.append(at * self.base + int(self.number[ord(c)]))
                below.append(len(ids))
                queue.append((len(ids), under))
                ids.append(-1 if one is None else one)
                scores.append(s)
        order = np.argsort(np.array(keys))
        self.keys, self.below = np.r_[np.array(keys, np.int64)[order], np.iinfo(np.int64).max], np.r_[np.array(below)[order], 0]
        self.place_id, self.place_score = np.array(ids), np.array(scores)
        self.first = np.zeros(self.base, np.int64)
        top = self.keys < self.base
        self.first[self.keys[top]] = self.below[top]

    def forget(self) -> None:
        """Empty tables of what is known: a row has a score, a gap and a stretch of ``flat``, its ids."""
        self.words: dict[str, int] = {}  # row of a word, or of the unit that begins one
        self.later: dict[str, int] = {}  # row of a further unit
        self.scores, self.gaps, self.begins, self.sizes = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.rows, self.used, self.letters = np.zeros(4096, np.int32), 0, 0, 0

    def add(self, sizes: np.ndarray, ids: np.ndarray, scores: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """New rows; their numbers."""
        n = len(sizes)
        while self.rows + n > len(self.scores):
            self.scores, self.gaps, self.begins, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.gaps, self.begins, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        at = slice(self.rows, self.rows + n)
        self.scores[at], self.gaps[at], self.sizes[at], self.begins[at] = scores, gaps, sizes, self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.rows, self.used = self.rows + n, self.used + len(ids)
        return np.arange(at.start, at.stop)

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        """The rows' ids, one row's after the other's."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begins[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def learn(self, units: list[str]) -> list[int]:
        """New rows of ``units``: those of one length walk the trie and pass their scores on together."""
        out = np.zeros(len(units), np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            own = [units[k] for k in at.tolist()]
            if n <= BATCHED:
                points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                out[at] = self.add(*self.best_of_length(points))
            else:
                got = [self.best(u) for u in own]
                out[at] = self.add(np.array([len(g[0]) for g in got]), np.array(list(chain.from_iterable(g[0] for g in got))), np.array([g[1] for g in got]), np.array([g[2] for g in got]))
        self.letters += int(sizes.sum())
        return out.tolist()

    def best_of_length(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of units of one length, given by their code points: (numbers of ids, ids, scores, gaps)."""
        count, n = points.shape
        letters = self.number[points].astype(np.int64)
        place = self.first[letters]
        one_id = np.where(place > 0, self.place_id[place], -1)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        one_score = np.where(one_id >= 0, self.place_score[place], self.byte_score * width)
        f = np.full((count, n + 1), -np.inf)
        f[:, 0] = 0.0
        via, own = np.zeros((count, n + 1), np.int32), np.full((count, n + 1), -1, np.int32)
        arcs, everyone = [], np.arange(count)
        for i in range(n):
            at = f[:, i]
            arcs.append((i, i + 1, everyone, one_score[:, i]))
            score = at + one_score[:, i]
            up = np.flatnonzero(score > f[:, i + 1])
            f[up, i + 1], via[up, i + 1], own[up, i + 1] = score[up], i, one_id[up, i]
            live = np.flatnonzero(place[:, i])
            node, j = place[live, i], i + 1
            while len(live) and j < n:
                key = node * self.base + letters[live, j]
                spot = np.searchsorted(self.keys, key)
                hit = self.keys[spot] == key
                live, node, j = live[hit], self.below[spot[hit]], j + 1
                ends = self.place_id[node] >= 0
                rows, last = live[ends], node[ends]
                if len(rows):
                    s = self.place_score[last]
                    arcs.append((i, j, rows, s))
                    score = at[rows] + s
                    up = score > f[rows, j]
                    r = rows[up]
                    f[r, j], via[r, j], own[r, j] = score[up], i, self.place_id[last[up]]
        onward, piece = np.full((count, n + 1), -1, np.int32), np.full((count, n + 1), -1, np.int32)
        rows, end = everyone, np.full(count, n)
        while len(rows):
            begin = via[rows, end]
            onward[rows, begin], piece[rows, begin] = end, own[rows, end]
            more = begin > 0
            rows, end = rows[more], begin[more]
        b, top = np.full((count, n + 1), -np.inf), np.full(count, -np.inf)
        b[:, n] = 0.0
        for i, j, rows, s in reversed(arcs):
            t = s + b[rows, j]
            b[rows, i] = np.maximum(b[rows, i], t)
            away = onward[rows, i] != j
            r = rows[away]
            top[r] = np.maximum(top[r], f[r, i] + t[away])
        used = onward[:, :n] >= 0
        ids, sizes = piece[:, :n][used], used.sum(axis=1)
        if (ids < 0).any():  # characters that go by their bytes
            own = [[i] if i >= 0 else [self.byte[x] for x in spelled(chr(c))] for i, c in zip(ids.tolist(), points[used].tolist())]
            place = np.zeros((count, n), np.int64)
            place[used] = [len(o) for o in own]
            ids, sizes = np.array(list(chain.from_iterable(own))), place.sum(axis=1)
        return sizes, ids, f[:, n], np.maximum(f[:, n] - top, 0.0)

    def look_ahead(self, words: set[str]) -> None:
        """Rows for those ``words`` that have none; the tables start anew once they hold ``CACHE`` rows."""
        if self.rows > CACHE or self.letters > CACHE_LETTERS:
            self.forget()
        cut = {w: self.units(w) for w in words if w not in self.words}
        for known, units, lead in ((self.words, {u[0] for u in cut.values()}, 1), (self.later, {x for u in cut.values() for x in u[1:]}, 0)):
            new = [u for u in units if u[lead:] not in known]
            known.update(zip([u[lead:] for u in new], self.learn(new)))
        # a unit that begins a word is a word of its own, so no key stands for two things
        several = [(w, u) for w, u in cut.items() if len(u) > 1]
        if several:
            words_, later = self.words, self.later
            parts = np.array(list(chain.from_iterable([words_[u[0][1:]], *[later[x] for x in u[1:]]] for _, u in several)))
            begin = np.cumsum([0, *[len(u) for _, u in several[:-1]]])
            rows = self.add(np.add.reduceat(self.sizes[parts], begin), self.ids_of(parts), np.add.reduceat(self.scores[parts], begin), np.minimum.reduceat(self.gaps[parts], begin))
            words_.update(zip([w for w, _ in several], rows.tolist()))
            self.letters += sum(len(w) for w, _ in several)

    def arcs(self, unit: str) -> list[tuple[int, int, tuple[int, ...], float]]:
        """(start, end, ids, score) in order of start."""
        out, node, n = [], self.node, len(unit)
        for i in range(n):
            one = node.get(unit[i])
            if one is None:
                raw = spelled(unit[i])
                out.append((i, i + 1, tuple(self.byte[b] for b in raw), self.byte_score * len(raw)))
            else:
                out.append((i, i + 1, (one[0],), one[1]))
            for j in range(i + 2, n + 1):
                hit = node.get(unit[i:j], NO_PREFIX)
                if hit is NO_PREFIX:
                    break
                if hit is not None:
                    out.append((i, j, (hit[0],), hit[1]))
        return out

    def best(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """(ids, score, gap to the second best, infinite if there is none) of a unit."""
        n, root, arcs = len(unit), self.trie, []
        f, via = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i in range(n):
            at, c = f[i], unit[i]
            node = root.get(c)
            if node is None or node[1] is None:
                raw = spelled(c)
                ids, s = tuple([self.byte[b] for b in raw]), self.byte_score * len(raw)
            else:
                ids, s = node[1:2], node[2]
            arcs.append((i, i + 1, s))
            if at + s > f[i + 1]:
                f[i + 1], via[i + 1] = at + s, (i, ids)
            if node is None:
                continue
            below, j = node[0], i + 1
            while below and j < n:
                node = below.get(unit[j])
                if node is None:
                    break
                j += 1
                below, one, s = node
                if one is not None:
                    arcs.append((i, j, s))
                    if at + s > f[j]:
                        f[j], via[j] = at + s, (i, (one,))
        path, ids, end = set(), [], n
        while end:
            i, own = via[end]
            path.add((i, end))
            ids.append(own)
            end = i
        b, top = [-math.inf] * n + [0.0], -math.inf
        for i, j, s in reversed(arcs):
            s += b[j]
            if s > b[i]:
                b[i] = s
            if f[i] + s > top and (i, j) not in path:
                top = f[i] + s
        return tuple(chain.from_iterable(reversed(ids))), f[n], max(f[n] - top, 0.0)

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a unit: A-star from its end, the forward scores being the heuristics."""
        arcs, size = self.arcs(unit), len(unit)
        f, into = [0.0] + [-math.inf] * size, [[] for _ in range(size + 1)]
        for a in arcs:
            f[a[1]] = max(f[a[1]], f[a[0]] + a[3])
            into[a[1]].append(a)
        # a way is (ids, the way behind it); the n best pass a place by its n best ways at most
        heap, out, passed, made = [(-f[size], size, 0, 0.0, None)], [], [0] * (size + 1), itertools.count(1)
        while heap and len(out) < n:
            cost, at, _, g, way = heapq.heappop(heap)
            if at == 0:
                ids = []
                while way:
                    ids += way[0]
                    way = way[1]
                out.append((-cost, tuple(ids)))
                continue
            passed[at] += 1
            if passed[at] <= n:
                for i, _, own, s in into[at]:
                    heapq.heappush(heap, (-(f[i] + g + s), i, next(made), g + s, (own, way)))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def split(self, text: str) -> list[str]:
        """The words of a text, each without its first space; further spaces are written U+2581."""
        if SPACE in text:
            text = text.replace(SPACE, MARK)
        if self.joins:
            return [text.replace(" ", SPACE)]
        if "  " in text or text[0] == " ":
            return [w[1:] for w in RUN.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def units(self, word: str) -> list[str]:
        """``word`` behind a space, cut beside its other characters than letters where no piece joins the two (within
        letters a cut seldom helps)."""
        text, out, begin = SPACE + word, [], 0
        if word.isalpha():
            return [text]
        if word[:-1].isalpha():  # a sign behind a word, by far the most frequent
            return [text] if text[-2:] in self.glue or not OTHER.match(word[-1]) else [text[:-1], text[-1]]
        glue, last = self.glue, 0
        for m in OTHER.finditer(text, 1):
            i = m.start()
            for at in (i, i + 1) if i > last else (i + 1,):
                if at < len(text) and text[at - 1:at + 1] not in glue:
                    out.append(text[begin:at])
                    begin = at
            last = i + 1
        out.append(text[begin:])
        return out

    def word_n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a word from those of its units."""
        out = [(0.0, ())]
        for unit in self.units(word):
            out = sorted(((s + t, a + b) for s, a in out for t, b in self.n_best(unit, n)), key=lambda x: (-x[0], x[1]))[:n]
        return out

    def encode(self, text: str, n: int = NBEST) -> tuple[list[int], float, list[dict]]:
        """(ids, score, n best: score and changed words) of a text."""
        words = self.split(text) if text else []
        self.look_ahead(set(words))
        ids, score, best = self.encoded(words, n)
        return ids.tolist(), score, best

    def encoded(self, words: list[str], n: int) -> tuple[np.ndarray, float, list[dict]]:
        """``encode`` of a text by its words, which have rows."""
        if not words:
            return np.zeros(0, np.int32), 0.0, [{"score": 0.0, "changes": []}]
        rows = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        ids, gaps = self.ids_of(rows), self.gaps[rows]
        score = math.fsum(self.scores[rows].tolist())
        least = np.argsort(gaps, kind="stable")[:n - 1] if len(gaps) <= 4 * n else np.sort(np.argpartition(gaps, n - 1)[:n - 1])
        paths = [(score, [])]
        for at in sorted(least.tolist()):
            own = self.lists.get((words[at], n))
            if own is None:
                if len(self.lists) >= LISTS:
                    self.lists.clear()
                own = self.lists[words[at], n] = self.word_n_best(words[at], n)
            paths = sorted(((s + t - own[0][0], c + ([{"word": at, "ids": list(w)}] if k else [])) for s, c in paths for k, (t, w) in enumerate(own)), key=lambda x: -x[0])[:n]
        return ids, score, [{"score": s, "changes": c} for s, c in paths]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.spelled[i] for i in ids]).decode("utf-8")[1:]


def encode(df: DataFrame, text_col: str = "text", model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """``df`` with its texts' pieces; the vocabulary is read on the driver and shared."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(model))
    df = df.drop(*ADDED)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 100)  # the caches hold no cycles, and walking them often is slow
        pieces = shared.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part, size, begin = [], 0, at
                while at < batch.num_rows and size < CHUNK:
                    part.append(batch[text_col][at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                words = [pieces.split(t) if t else [] for t in part]
                pieces.look_ahead(set(chain.from_iterable(words)))
                coded = [(None, None, []) if t is None else pieces.encoded(w, nbest) for t, w in zip(part, words)]
                back = [None if c[0] is None else pieces.decode(c[0].tolist()) == t for t, c in zip(part, coded)]
                n = np.array([0 if c[0] is None else len(c[0]) for c in coded], np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *[c[0] for c in coded if c[0] is not None]])
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat), mask=pa.array([c[0] is None for c in coded]))
                new = [ids, pa.array(n), pa.array([c[1] for c in coded], pa.float64()), pa.array([c[2] for c in coded], NBEST_TYPE), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, at - begin).columns, *new], [*batch.schema.names, *ADDED])
    return df.mapInArrow(run, f"{head}, {SCHEMA}" if head else SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs.select(F.col("doc_id"), F.col("text"))).drop("text")
