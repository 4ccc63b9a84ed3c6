"""Repeated passages, found by level-wise doubling of the window length.

Windows of ``ceil(min_words / 2)`` words that occur once are dropped; a
window of twice that length (``min_words``: the two halves overlap by a word
if it is odd) is looked at only where both its halves occur again, and so on.
``repeats`` stops at ``min_words``, which settles every covered word;
``longest`` goes on doubling until no candidate survives.

Documents are packed into chunks, kept in a table bucketed by chunk, and
only keys travel (``packed``). The lower levels carry 32 bits of a key
inside its bucket and let some unrepeated windows through; the level of
``min_words``, and each beyond it, compares 96 bits besides the bucket.
Word hashes have 64 bits, so two windows that differ are taken for equal
only where such hashes collide.

Defined results: a null or blank text has no words and nothing removed; each
row is its own document, whatever its id, so repeated rows repeat each
other's windows; a null id is kept; a text shorter than ``min_words`` stays
whole; equal windows that overlap in one text count as starting twice; an
empty table gives an empty result; other columns are ignored. Texts are
taken whole.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import packed
from tidemark.llm.common import _K, Words, mix, saved, scratch, sliced, table, text_of

CHUNK_BYTES = 8 << 20  # text of a chunk; a longer text is a chunk of its own
MIN_WORDS = 35
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))

EXACT = np.dtype([("a", "<u8"), ("b", "<u4")])


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """Documents packed into rows (chunk, ids, texts, n_words), bucketed by chunk in the shared folder."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("texts", T.ArrayType(T.BinaryType())), T.StructField("n_words", T.LongType())])

    def pack(batches):
        ids, texts, held = [], [], 0

        def row():
            chunk = int.from_bytes(os.urandom(8), "little", signed=True)
            return pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.array([[x.as_py() for x in ids]], pa.list_(kind)),
                pa.array([texts], pa.list_(pa.binary())), pa.array([len(Words(texts))], pa.int64())],
                names=["chunk", "ids", "texts", "n_words"])

        for b in sliced(batches):
            kind = b.schema.field(0).type
            for i, t in zip(b.column(0), b.column(1).to_pylist()):
                if texts and held + len(t) > size:
                    yield row()
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield row()

    rows = docs.select(F.col(id_col).alias("i"), text_of(text_col).cast("binary").alias("t"))
    return packed.stored(rows.mapInArrow(pack, schema), "repeats")


class Windows:
    """Window keys of the words of a chunk's texts."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        self.first = words.first
        self.hashes = words.hashes
        self.ends = np.repeat(self.first[1:], np.diff(self.first))

    def valid(self, length: int) -> np.ndarray:
        """Starts of windows that end in their own text."""
        return np.flatnonzero(np.arange(len(self.ends)) + length <= self.ends)

    def keys(self, length: int, seed: int = 0) -> np.ndarray:
        """64 bits of the ``length`` words from each word on, halves joined to wholes; past a text's end, of no use."""
        k, size = mix(self.hashes + _SEEDS[seed]), 1
        while size < length and len(k) > min(size, length - size):
            step = min(size, length - size)
            k = mix(k[:-step] * _K + k[step:])
            size += step
        return k if size == length else np.empty(0, np.uint64)


def levels(min_words: int, start: int) -> list[int]:
    """Lengths from ``min_words`` down, each half of the next, none below ``start``."""
    out = [min_words]
    while out[0] > 1 and -(-out[0] // 2) >= start:
        out.insert(0, -(-out[0] // 2))
    return out


def _exact(w: Windows, at: np.ndarray, length: int, buckets: int):
    """(placed first keys, 96-bit keys, index of each start's key) of the distinct windows at ``at``, sorted."""
    a, b = w.keys(length)[at], (w.keys(length, 1)[at] & packed.LOW).astype(np.uint32)
    place = packed.placed(a, buckets)
    order = np.lexsort((b, a, place))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    index = np.empty(len(at), np.int64)
    index[order] = np.cumsum(new) - 1
    keys = np.empty(int(new.sum()), EXACT)
    keys["a"], keys["b"] = a[order][new], b[order][new]
    return place[order][new], keys, index


def _repeated(level: int):
    """The answer of one bucket to 96-bit keys: a bit for each of a chunk's keys, in its order."""

    def answer(t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), EXACT) for x in t["body"]]
        a, b = (np.concatenate([r[f] for r in rows]) for f in "ab")
        order = np.lexsort((b, a))
        same = (np.diff(a[order]) == 0) & (np.diff(b[order]) == 0)
        keep = np.zeros(len(a), bool)
        keep[order[1:][same]] = True
        keep[order[:-1][same]] = True
        return packed.answered(t, level, rows, keep, lambda r, k: np.packbits(k).tobytes())

    return answer


def _ask_exact(chunk: int, w: Windows, at: np.ndarray, length: int, buckets: int) -> pa.Table:
    place, keys, index = _exact(w, at, length, buckets)
    twice = np.minimum(np.bincount(index, minlength=len(keys)), 2)  # a window that occurs again here counts twice
    return packed.asked(chunk, np.repeat(place, twice), np.repeat(keys, twice))


def _told(answers: pa.Table, level: int, w: Windows, at: np.ndarray, length: int, buckets: int) -> np.ndarray:
    """Starts among ``at`` whose window is repeated, by the bits of a chunk's answers."""
    if not len(at):
        return at
    place, keys, index = _exact(w, at, length, buckets)
    twice = np.minimum(np.bincount(index, minlength=len(keys)), 2)
    spread, last = np.repeat(place >> packed.SHIFT, twice), np.cumsum(twice) - 1
    bits = np.zeros(len(spread), bool)
    for n, b, x in zip(answers["level"].to_pylist(), answers["bucket"].to_pylist(), answers["body"]):
        if n == level:
            lo, hi = np.searchsorted(spread, np.uint64(b)), np.searchsorted(spread, np.uint64(b), "right")
            bits[lo:hi] = np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(hi - lo)).astype(bool)
    return at[bits[last][index]]


class Ladder:
    """Window lengths, each about twice the one before; those from ``exact`` on are compared by their full keys."""

    def __init__(self, min_words: int, start: int, buckets: int):
        self.lengths, self.buckets = levels(min_words, start), buckets
        self.exact = len(self.lengths) - 1

    def candidates(self, w: Windows, answers: pa.Table | None, k: int) -> np.ndarray:
        """Starts of level ``k`` whose first and last windows of the level below are both repeated."""
        at = w.valid(self.lengths[k])
        if not k or not len(at):
            return at
        before = self.lengths[k - 1]
        if k - 1 < self.exact:
            known = packed.among(packed.placed(w.keys(before), self.buckets), packed.passed(answers, k - 1))
        else:
            known = np.zeros(len(w.hashes), bool)
            known[self.repeated(w, answers, k - 1)] = True
        return at[known[at] & known[at + self.lengths[k] - before]]

    def repeated(self, w: Windows, answers: pa.Table, k: int) -> np.ndarray:
        return _told(answers, k, w, self.candidates(w, answers, k), self.lengths[k], self.buckets)

    def heard(self, k: int) -> int:
        """The lowest level whose answers candidates of level ``k`` need."""
        return max(0, min(k, self.exact) - 1)


class Repeats:
    """The chunk table of a corpus and, level by level, the answers to its questions."""

    def __init__(self, docs: DataFrame, min_words: int = MIN_WORDS, start: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_BYTES):
        if min_words < 1:
            raise ValueError("min_words must be 1 or more")
        self.spark = docs.sparkSession
        self.table = chunked(docs, id_col, text_col, size)
        self.id_type = docs.schema[id_col].dataType
        buckets = packed.bucket_count(self.spark, packed.total(self.table, "n_words"))
        self.ladder = Ladder(min_words, start or -(-min_words // 2), buckets)
        self.answers: list[DataFrame] = []
        for k in range(len(self.ladder.lengths)):
            self._level(k)

    def extend(self) -> None:
        """Double the length until no candidate survives."""
        while not self.answers[-1].isEmpty():
            self.ladder.lengths.append(2 * self.ladder.lengths[-1])
            self._level(len(self.ladder.lengths) - 1)

    def _heard(self, k: int, upto: int) -> DataFrame:
        out = self.answers[self.ladder.heard(k)]
        for a in self.answers[self.ladder.heard(k) + 1:upto]:
            out = out.unionByName(a)
        return out

    def _level(self, k: int) -> None:
        ladder = self.ladder

        def ask(t: pa.Table, answers: pa.Table | None = None) -> pa.Table:
            if k and not answers.num_rows:
                return packed.empty_question()
            w, chunk = Windows(t["texts"][0].as_py()), t["chunk"][0].as_py()
            at = ladder.candidates(w, answers, k)
            if not len(at):
                return packed.empty_question()
            if k < ladder.exact:
                keys = packed.placed(w.keys(ladder.lengths[k])[at], ladder.buckets)
                return packed.counted(chunk, *np.unique(keys, return_counts=True))
            place, keys, index = _exact(w, at, ladder.lengths[k], ladder.buckets)
            twice = np.minimum(np.bincount(index, minlength=len(keys)), 2)  # a window that occurs again here counts twice
            return packed.asked(chunk, np.repeat(place, twice), np.repeat(keys, twice))

        texts = self.table.select("chunk", "texts")
        if k:
            asked = packed.cogrouped(texts, self._heard(k, k), ask, packed.QUESTION)
        else:
            asked = texts.groupBy("chunk").applyInArrow(lambda t: ask(t), packed.QUESTION)
        reply = packed.frequent(2, k) if k < ladder.exact else _repeated(k)
        answers = asked.groupBy("bucket").applyInArrow(reply, packed.ANSWER)
        self.answers.append(saved(answers, scratch(self.spark, f"repeats-level-{ladder.lengths[k]}")))

    def per_document(self) -> DataFrame:
        """Per row of the documents: its id, n_words, longest, spans of covered words and the words left.

        ``longest`` is the greatest length asked at which a window of the text is repeated, 0 if there is none.
        """
        ladder, top = self.ladder, len(self.answers) - 1
        schema = T.StructType([T.StructField("doc", self.id_type), T.StructField("n_words", T.LongType()),
                               T.StructField("longest", T.LongType()),
                               T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType())])

        def write(t: pa.Table, answers: pa.Table) -> pa.Table:
            texts = t["texts"][0].as_py()
            longest, first, gone = np.zeros(len(texts), np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros(1, np.int64)
            if answers.num_rows:
                w = Windows(texts)
                first, gone = w.first, np.zeros(len(w.hashes) + 1, np.int64)
                for k in range(ladder.exact, top + 1):
                    at = ladder.repeated(w, answers, k)
                    longest[np.searchsorted(first, at, "right") - 1] = ladder.lengths[k]
                    if k == ladder.exact:
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + ladder.lengths[k], -1)
            cover = np.cumsum(gone) > 0
            counts, spans, kept = [], [], []
            for d, raw in enumerate(texts):
                ws, c = raw.split(), cover[first[d]:first[d + 1]]
                edges = np.flatnonzero(np.diff(c.astype(np.int8), prepend=0, append=0))
                counts.append(len(ws))
                spans.append(edges.reshape(-1, 2).tolist())
                kept.append(b" ".join(itertools.compress(ws, ~c) if len(edges) else ws).decode())
            return pa.table({"doc": t["ids"].combine_chunks().flatten(), "n_words": pa.array(counts, pa.int64()),
                             "longest": pa.array(longest), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                             "kept": pa.array(kept, pa.string())})

        return packed.cogrouped(self.table.select("chunk", "ids", "texts"), self._heard(top, top + 1), write, schema)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, start: int | None = None, id_col: str = "doc_id",
            text_col: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """Per row: ``id_col``, n_words, longest, spans (word ranges that a repeated window of ``min_words`` covers,
    end exclusive) and kept (the other words, joined by one space)."""
    return Repeats(docs, min_words, start, id_col, text_col, size).per_document().withColumnRenamed("doc", id_col)


def longest(docs: DataFrame, min_words: int = MIN_WORDS, start: int | None = None, id_col: str = "doc_id",
            text_col: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """As ``repeats``, with the lengths doubled until no candidate survives: ``longest`` is min_words * 2**k."""
    found = Repeats(docs, min_words, start, id_col, text_col, size)
    found.extend()
    return found.per_document().withColumnRenamed("doc", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
