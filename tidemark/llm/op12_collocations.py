"""Phrase collocations from an FM-index over word ids in each shard.

A shard holds the pieces of one language's texts as a sequence of local word
ids, 0 between pieces. Its index is the Burrows-Wheeler transform of that
sequence and of its reverse, both sorted by contexts of at least
``max_words`` ids, which is all that intervals of that depth read. A phrase
is a pair of intervals of equal size, one in each transform; extending it by
a word on the left (or right) reads the forward (reverse) transform inside
its interval: the distinct ids there are the extensions, their numbers the
counts; LF-mapping gives the new interval on that side, the ids below them
the offset on the other.

Level by level the shards send the 64-bit keys of their phrases with their
counts (packed by hash bucket, ``packed``). The task of a bucket sums them
and answers each shard which of its keys occur ``min_count`` times over all
shards; a shard extends only phrases whose first and last words are frequent
too. For each frequent phrase one shard is named its owner and told the
totals; it alone gives the phrase as text, so a phrase becomes one row
however many shards hold it. Totals: occurrences, and those with a word on
the left and on the right in the same piece. Scores use 38-digit decimals.

Pieces are what ``[.,;:!?\\x0A-\\x0D]`` separates, words ``[^\\x20\\x09]+``,
A-Z lower-cased.

Defined results: a null or empty text has no words; a null language is
``und``; every row counts, also repeated ones, whatever its id; equal scores
are ordered by count, then by the phrase's bytes; an empty table gives an
empty result; other columns are ignored. Texts are taken whole. Words and
phrases are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import packed
from tidemark.llm.common import _K, Words, mix, saved, scratch, sliced, table, text_of

SHARD_BYTES = 8 << 20  # text of a shard; a longer text is a shard of its own
OPEN_BYTES = 32 << 20  # texts that a task holds over all languages
MIN_COUNT, MAX_WORDS, TOP, INSIDE = 10, 3, 2000, 50
SCORE_UNIT = 1_000_000
DIGITS = "decimal(15,0)"  # of a count

_SPLIT = np.zeros(256, bool)
_SPLIT[[10, 11, 12, 13, *b".,;:!?"]] = True
_GAP = _SPLIT.copy()
_GAP[[9, 32]] = True

SHARD = "chunk bigint, lang string, n_words bigint, words array<binary>, forward binary, reverse binary"
GRAM = "lang string, size int, phrase string, n bigint, n_left bigint, n_right bigint"


class PieceWords(Words):
    """Words between blanks and piece ends."""

    def __init__(self, raw: list[bytes]):
        self.buf = b"\n".join([b"", *raw, b""])
        a = self.array = np.frombuffer(self.buf, np.uint8)
        gap = _GAP[a]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self._hashes = None

    def new_piece(self) -> np.ndarray:
        """Whether a piece begins at each word."""
        splits = np.cumsum(_SPLIT[self.array])
        return np.diff(splits[self.starts], prepend=-1) > 0


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Stable order of rows by non-negative keys, the first one foremost: radix sort by 16 bits at a time."""
    order = None
    for key in reversed(keys):
        for shift in range(0, max(int(key.max()).bit_length(), 1) if len(key) else 0, 16):
            digit = (key >> shift).astype(np.uint16)
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys[0])) if order is None else order


def transform(seq: np.ndarray, depth: int) -> np.ndarray:
    """Burrows-Wheeler transform of a cyclic sequence, rotations sorted by their first ``depth`` ids or more."""
    rank, size = seq, 1
    order = ordered(rank) if depth == 1 else None
    while size < depth:
        after = np.roll(rank, -size)
        order = ordered(rank, after)
        size *= 2
        if size < depth:
            new = (np.diff(rank[order], prepend=-1) != 0) | (np.diff(after[order], prepend=-1) != 0)
            rank = np.empty(len(seq), np.int32)
            rank[order] = np.cumsum(new) - 1
    return seq[order - 1]


def indexed(raw: list[bytes], depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words by local id from 1 on, forward and reverse transform) of some texts."""
    w = PieceWords([r.lower() for r in raw])
    if not len(w):
        return [], np.zeros(1, np.int32), np.zeros(1, np.int32)
    _, at, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
    new = w.new_piece()
    seq = np.zeros(len(w) + int(new.sum()), np.int32)
    seq[np.arange(len(w)) + np.cumsum(new)] = ids + 1
    return [w.word(i) for i in at], transform(seq, depth), transform(seq[::-1], depth)


class Side:
    """One transform with its LF-mapping and the number of real ids before each place."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.lf = np.empty(len(bwt), np.int64)
        self.lf[ordered(bwt)] = np.arange(len(bwt))
        self.real = np.concatenate([[0], np.cumsum(bwt > 0)])

    def extensions(self, low: np.ndarray, size: np.ndarray):
        """For intervals: (interval, id, count, start on this side, offset on the other) of every extension by one id."""
        start = np.cumsum(size) - size
        places = np.arange(int(size.sum())) - np.repeat(start - low, size)
        which = np.repeat(np.arange(len(low)), size)
        word = self.bwt[places]
        order = ordered(which, word)
        first = np.flatnonzero((np.diff(which[order], prepend=-1) != 0) | (np.diff(word[order], prepend=-1) != 0))
        count = np.diff(np.append(first, len(word)))
        one = places[order[first]]  # the first place of the id in its interval
        whose = which[order[first]]
        return whose, self.bwt[one], count, self.lf[one], first - start[whose]


class Frontier:
    """Phrases of one length in a shard: local ids (one row a phrase) and their two intervals."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, low_reverse: np.ndarray, size: np.ndarray):
        self.ids, self.low, self.low_reverse, self.size = ids, low, low_reverse, size

    def __len__(self) -> int:
        return len(self.size)

    def only(self, keep: np.ndarray) -> Frontier:
        return Frontier(self.ids[keep], self.low[keep], self.low_reverse[keep], self.size[keep])


CEILING = 255  # counts up to here take a byte, others eight more


def _body(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys and their three counts, column by column; counts of 255 and more follow in full."""
    low = np.minimum(counts, CEILING).astype(np.uint8)
    return b"".join([np.uint32(len(keys)).tobytes(), keys.tobytes(), low.T.tobytes(), counts.T[low.T == CEILING].astype("<u8").tobytes()])


def _parsed(body: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(body.as_buffer())
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    keys = np.frombuffer(raw, "<u8", n, 4)
    counts = np.frombuffer(raw, np.uint8, 3 * n, 4 + 8 * n).reshape(3, n).astype(np.int64)
    big = counts == CEILING
    counts[big] = np.frombuffer(raw, "<u8", int(big.sum()), 4 + 11 * n)
    return keys, counts.T


def summed(threshold: int, level: int):
    """The answer of one bucket: of each shard's keys, which are frequent, which it owns, and the totals of those."""

    def answer(t: pa.Table) -> pa.Table:
        rows = [_parsed(x) for x in t["body"]]
        keys = np.concatenate([k for k, _ in rows])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] ^ np.uint64(1)))
        sums = np.add.reduceat(np.concatenate([c for _, c in rows])[order], first)
        frequent = sums[:, 0] >= threshold
        told, owner, totals = (np.zeros(len(keys), bool), np.zeros(len(keys), bool), np.zeros((len(keys), 3), np.int64))
        told[order] = np.repeat(frequent, np.diff(np.append(first, len(keys))))
        mine = order[first[frequent]]  # the first shard of the bucket that has the key
        owner[mine], totals[mine] = True, sums[frequent]
        at = np.concatenate([[0], np.cumsum([len(k) for k, _ in rows])])
        out = [(c, b, np.packbits(told[i:j]).tobytes() + np.packbits(owner[i:j]).tobytes() + totals[i:j][owner[i:j]].tobytes())
               for c, b, i, j in zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), at, at[1:]) if told[i:j].any()]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "level": pa.array([level] * len(out), pa.int32()),
                         "bucket": pa.array([x[1] for x in out], pa.int64()), "body": pa.array([x[2] for x in out], pa.binary())})

    return answer


class Shard:
    """A shard's index and, with the answers so far, its phrases of each length in the order of their keys."""

    def __init__(self, t: pa.Table, buckets: int, answers: pa.Table | None = None):
        self.chunk, self.lang, self.buckets = t["chunk"][0].as_py(), t["lang"][0].as_py(), buckets
        self.words = t["words"].combine_chunks().flatten()
        self.forward, self.reverse = (Side(np.frombuffer(t[c][0].as_buffer(), "<i4")) for c in ("forward", "reverse"))
        raw = self.words.to_pylist()
        own = PieceWords(raw).hashes if raw else np.empty(0, np.uint64)
        self.hashes = np.concatenate([np.zeros(1, np.uint64), mix(own ^ PieceWords([self.lang.encode() + b"x"]).hashes[0])])
        self.levels: dict[int, tuple[Frontier, np.ndarray]] = {}
        self.told: dict[int, list] = {}
        for level, bucket, body in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "body"))) if answers else ():
            self.told.setdefault(level, []).append((bucket, body))

    def keys(self, ids: np.ndarray) -> np.ndarray:
        k = np.full(len(ids), ids.shape[1], np.uint64)
        for c in range(ids.shape[1]):
            k = mix(k * _K + self.hashes[ids[:, c]])
        return k

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Buckets are stretches of the keys, so keys in order are in the order of their buckets."""
        return ((keys >> packed.SHIFT) * np.uint64(self.buckets) >> packed.SHIFT).astype(np.int64)

    def level(self, n: int) -> tuple[Frontier, np.ndarray]:
        """Phrases of ``n`` words whose parts are frequent, in the order of their keys, and the keys."""
        if n in self.levels:
            return self.levels[n]
        if n == 1:
            counts = np.bincount(self.forward.bwt, minlength=len(self.hashes))
            low = np.cumsum(counts) - counts
            out = Frontier(np.arange(1, len(counts))[:, None], low[1:], low[1:], counts[1:])
        else:
            out = self.extended(*self.frequent(n - 1), n)
        keys = self.keys(out.ids)
        order = np.argsort(keys)
        self.levels[n] = out.only(order), keys[order]
        return self.levels[n]

    def heard(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the answers of a level: which of its keys are frequent, which are owned, and the totals of the owned."""
        told, owned, totals = np.zeros(len(keys), bool), np.zeros(len(keys), bool), np.zeros((len(keys), 3), np.int64)
        bucket = self.bucket(keys)
        for b, body in self.told.get(n, ()):
            i, j = np.searchsorted(bucket, [b, b + 1])
            size = -(-(j - i) // 8)
            told[i:j], owned[i:j] = (np.unpackbits(np.frombuffer(body, np.uint8, size, k * size), count=int(j - i)).astype(bool) for k in (0, 1))
            totals[i:j][owned[i:j]] = np.frombuffer(body, np.int64, -1, 2 * size).reshape(-1, 3)
        return told, owned, totals

    def frequent(self, n: int) -> tuple[Frontier, np.ndarray]:
        found, keys = self.level(n)
        told = self.heard(n, keys)[0]
        return found.only(told), keys[told]

    def extended(self, part: Frontier, frequent: np.ndarray, n: int) -> Frontier:
        """Phrases one word longer: even lengths grow to the left, odd ones to the right."""
        if not len(part):
            return Frontier(np.empty((0, n), np.int64), *(np.empty(0, np.int64) for _ in range(3)))
        left = n % 2 == 0
        side, low = (self.forward, part.low) if left else (self.reverse, part.low_reverse)
        whose, word, count, here, offset = side.extensions(low, part.size)
        other = (part.low_reverse if left else part.low)[whose] + offset
        words = [word[:, None].astype(np.int64), part.ids[whose]]
        out = Frontier(np.hstack(words if left else words[::-1]), here if left else other, other if left else here, count)
        out = out.only(word > 0)
        return out.only(packed.among(self.keys(out.ids[:, :-1] if left else out.ids[:, 1:]), np.sort(frequent)))

    def asked(self, n: int) -> pa.Table:
        found, keys = self.level(n)
        if not len(found):
            return packed.empty_question()
        alone = [found.size - (side.real[low + found.size] - side.real[low])
                 for side, low in ((self.forward, found.low), (self.reverse, found.low_reverse))]
        counts = np.stack([found.size, *alone], axis=1)
        cuts = np.flatnonzero(np.diff(self.bucket(keys), prepend=-1))
        ends = np.append(cuts[1:], len(keys))
        return pa.table({"bucket": pa.array(self.bucket(keys)[cuts]), "chunk": pa.array(np.full(len(cuts), self.chunk)),
                         "body": pa.array([_body(keys[a:b], counts[a:b]) for a, b in zip(cuts, ends)], pa.binary())})

    def owned(self, most: int) -> pa.Table:
        """The frequent phrases that this shard owns, as text with their totals."""
        parts = [pa.table({"lang": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "phrase": pa.array([], pa.string()),
                           **{c: pa.array([], pa.int64()) for c in ("n", "n_left", "n_right")}})]
        for n in range(1, most + 1):
            found, keys = self.level(n)
            _, mine, totals = self.heard(n, keys)
            ids, (size, no_left, no_right) = found.ids[mine], totals[mine].T
            words = [self.words.take(pa.array(ids[:, c] - 1)) for c in range(n)]
            phrase = pc.binary_join_element_wise(*words, b" ") if n > 1 else words[0]
            parts.append(pa.table({
                "lang": pa.array([self.lang] * len(ids), pa.string()), "size": pa.array(np.full(len(ids), n, np.int32)),
                "phrase": phrase.cast(pa.string()), "n": pa.array(size), "n_left": pa.array(size - no_left), "n_right": pa.array(size - no_right)}))
        return pa.concat_tables(parts)


def shards(docs: DataFrame, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang",
           size: int = SHARD_BYTES) -> DataFrame:
    """FM-indexes of the corpus, one row a shard, bucketed in the shared folder."""

    def build(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def row(lang):
            words, forward, reverse = indexed(held.pop(lang), max_words)
            del sizes[lang]
            chunk = int.from_bytes(os.urandom(8), "little", signed=True)
            return pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.array([lang]), pa.array([int((forward > 0).sum())], pa.int64()),
                pa.array([words], pa.list_(pa.binary())), pa.array([forward.astype("<i4").tobytes()], pa.binary()),
                pa.array([reverse.astype("<i4").tobytes()], pa.binary())],
                names=["chunk", "lang", "n_words", "words", "forward", "reverse"])

        for b in sliced(batches):
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang in held and sizes[lang] + len(t) > size:
                    yield row(lang)
                held.setdefault(lang, []).append(t)
                sizes[lang] = sizes.get(lang, 0) + len(t)
                if sum(sizes.values()) > max(OPEN_BYTES, size):
                    yield row(max(sizes, key=sizes.get))
        for lang in list(held):
            yield row(lang)

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("t"))
    return packed.stored(rows.mapInArrow(build, SHARD), "shards")


def phrase_counts(table: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """Per language and phrase of up to ``max_words`` words that occurs ``min_count`` times or more:
    lang, size, phrase, n, n_left, n_right (occurrences with a neighbour on that side), summed over the shards."""
    spark, index = table.sparkSession, table.drop("n_words")
    buckets = packed.bucket_count(spark, packed.total(table, "n_words"))
    heard: DataFrame | None = None
    for n in range(1, max_words + 1):
        ask = _asker(n, buckets)
        if heard is None:
            asked = index.groupBy("chunk").applyInArrow(lambda t: ask(t, None), packed.QUESTION)
        else:
            asked = packed.cogrouped(index, heard, ask, packed.QUESTION)
        answers = saved(asked.groupBy("bucket").applyInArrow(summed(min_count, n), packed.ANSWER), scratch(spark, f"phrases-{n}"))
        heard = answers if heard is None else heard.unionByName(answers)
    return saved(packed.cogrouped(index, heard, _giver(max_words, buckets), GRAM), scratch(spark, "phrase-counts"))


def _asker(n: int, buckets: int):
    def ask(t: pa.Table, answers: pa.Table | None) -> pa.Table:
        return packed.empty_question() if n > 1 and not answers.num_rows else Shard(t, buckets, answers).asked(n)
    return ask


def _giver(most: int, buckets: int):
    def give(t: pa.Table, answers: pa.Table) -> pa.Table:
        return Shard(t, buckets, answers).owned(most if answers.num_rows else 0)
    return give


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE,
                 text_col: str = "text", lang_col: str = "lang", size: int = SHARD_BYTES) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score, n_left, n_right.

    A phrase is scored by its worst cut in two, floor(10**6 * a**2 / (l * r)); it is dropped if a longer phrase
    around it has ``inside`` percent of its occurrences or more.
    """
    if max_words < 2:
        raise ValueError("max_words must be 2 or more")
    index = shards(docs, max_words, text_col, lang_col, size)
    counts = phrase_counts(index, max_words, min_count)
    words = index.groupBy("lang").agg(F.sum("n_words").alias("n_all"))
    found = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    cut = found.select("lang", "phrase", "n", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "n", "k",
                     F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    part = counts.select("lang", "phrase", "n")
    cut = (cut.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
           .join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]))
    exact = f"CAST(n AS {DIGITS}) * CAST(n AS {DIGITS}) * {SCORE_UNIT} DIV (CAST(l AS {DIGITS}) * CAST(r AS {DIGITS}))"
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    around = (found.where("size > 2").select("lang", "n", F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "),
        F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    rows = (scored.join(found.drop("w"), ["lang", "phrase"]).join(around, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("n"))).join(words, "lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("n"), "phrase")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"),
                    F.col("cut.r").alias("r"), F.col("n_all").alias("n"), F.col("cut.score").alias("score"), "n_left", "n_right"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
