"""Language-model scores: a hidden Markov model over words.

Symbols are the ``CLASSES`` most frequent training tokens (the end token among
them) and one class for all others. ``STATES`` latent states are trained by
Baum-Welch: each task runs the scaled forward-backward recursion over its
sequences, Spark sums the expected counts of all tasks, and the driver turns
the sums (states * classes numbers, whatever the corpus) into new parameters.
For training alone, documents are cut into pieces of ``PIECE`` tokens, so that
a task works on many at once; every training token counts in every round.
Scores come from the scaled forward recursion over each whole text.

A word outside the classes has the probability of the class in its state
times its smoothed share in the class, (c + 0.5) / (C + 0.5 * (V + 1)), where
c is its training count, C all training tokens of the class and V its
distinct ones. So the score is the log10 probability of the text itself.

Counts of the ``HEAD`` most frequent words are broadcast (a bound, not a cap):
words beyond it are joined to the whole count table by Spark, one row per
document and distinct word. Words are identified by 64-bit hashes.

Learning takes documents whose fold (crc32 of the id, modulo 5) is not 1.
Defined results: a null or empty text is the end token alone; repeated rows
each give a row; a null id has fold 0 and stays null; without training
documents the base probabilities are uniform over one unknown word and the
parameters stay at their start; an empty table gives an empty result; other
columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, saved, scratch, sliced, table, text_of, word_batches

STATES = 8
CLASSES = 4096
HEAD = 1 << 17
ROUNDS = 6
PIECE = 512  # tokens trained together
HELD_OUT = 1
END = 0x5EED0E0D  # the end token's hash
PARTS = ("rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, head_sum double, rare_sum double, "
         "n_rare bigint, hmm double, tail array<bigint>, tail_n array<bigint>")


# ---- counts

class Tally:
    """Counts of 64-bit keys; at most about a million rows are held before they are handed on."""

    def __init__(self, limit: int = 1 << 20):
        self.parts, self.held, self.limit = [], 0, limit

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.held += len(part[0])

    def full(self) -> bool:
        return self.held > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        self.parts, self.held = [], 0
        return keys, n


def _count(batches):
    tally = Tally()

    def out(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    for b in sliced(batches):
        for _, w in word_batches(b.column("text").to_pylist(), lower=True):
            tally.add(np.append(w.hashes, np.full(len(w.first) - 1, END, np.uint64)))
            if tally.full():
                keys, n = tally.take()
                if len(keys) > tally.limit // 2:
                    yield out(keys, n)
                else:
                    tally.parts, tally.held = [(keys, n)], len(keys)
    if tally.parts:
        yield out(*tally.take())


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n of all tokens of ``docs``; summed within tasks before the shuffle."""
    return docs.select("text").mapInArrow(_count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Most frequent words (sorted hashes, counts, class of each or -1) and the corpus totals."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n_classes: int  # the class of all other words is the last one
    tokens: int
    types: int
    rare_tokens: int
    rare_types: int

    @property
    def rare(self) -> int:
        return self.n_classes - 1

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head of each hash, and whether it is there."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at, there = self.find(h)
        c = np.where(there, self.classes[at], -1)
        return np.where(c < 0, self.rare, c)


def lexicon(counts: DataFrame, classes: int = CLASSES, head: int = HEAD) -> Lexicon:
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    rows = counts.orderBy(F.desc("n"), "h").limit(head).toArrow()
    keys, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    if END not in keys.tolist():  # also where nothing is learnt from
        more = counts.where(F.col("h") == END).first()
        keys, n = np.append(keys, np.uint64(END)), np.append(n, more["n"] if more else 0)
    rank = np.arange(len(keys))
    end = int(np.flatnonzero(keys == END)[0])
    rank[end] = -1  # always a class
    chosen = np.argsort(rank, kind="stable")[:classes]
    of = np.full(len(keys), -1)
    of[chosen] = np.arange(len(chosen))
    order = np.argsort(keys)
    tokens, types = int(total["n"] or 0), int(total["v"])
    return Lexicon(keys[order], n[order], of[order], len(chosen) + 1, tokens, types,
                   tokens - int(n[chosen].sum()), max(0, types - int((n[chosen] > 0).sum())))


# ---- the model

@dataclass
class Hmm:
    start: np.ndarray  # of a text
    later: np.ndarray  # of a training piece inside a text
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @classmethod
    def initial(cls, share: np.ndarray, states: int, seed: int = 5) -> Hmm:
        r = np.random.default_rng(seed)
        emit = share[:, None] * (0.05 + r.gamma(0.5, 2.0, (len(share), states)))  # far apart, or training stands still
        move = r.uniform(0.5, 1.5, (states, states)) + 20 * np.eye(states)  # a text's next word tends to be of its kind
        even = np.full(states, 1 / states)
        return cls(even, even.copy(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def updated(self, sums: np.ndarray, share: np.ndarray) -> Hmm:
        """Parameters from expected counts, with a little of the even distribution and of the plain word shares."""
        k = len(self.start)
        start, later, move, emit = np.split(sums, [k, 2 * k, 2 * k + k * k])
        move, emit = move.reshape(k, k) + 0.1, emit.reshape(-1, k) + share[:, None]
        norm = lambda x: (x + 0.1) / (x + 0.1).sum()
        return Hmm(norm(start), norm(later), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _by_length(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the sequences from long to short, their starts, and how many are longer than each t."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0), "left")
    return order, bounds[:-1][order], active


def forward(model: Hmm, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each whole sequence, by the scaled forward recursion over all at once."""
    order, at, active = _by_length(bounds)
    alpha = np.tile(model.start, (len(order), 1))
    total = np.zeros(len(order))
    product, held = np.ones(len(order)), 0
    for t, n in enumerate(active.tolist()):
        alpha = alpha[:n]
        alpha = (alpha if t == 0 else alpha @ model.move) * model.emit[symbols[at[:n] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        product[:n] *= scale
        held += 1
        if held == 8:  # logs are dear; eight scales of 1e-30 at least stay in range
            total += np.log(product)
            product[:] = 1
            held = 0
    total += np.log(product)
    out = np.empty(len(order))
    out[order] = total
    return out


def expected_counts(model: Hmm, symbols: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Baum-Welch sums over sequences: starts, later starts, moves, emissions, in one array."""
    k = len(model.start)
    order, at, active = _by_length(bounds)
    first = first[order]
    n0, steps = len(order), active.tolist()
    alphas, scales = [], []
    alpha = np.where(first[:, None], model.start, model.later)
    for t, n in enumerate(steps):
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ model.move) * model.emit[symbols[at[:n] + t]]
        scale = alpha.sum(1, keepdims=True)
        alpha = alpha / scale
        alphas.append(alpha)
        scales.append(scale)
    move, emit = np.zeros((k, k)), np.zeros((len(model.emit), k))
    beta = np.ones((0, k))
    gamma_all, symbol_all = [], []
    for t in range(len(steps) - 1, -1, -1):
        n, later = steps[t], len(beta)
        if later:
            x = beta * model.emit[symbols[at[:later] + t + 1]] / scales[t + 1]
            move += alphas[t][:later].T @ x
            now = np.ones((n, k))
            now[:later] = x @ model.move.T
            beta = now
        else:
            beta = np.ones((n, k))
        gamma_all.append(alphas[t] * beta)
        symbol_all.append(symbols[at[:n] + t])
    gamma, symbol = np.concatenate(gamma_all), np.concatenate(symbol_all)
    for s in range(k):
        emit[:, s] = np.bincount(symbol, gamma[:, s], len(emit))
    g0 = gamma_all[-1]
    return np.concatenate([g0[first[:n0]].sum(0), g0[~first[:n0]].sum(0), (move * model.move).ravel(), emit.ravel()])


def _encode(lex):
    def encode(batches):
        lx = lex.value
        for b in sliced(batches):
            out = []
            for _, w in word_batches(b.column("text").to_pylist(), lower=True):
                s, end = lx.symbols(w.hashes).astype(np.uint16), lx.symbols(np.array([END], np.uint64)).astype(np.uint16)
                out += [np.append(s[w.first[d]:w.first[d + 1]], end).tobytes() for d in range(len(w.first) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["symbols"])
    return encode


def _expect(model):
    def expect(batches):
        m, total = model.value, None
        for b in batches:
            rows, held = [], 0
            for raw in [*b.column("symbols").to_pylist(), None]:
                if raw is not None:
                    rows.append(raw)
                    held += len(raw)
                if rows and (raw is None or held > 1 << 21):
                    size = np.fromiter(map(len, rows), np.int64, len(rows)) // 2
                    pieces = -(-size // PIECE)
                    ends = np.cumsum(size)
                    first = np.zeros(int(pieces.sum()), bool)
                    first[np.cumsum(pieces) - pieces] = True
                    number = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    starts = np.repeat(ends - size, pieces) + number * PIECE
                    got = expected_counts(m, np.frombuffer(b"".join(rows), np.uint16), np.append(starts, ends[-1]), first)
                    total = got if total is None else total + got
                    rows, held = [], 0
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])
    return expect


def train(spark: SparkSession, docs: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over the texts of ``docs``; symbols are stored once and read in each round."""
    sc = spark.sparkContext
    shared = sc.broadcast(lex)
    sequences = saved(docs.select("text").mapInArrow(_encode(shared), "symbols binary"), scratch(spark, "hmm-symbols"))
    share = np.zeros(lex.n_classes)
    at = lex.classes >= 0
    share[lex.classes[at]] = lex.counts[at]
    share[lex.rare] = lex.rare_tokens
    share = (share + 0.5) / (share + 0.5).sum()
    model = Hmm.initial(share, states)
    for _ in range(rounds):
        given = sc.broadcast(model)
        rows = (sequences.mapInArrow(_expect(given), "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
                .toArrow())
        given.unpersist()
        if not rows.num_rows:
            break
        sums = np.zeros(2 * states + states * states + states * lex.n_classes)
        sums[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
        model = model.updated(sums, share)
    shared.unpersist()
    return model


# ---- scores

def _parts(lex, model):
    def parts(batches):
        lx, m = lex.value, model.value
        logs = np.log10(lx.counts + 0.5)
        end_at = int(lx.find(np.array([END], np.uint64))[0][0])
        rid = TaskContext.get().partitionId() << 34
        for b in sliced(batches):
            ids, held = b.column("doc_id"), b.column("held_out")
            for first, w in word_batches(b.column("text").to_pylist(), lower=True):
                docs = len(w.first) - 1
                at, there = lx.find(w.hashes)
                kind = np.where(there, lx.classes[at], -1)
                symbol = np.insert(np.where(kind < 0, lx.rare, kind), w.first[1:], lx.classes[end_at])
                bounds = w.first + np.arange(docs + 1)
                over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
                head = np.where(there, logs[at], 0.0)
                sums = over(head) + logs[end_at]
                rare_sums = over(np.where(kind < 0, head, 0.0))
                tails, tail_n = [], []
                for d in range(docs):
                    s = slice(w.first[d], w.first[d + 1])
                    h, n = np.unique(w.hashes[s][~there[s]], return_counts=True)
                    tails.append(h.view(np.int64))
                    tail_n.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + docs)), ids.slice(first, docs), held.slice(first, docs),
                     pa.array(np.diff(bounds)), pa.array(over(there) + int(lx.counts[end_at] > 0)), pa.array(sums),
                     pa.array(rare_sums), pa.array(over(kind < 0)),
                     pa.array(forward(m, symbol, bounds) / math.log(10)),
                     pa.array(tails, pa.list_(pa.int64())), pa.array(tail_n, pa.list_(pa.int64()))],
                    ["rid", "doc_id", "held_out", "n_tokens", "known", "head_sum", "rare_sum", "n_rare", "hmm", "tail", "tail_n"])
                rid += docs
    return parts


def score(docs: DataFrame, lex: Lexicon, model: Hmm, counts: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    parts = saved(docs.mapInArrow(_parts(sc.broadcast(lex), sc.broadcast(model)), PARTS), scratch(spark, "hmm-parts"))
    tail = parts.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("rid", "t.tail", "t.tail_n")
    c = F.coalesce(F.col("n"), F.lit(0))
    beyond = (tail.join(counts, F.col("tail") == F.col("h"), "left").groupBy("rid")
              .agg(F.sum(F.col("tail_n") * F.log10(c + 0.5)).alias("tail_sum"),
                   F.sum(F.when(c > 0, F.col("tail_n")).otherwise(0)).alias("tail_known")))
    whole = math.log10(lex.tokens + 0.5 * (lex.types + 1))
    rare = math.log10(lex.rare_tokens + 0.5 * (lex.rare_types + 1))
    rest = F.coalesce(F.col("tail_sum"), F.lit(0.0))
    return (parts.drop("tail", "tail_n").join(beyond, "rid", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                    F.lit(lex.tokens).cast("bigint").alias("train_tokens"),
                    (F.col("head_sum") + rest - F.col("n_tokens") * whole).alias("base_score"),
                    (F.col("hmm") + F.col("rare_sum") + rest - F.col("n_rare") * rare).alias("score")))


def language_model(docs: DataFrame, id_col="doc_id", text_col="text", states: int = STATES, classes: int = CLASSES,
                   head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("held_out", fold_of() == HELD_OUT)
    learned = rows.where(~F.col("held_out"))
    counts = saved(word_counts(learned), scratch(spark, "word-counts"))
    lex = lexicon(counts, classes, head)
    return score(rows, lex, train(spark, learned, lex, states, rounds), counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))
