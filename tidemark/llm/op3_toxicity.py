"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are the words it holds (runs of letters, lower case) and
their first 3 to 6 letters, which carry a stem over its endings. The model is
a logistic regression over the ``FEATURES`` most telling ones (chi-square of at
least ``TELLING``). For every
labelled text that mentions an identity term, the same text with that term
swapped for others of its group (``IDENTITY``) is a counterfactual, and the
loss adds ``PENALTY`` times the squared change of the score's logit: what
group is mentioned must not move the score, so neutral mentions raise no
false alarm.

Learning uses a bounded sample: at most ``SAMPLE`` labelled documents outside
fold 0, those of least hash of the id. Feature counts are aggregated by
Spark; the driver gets ``FEATURES`` names and the sample's feature numbers.
Scoring covers every whole text.

Defined results: a null, empty or wordless text gets the model's prior;
repeated rows each give a row; a null id is in fold 0 (held out, never
learned from) and stays null; several labels of one document count as toxic
if one is; null labels are no labels; an empty table gives an empty result,
and without labels of both kinds every score is the share of toxic labels
(0 if there are none); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, sliced, table, text_of

SAMPLE = 20_000  # labelled documents
FEATURES = 4096
TELLING = 20.0  # least chi-square of a feature with the label
PENALTY = 2.0
RIDGE = 1e-3
SWAPS = 3  # counterfactuals per mentioned term
WORD = re.compile(r"[^\W\d_]+")

# Identity terms by group, language by language.
IDENTITY = {
    "faith": "muslim christian jewish hindu buddhist atheist catholic muslime christ jude musulman chrétien juif musulmán cristiano judío",
    "origin": "african asian european arab mexican american indian afrikaner asiate europäer africain asiatique européen africano asiático europeo",
    "colour": "black white brown schwarz weiß noir blanc negro blanco",
    "gender": "women men woman man girls boys frauen männer femmes hommes mujeres hombres",
    "love": "gay lesbian straight bisexual homosexual heterosexual schwul lesbisch homosexuel homosexuelle lesbiana",
    "body": "disabled blind deaf autistic behindert gehörlos handicapé aveugle sourd discapacitado ciego sordo",
    "standing": "immigrant refugee native citizen einwanderer flüchtling immigré réfugié inmigrante refugiado",
    "age": "old young elderly teenage alt jung vieux jeune viejo joven",
}
GROUP = {term: group for group, terms in IDENTITY.items() for term in terms.split()}


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "-" for k in range(3, 7) if len(word) > k))


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swaps(words: set[str], per_term: int = SWAPS) -> list[set[str]]:
    """The text's words with one identity term swapped for others of its group."""
    out = []
    for term in sorted(words & GROUP.keys()):
        peers = [t for t in IDENTITY[GROUP[term]].split() if t != term]
        at = sum(map(ord, term)) % len(peers)
        out += [(words - {term}) | {peers[(at + j) % len(peers)]} for j in range(min(per_term, len(peers)))]
    return out


class Vocabulary(dict):
    """Numbers of the model's features that a word carries; words met are kept, up to a bound."""

    LIMIT = 1 << 17

    def __init__(self, features: list[str]):
        super().__init__()
        self.number = {f: k for k, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = tuple(self.number[f] for f in word_features(word) if f in self.number)
        return got

    def of(self, words: set[str]) -> list[int]:
        return sorted({k for w in words for k in self[w]})


class Rows:
    """Sparse 0/1 rows: logits and their gradient."""

    def __init__(self, rows: list[list[int]]):
        self.size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.flat = np.fromiter((k for r in rows for k in r), np.int64, int(self.size.sum()))
        self.row = np.repeat(np.arange(len(rows)), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self.size))

    def back(self, d: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.flat, d[self.row], n)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class ToxicityModel:
    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, texts: list[str | None], vocabulary: Vocabulary | None = None) -> np.ndarray:
        v = vocabulary if vocabulary is not None else Vocabulary(self.features)
        return sigmoid(np.array([self.weights[v.of(distinct_words(t))].sum() for t in texts], np.float64) + self.bias)


def train(features: list[str], rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]],
          penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 400, rate: float = 0.05) -> ToxicityModel:
    """Adam on mean log loss + ridge + penalty * mean squared logit change over (text, counterfactual) pairs."""
    n, y = len(features), labels.astype(np.float64)
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return ToxicityModel([], np.zeros(0), float(np.log(share / (1 - share))) if 0 < share < 1 else (35.0 if share else -35.0))
    x, a, b = Rows(rows), Rows([p for p, _ in pairs]), Rows([q for _, q in pairs])
    w = np.zeros(n + 1)
    w[n] = np.log(share / (1 - share))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        d = (sigmoid(x.dot(w) + w[n]) - y) / len(y)
        g = np.append(x.back(d, n) + ridge * w[:n], d.sum())
        if pairs:
            change = (a.dot(w) - b.dot(w)) * (2 * penalty / len(pairs))
            g[:n] += a.back(change, n) - b.back(change, n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return ToxicityModel(features, w[:n], float(w[n]))


def _count_features(batches):
    toxic, clean = Counter(), Counter()

    def out():
        keys = list(toxic.keys() | clean.keys())
        got = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[x] for x in keys], pa.int64()),
                                          pa.array([clean[x] for x in keys], pa.int64())], ["feature", "t", "c"])
        toxic.clear()
        clean.clear()
        return got

    for b in sliced(batches):
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            (toxic if label else clean).update({f for w in distinct_words(text) for f in word_features(w)})
            if len(toxic) + len(clean) > 1 << 17:  # what is held does not grow with the task
                yield out()
    yield out()


def _number(features):
    def number(batches):
        v = Vocabulary(features)
        for b in sliced(batches):
            words = [distinct_words(t) for t in b.column("text").to_pylist()]
            other = [[v.of(s) for s in swaps(ws)] for ws in words]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array(list(map(v.of, words)), pa.list_(pa.int32())),
                 pa.array(other, pa.list_(pa.list_(pa.int32())))], ["toxic", "x", "swapped"])
    return number


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
        sample: int = SAMPLE, features: int = FEATURES, penalty: float = PENALTY) -> ToxicityModel:
    """Model learned from at most ``sample`` labelled documents outside fold 0."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(fold_of() != 0))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # The sample's size is its parameter: at most ``sample`` pairs of numbers are broadcast.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    total = rows.groupBy("toxic").count().collect()
    n1 = sum(r["count"] for r in total if r["toxic"])
    n0 = sum(r["count"] for r in total if not r["toxic"])
    if not n1 or not n0:
        return train([], [], np.array([1.0] * min(n1, 1) + [0.0] * min(n0, 1)), [])
    counts = (rows.mapInArrow(_count_features, "feature string, t bigint, c bigint")
              .groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    rate = (F.col("t") + F.col("c")) / F.lit(float(n1 + n0))
    chi = (F.col("t") - rate * n1) ** 2 / (rate * (1 - rate) * n1 * n0 / (n1 + n0) + 1e-12)
    identity = F.col("feature").isin(sorted(GROUP))
    best = (counts.withColumn("chi", chi).where((F.col("t") + F.col("c") >= 5) & (F.col("chi") >= TELLING) | identity)
            .orderBy(identity.desc(), F.desc("chi"), "feature").limit(features).select("feature").collect())
    names = [r["feature"] for r in best]
    got = rows.mapInArrow(_number(names), "toxic int, x array<int>, swapped array<array<int>>").collect()
    pairs = [(r["x"], s) for r in got for s in r["swapped"]]
    return train(names, [r["x"] for r in got], np.array([r["toxic"] for r in got]), pairs, penalty)


def _score(model):
    def score(batches):
        v = Vocabulary(model.features)
        for b in sliced(batches):
            s = model.scores(b.column("text").to_pylist(), v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s),
                                              pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return score


def score(docs: DataFrame, model: ToxicityModel, id_col="doc_id", text_col="text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("held_out", fold_of() == 0)
    return rows.mapInArrow(_score(model), "doc_id bigint, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model does not call toxic."""
    def keep(batches):
        v = Vocabulary(model.features)
        for b in sliced(batches):
            yield b.filter(pa.array(model.scores(b.column(text_col).to_pylist(), v) < 0.5, pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
