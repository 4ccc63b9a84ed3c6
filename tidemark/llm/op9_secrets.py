"""Secret scan: fixed rules, and a character CNN over every candidate string.

Rules (fixed patterns below) give base findings; they always stay. Candidates
are all runs of ``[A-Za-z0-9+/_.-]`` of 12 characters or more, with ``=`` signs
behind, that hold a digit or an inner capital. A convolutional network in numpy reads each
candidate with its surrounding characters (a longer candidate in overlapping
windows, the highest score counts) and adds a span of kind ``cnn`` where its
calibrated probability reaches the threshold.

The network learns from labelled findings: candidates that a rule's value
overlaps are positive, all others negative. It is fitted on a bounded sample
(``SAMPLE`` findings per label, those of least hash over the whole corpus)
with each secret's surroundings blanked half of the time, so that it learns
the string and not just the key word before it. A third of the sample, by
hash, is held out. Spark then scores every distinct labelled finding of the
corpus, with and without surroundings, and counts them by label and score bin
(``BINS`` a logit): Platt scaling is fitted on these counts, at the corpus's own
ratio of labels, and the threshold is the highest that keeps ``RECALL`` of the
positives. Findings that the network was fitted on have no say of their own:
the held-out third of the sample stands for them, with their number.

Defined results: a null or empty text has no findings (0 counts, the digest
of the empty string, empty spans); repeated rows each give a row; a null id
stays null; an empty table gives an empty result; without positives or
without negatives in the corpus no network is fitted and the rules stand
alone; other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, scratch, sliced, table, text_of

# Kinds in their order, patterns, the group that is the value, and the least length of that group.
KINDS = ("assign", "access", "hex")
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
ASSIGN = re.compile(RULES["assign"][0], re.IGNORECASE | re.ASCII)
ASSIGN_KEY = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(RULES["access"][0])
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs: the shorter ones are dropped anyway
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
MIXED = re.compile(r"[0-9]|[a-z+/_.=-][A-Z]")

SAMPLE = 3000  # labelled findings per label
RECALL = 0.99
WIDTH = 40  # characters of a candidate in one window
CONTEXT = 16  # characters on either side
STEP = 24
BINS, EDGE = 64, 64  # score bins a logit, and the logit beyond which scores share a bin
EMBED, FILTERS, SPAN = 8, 24, 5
EPOCHS = 12


def base_findings(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end), by start and then kind."""
    out = []
    if ASSIGN_KEY.search(text):
        out += [(m.start(), m.end(), 0, m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2, *m.span()) for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k], vs, ve) for s, e, k, vs, ve in out]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if MIXED.search(m.group())]


_CODE = np.full(128, 1, np.int64)  # 0 padding, 1 any other character
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=- \n\"':,;()[]{}<>@#$%&*!?|"):
    _CODE[ord(_c)] = _k + 2
ALPHABET = int(_CODE.max()) + 1
LENGTH = WIDTH + 2 * CONTEXT


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of the candidate, in windows, each with its surroundings; codes + ALPHABET inside the candidate."""
    out = []
    at = start
    while True:
        stop = min(end, at + WIDTH)
        lo, hi = max(0, at - CONTEXT), min(len(text), stop + CONTEXT)
        points = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(points < 128, _CODE[np.minimum(points, 127)], 1)
        inside = np.arange(lo, hi)
        codes = codes + ALPHABET * ((inside >= start) & (inside < end))
        row = np.zeros(LENGTH, np.int64)
        first = CONTEXT - (at - lo)
        row[first:first + len(codes)] = codes
        out.append(row)
        if stop == end:
            return out
        at += STEP


class CharCNN:
    """Embedding, one convolution, ReLU, maximum over positions, logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (2 * ALPHABET, EMBED)), "conv": r.normal(0, 0.2, (SPAN * EMBED, FILTERS)),
                  "cb": np.zeros(FILTERS), "out": r.normal(0, 0.3, FILTERS), "ob": np.zeros(1)}
        self.p["emb"][0] = 0
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x):
        e = self.p["emb"][x]
        n = x.shape[1] - SPAN + 1
        cols = np.concatenate([e[:, k:k + n] for k in range(SPAN)], axis=2)
        z = cols @ self.p["conv"] + self.p["cb"]
        arg = z.argmax(axis=1)
        top = np.take_along_axis(z, arg[:, None, :], 1)[:, 0]
        return cols, arg, top, np.maximum(top, 0) @ self.p["out"] + self.p["ob"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[3] for i in range(0, len(x), 512)] or [np.empty(0)])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 128):
                k = order[i:i + 128]
                g = self._gradient(x[k], y[k], weight[k])
                step += 1
                for name, d in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v2[name] = 0.999 * v2[name] + 0.001 * d * d
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)
                self.p["emb"][0] = 0

    def _gradient(self, x, y, weight):
        cols, arg, top, z = self._forward(x)
        d = weight * (1 / (1 + np.exp(-z)) - y) / len(x)
        act = np.maximum(top, 0)
        dtop = d[:, None] * self.p["out"] * (top > 0)
        rows = np.arange(len(x))[:, None]
        used = cols[rows, arg]  # (batch, filters, SPAN * EMBED)
        dconv = np.einsum("bf,bfc->cf", dtop, used)
        dcols = dtop[:, :, None] * self.p["conv"].T[None]
        demb = np.zeros_like(self.p["emb"])
        for k in range(SPAN):
            np.add.at(demb, x[rows, arg + k], dcols[:, :, k * EMBED:(k + 1) * EMBED])
        return {"emb": demb, "conv": dconv + 1e-4 * self.p["conv"], "cb": dtop.sum(0), "out": act.T @ d + 1e-4 * self.p["out"],
                "ob": np.array([d.sum()])}

    def calibrate(self, bins: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling of counts ``n`` by score bin and label, then the highest threshold that keeps ``recall`` of the positives."""
        z = (bins + 0.5) / BINS
        positives, negatives = n[y == 1].sum(), n[y == 0].sum()
        target = np.where(y == 1, (positives + 1) / (positives + 2), 1 / (negatives + 2))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps on two parameters
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([(n * (p - target) * z).sum() + 1e-3 * (a - 1), (n * (p - target)).sum()])
            w = n * p * (1 - p)
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
        self.slope, self.offset = float(max(a, 1e-3)), float(b)
        if positives <= 0:
            self.threshold = 1.0
            return
        order = np.argsort(-bins[y == 1], kind="stable")
        kept = np.cumsum(n[y == 1][order])
        lowest = int(bins[y == 1][order][np.searchsorted(kept, recall * positives * (1 - 1e-12))])
        self.threshold = float(self.probability(np.array([lowest / BINS]))[0]) - 1e-9 if lowest > -EDGE * BINS else 0.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def score(self, found: list[list[np.ndarray]]) -> np.ndarray:
        """Calibrated probability of each candidate, given its windows."""
        if not found:
            return np.empty(0)
        firsts = np.cumsum([0, *map(len, found)])[:-1]
        return self.probability(np.maximum.reduceat(self.logits(np.stack([w for ws in found for w in ws])), firsts))


def _labelled(batches):
    for b in sliced(batches):
        rows = []
        for text in b.column("text").to_pylist():
            values = [(vs, ve) for _, _, _, vs, ve in base_findings(text)]
            for s, e in candidates(text):
                label = int(any(vs < e and s < ve for vs, ve in values))
                w = windows(text, s, e)[0]
                rows.append((zlib.crc32(w.tobytes()), label, w.astype(np.int16).tobytes()))
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))],
                                         ["h", "label", "codes"])


def _held(codes: bytes) -> bool:
    return zlib.crc32(codes) // 7 % 3 == 0


def _bins(net: CharCNN, last: dict[int, tuple[int, bytes]], fold: bool):
    """Counts by label, score bin and part: 0 beyond the sample, 1 its held-out findings, 2 those the network was fitted on."""
    def bins(batches):
        counts: Counter = Counter()
        for b in sliced(batches):
            if not b.num_rows:
                continue
            codes, labels = b.column("codes").to_pylist(), b.column("label").to_pylist()
            x = np.stack([np.frombuffer(c, np.int16) for c in codes]).astype(np.int64)
            part = [0 if (h, c) > last[y] else 1 if not fold or _held(c) else 2
                    for h, c, y in zip(b.column("h").to_pylist(), codes, labels)]
            for seen in (x, np.where(x >= ALPHABET, x, 0)):
                at = np.floor(np.clip(net.logits(seen), -EDGE, EDGE) * BINS).astype(int)
                counts.update(zip(labels, at.tolist(), part))
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         ["label", "bin", "part", "n"])
    return bins


def score_counts(found: DataFrame, net: CharCNN, last: dict[int, tuple[int, bytes]], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score bins, labels and counts of all distinct findings; the sample's held-out part also stands for the fitted one."""
    rows = (found.mapInArrow(_bins(net, last, fold), "label int, bin int, part int, n bigint")
            .groupBy("label", "bin", "part").agg(F.sum("n").alias("n")).orderBy("label", "bin", "part").collect())
    sums = {(y, k): sum(r["n"] for r in rows if (r["label"], r["part"]) == (y, k)) for y in (0, 1) for k in (1, 2)}
    weight = {(y, 0): 1.0 for y in (0, 1)} | {(y, 1): (sums[y, 1] + sums[y, 2]) / max(1, sums[y, 1]) for y in (0, 1)}
    rows = [r for r in rows if r["part"] < 2]
    return (np.array([r["bin"] for r in rows]), np.array([r["label"] for r in rows]),
            np.array([r["n"] * weight[r["label"], r["part"]] for r in rows]))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, recall: float = RECALL) -> CharCNN | None:
    """Network fitted on at most ``sample`` distinct findings of each label, those of least hash, and calibrated on all."""
    found = docs.select(text_of(text_col).alias("text")).mapInArrow(_labelled, "h bigint, label int, codes binary").distinct()
    found = saved(found, scratch(docs.sparkSession, "findings"))
    rows = [r for label in (0, 1)
            for r in found.where(F.col("label") == label).orderBy("h", "codes").limit(sample).collect()]
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r["codes"], np.int16) for r in rows]).astype(np.int64)
    held = np.array([_held(bytes(r["codes"])) for r in rows])
    fold = len(set(y[held].tolist())) == 2 and len(set(y[~held].tolist())) == 2
    if not fold:
        held = np.zeros(len(y), bool)
    net = CharCNN()
    bare = np.where(x >= ALPHABET, x, 0)
    net.fit(np.concatenate([x[~held], bare[~held]]), np.concatenate([y[~held], y[~held]]))
    last = {label: max((r["h"], bytes(r["codes"])) for r in rows if r["label"] == label) for label in (0, 1)}
    net.calibrate(*score_counts(found, net, last, fold), recall)
    return net


def _scan(net: CharCNN | None):
    def scan(batches):
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            base = [base_findings(t) for t in texts]
            added: list[list[tuple[int, int]]] = [[] for _ in texts]
            if net is not None:
                spots = [(k, s, e) for k, t in enumerate(texts) for s, e in candidates(t)]
                for i in range(0, len(spots), 4096):
                    some = spots[i:i + 4096]
                    p = net.score([windows(texts[k], s, e) for k, s, e in some])
                    for (k, s, e), q in zip(some, p):
                        if q >= net.threshold and not any(vs < e and s < ve for _, _, _, vs, ve in base[k]):
                            added[k].append((s, e))
            counts = [[sum(f[2] == kind for f in fs) for fs in base] for kind in KINDS]
            text_of_base = [",".join(f"{kind}:{s}:{e}" for s, e, kind, _, _ in fs) for fs in base]
            spans = [[(s, KINDS.index(kind), e, kind) for s, e, kind, _, _ in fs] + [(s, len(KINDS), e, "cnn") for s, e in more]
                     for fs, more in zip(base, added)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text_of_base]),
                 pa.array([",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(f)) for f in spans], pa.string()),
                 pa.array(list(map(len, added)), pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"])
    return scan


def scan(docs: DataFrame, net: CharCNN | None, id_col="doc_id", text_col="text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_scan(net), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                                       "base_sha256 string, spans string, n_cnn bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
