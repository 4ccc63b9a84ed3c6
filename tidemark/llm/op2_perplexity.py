"""Quality rules: n-gram perplexity in bands per language, beside fixed base rules.

The model of a language has order 4 over the bytes of the text's UTF-8, each a
symbol of its own (``BYTES``). Four of them pack without collision into 32 bits,
and Spark sums the counts of all 4-grams of all texts. Their modified
Kneser-Ney probabilities are interpolated with those of a model of the same
kind over 64 classes of bytes (``CLASS``: letters without case, white space,
punctuation groups, groups of non-ASCII bytes), times the share of the byte in
its class: what a 4-gram leaves open is decided by its classes. The model of the
classes comes from the same counts, folded. Both are stored as sorted arrays of
hashes with their log probabilities, and looked up by binary search. Models
reach the tasks in groups of languages of at most ``GROUP_BYTES``; each group
scores the rows of its languages. A language of more than ``STRETCH`` 4-grams
has a model in stretches of contexts, each in a group of its own; the sums of
its texts over the stretches meet by a digest of the text.

A document's log perplexity is the mean surprise of its symbols in bits
(``log_ppl``), beside that of their classes alone (``class_ppl``), which tells
the shape of a text: symbol spam and loops repeat a shape with ever new symbols.
For each of the two, per language, over all documents that pass the base rules,
each side of the median has a spread of its own: the distance to the quartile on
that side, as standard deviations (``FLOOR`` bits at least). The band reaches
from ``LOWER`` spreads below the median to ``UPPER`` above it; all come from a
histogram in steps of ``STEP`` bits. A document outside either band of its
language is rejected: above it is noise or table junk, below it is a loop, symbol
spam or filler. Fluent text that quotes another language lies above the median
too; the README has the share of well-labelled documents that this costs.

Defined results: a null text is empty; empty texts have no words and fail the
base rules; null languages form one language of their own; repeated rows each
give a row; a null id stays null; an empty table gives an empty result; other
columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, mix, saved, scratch, sliced, table, text_of, word_batches

ORDER = 4
LOWER, UPPER = 3.75, 3.25  # spreads below and above the median
QUARTILE = 0.6745  # of a normal distribution, in standard deviations
FLOOR = 0.01  # bits
STEP = 0.002  # bits
GROUP_BYTES = 256 << 20
STRETCH = 1 << 23  # 4-grams of bytes in one model
SYMBOLS = b"#*$%&|<>"
SCORED = ("doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, log_ppl double, class_ppl double")
PARTS = "lang string, digest binary, part int, bits double, class_bits double"


def _classes() -> np.ndarray:
    out = np.full(256, 38, np.int32)
    for members, c in ((b"0123456789", 27), (b" \t\r\x0b\x0c", 28), (b"\n", 29), (b".", 30), (b",", 31), (b"-", 32),
                       (b"'\"`", 33), (b"!?;:", 34), (b"()[]{}", 35), (SYMBOLS, 36), (b"/\\_=+@~^", 37)):
        out[list(members)] = c
    letters = np.arange(26)
    out[65 + letters] = out[97 + letters] = 1 + letters
    out[128:192] = 39 + np.arange(64) // 6
    out[194], out[195] = 50, 51
    out[196:256] = 52 + np.arange(60) // 5
    return out


CLASS = _classes()  # 0 is the boundary of a text
BYTES = np.arange(256, dtype=np.uint32)  # 0 is the boundary here too
BYTES[0] = 255  # a byte that UTF-8 never has
CLASS_OF = np.concatenate([[0], CLASS[1:255], CLASS[:1]]).astype(np.int32)  # of the symbols in BYTES


def grams(raw: list[bytes], of: np.ndarray = CLASS, bits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 4-grams of the texts, one per byte and one for the end, and the bounds of each text."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    c = of[np.frombuffer(b"\n\n\n" + b"".join(r + b"\n\n\n" for r in raw), np.uint8)]
    ends = np.cumsum(sizes + 3)  # of each text's windows; in the symbols, the text ends there too
    c[:3] = 0
    for k in range(3):
        c[ends + k] = 0
    h = (c[:-3] << 3 * bits) | (c[1:-2] << 2 * bits) | (c[2:-1] << bits) | c[3:]
    keep = np.ones(len(h), bool)
    keep[ends - 1] = keep[ends - 2] = False  # windows that end on the second or third boundary behind a text
    return h[keep], np.concatenate([[0], np.cumsum(sizes + 1)])


def class_grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the classes of 4-grams of bytes."""
    out = CLASS_OF[h >> 24]
    for k in (16, 8, 0):
        out = (out << 6) | CLASS_OF[(h >> k) & 255]
    return out


class Counts:
    """Counts of hashes of one language in one task."""

    def __init__(self):
        self.parts, self.held = [], 0

    @property
    def full(self) -> bool:
        """So many hashes that holding them back saves little."""
        return len(self.parts) == 1 and self.held > 1 << 20

    def add(self, h: np.ndarray, n: np.ndarray | None = None) -> None:
        part = np.unique(h, return_counts=True) if n is None else (h, n)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > 1 << 21:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([p[1] for p in self.parts])).astype(np.int64)


def _chunks(texts, langs, size=1 << 21):
    """(language, raw texts, their rows) of about ``size`` bytes."""
    for lang in dict.fromkeys(langs):
        raw, rows, held = [], [], 0
        for k, (t, g) in enumerate(zip(texts, langs)):
            if g == lang:
                raw.append(t.encode("utf-8", "surrogatepass"))
                rows.append(k)
                held += len(raw[-1])
                if held >= size:
                    yield lang, raw, rows
                    raw, rows, held = [], [], 0
        if raw:
            yield lang, raw, rows


def _summed(parts):
    """Batches of the (language, hashes, counts) that a task has, summed as far as memory goes."""
    of: dict[str, Counts] = {}

    def batch(lang):
        keys, n = of.pop(lang).total()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)),
                                           pa.array(n, pa.int64())], ["lang", "gram", "n"])
    for lang, h, n in parts:
        counts = of.setdefault(lang, Counts())
        counts.add(h, n)
        if counts.full:
            yield batch(lang)
    yield from map(batch, list(of))


def _count(batches):
    return _summed((lang, grams(raw, BYTES, 8)[0], None) for b in sliced(batches)
                   for lang, raw, _ in _chunks(b.column("text").to_pylist(), b.column("lang").to_pylist()))


def _fold(batches):
    def parts():
        for b in batches:
            langs = b.column("lang").to_numpy(zero_copy_only=False)
            h, n = class_grams(b.column("gram").to_numpy()), b.column("n").to_numpy()
            for lang in dict.fromkeys(langs):
                yield lang, h[langs == lang], n[langs == lang]
    return _summed(parts())


COUNTED = "lang string, gram bigint, n bigint"


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (of bytes), n over all texts; summed within tasks before the shuffle."""
    return docs.select("lang", "text").mapInArrow(_count, COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def class_counts(counts: DataFrame) -> DataFrame:
    """lang, gram (of classes), n: at most 64**4 rows per language."""
    return counts.mapInArrow(_fold, COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more."""
    return discounts_of(*(int((n == k).sum()) for k in (1, 2, 3, 4)))


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The same by the numbers of counts 1 to 4."""
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.1, 0.1], [0, 0.95, 1.9, 2.9])


def interpolate(keys: np.ndarray, n: np.ndarray, lower: np.ndarray, order: int):
    """Probabilities of the seen n-grams, and each context's weight of the lower order (1 if unseen)."""
    d = discounts(n)
    context = keys >> 6
    total = np.bincount(context, n, 64 ** (order - 1))
    held = np.bincount(context, d[np.minimum(n, 3)], 64 ** (order - 1))
    weight = np.where(total > 0, held / np.maximum(total, 1), 1.0)
    p = (n - d[np.minimum(n, 3)]) / total[context] + weight[context] * lower[keys & (64 ** (order - 1) - 1)]
    return p, weight


def continuation(keys: np.ndarray, n: np.ndarray, order: int):
    """Counts of the next lower order: distinct predecessors, or plain counts after a text's boundary."""
    low = keys & (64 ** (order - 1) - 1)
    size = 64 ** (order - 1)
    plain, kinds = np.bincount(low, n, size), np.bincount(low, minlength=size)
    out = np.where(np.arange(size) < 64 ** (order - 2), plain, kinds).astype(np.int64)
    seen = np.flatnonzero(out)
    return seen, out[seen]


class Model:
    """Sorted hashes of the seen 4-grams with log2 probabilities; backing-off tables for the rest."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        levels = [(keys.astype(np.int64), n)]
        for order in (4, 3, 2):
            levels.append(continuation(*levels[-1], order))
        lower = np.full(1, 1 / 64)
        for order, (k, c) in zip((1, 2, 3), reversed(levels[1:])):
            p, weight = interpolate(k, c, lower, order)
            every = np.arange(64**order)
            lower = weight[every >> 6] * lower[every & (64 ** (order - 1) - 1)]
            lower[k] = p
        p, weight = interpolate(*levels[0], lower, 4)
        self.keys, self.logs = keys.astype(np.int32), np.log2(p).astype(np.float32)
        self.low, self.back = np.log2(lower).astype(np.float32), np.log2(np.maximum(weight, 1e-9)).astype(np.float32)

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.logs, self.low, self.back))

    def logs_of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.logs[at], self.back[h >> 6] + self.low[h & (64**3 - 1)])


def members(n: np.ndarray) -> np.ndarray:
    """log2 of the share of each symbol in its class, by its count and one."""
    return np.log2((n + 1) / np.bincount(CLASS_OF, n + 1, 64)[CLASS_OF])


class Bytes:
    """Sorted 4-grams of bytes (those from ``low`` to before ``high``) with log2 probabilities; classes for the rest."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, d: np.ndarray, classes: Model, shares: np.ndarray,
                 low: int = 0, high: int = 1 << 32):
        self.classes, self.shares, self.low, self.high = classes, shares, low, high
        self.keys = keys.astype(np.uint32)
        self.contexts, first, sizes = np.unique(self.keys >> 8, return_index=True, return_counts=True)
        off = d[np.minimum(n, 3)]
        total = np.add.reduceat(n, first)
        weight = np.add.reduceat(off, first) / total
        self.shape = classes.logs_of(class_grams(self.keys)).astype(np.float32)
        lower = np.exp2(self.shape.astype(np.float64) + shares[self.keys & 255])
        p = (n - off) / np.repeat(total, sizes) + np.repeat(weight, sizes) * lower
        self.logs, self.back = np.log2(p).astype(np.float32), np.log2(np.maximum(weight, 1e-9)).astype(np.float32)

    @property
    def size(self) -> int:
        return self.classes.size + sum(a.nbytes for a in (self.keys, self.logs, self.shape, self.contexts, self.back))

    def logs_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 probabilities of 4-grams, and of their classes alone."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        out, shape = self.logs[at], self.shape[at]
        if len(new := np.flatnonzero(self.keys[at] != h)):
            h = h[new]
            shape[new] = self.classes.logs_of(class_grams(h))
            at = np.minimum(np.searchsorted(self.contexts, h >> 8), len(self.contexts) - 1)
            out[new] = np.where(self.contexts[at] == h >> 8, self.back[at], 0) + shape[new] + self.shares[h & 255]
        return out, shape

    def sums(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Surprise in bits of each text, its end included, and of its classes, over this stretch; its symbols."""
        h, bounds = grams(raw, BYTES, 8)
        whole = (self.low, self.high) == (0, 1 << 32)
        here = None if whole else (h >= self.low) & (h < self.high)
        if not whole:
            h = h[here]

        def total(logs):
            if whole:
                return -np.add.reduceat(logs.astype(np.float64), bounds[:-1])
            out = np.zeros(len(here))
            out[here] = logs
            return -np.add.reduceat(out, bounds[:-1])
        return *map(total, self.logs_of(h)), np.diff(bounds)


def stretches(counts: DataFrame, rows: int, stretch: int) -> list[tuple[int, int]]:
    """Bounds of 4-grams with about ``stretch`` rows each in between; a context is never cut."""
    if rows <= stretch:
        return [(0, 1 << 32)]
    lead = F.shiftright("gram", 16).alias("lead")
    cuts, held = [0], 0
    for r in counts.groupBy(lead).count().orderBy("lead").collect():
        if held and held + r["count"] > stretch:
            cuts.append(r["lead"] << 16)
            held = 0
        held += r["count"]
    return list(zip(cuts, [*cuts[1:], 1 << 32]))


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their counts."""
    got = counts.select("gram", "n").toArrow()
    keys, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def model_groups(counts: DataFrame, folded: DataFrame, group_bytes: int, stretch: int):
    """Models of all languages, in groups of bounded size, with None; models of a stretch of a language, with its number."""
    group, size = {}, 0
    ends: dict[str, np.ndarray] = {}
    for r in counts.groupBy("lang", F.expr("gram & 255").alias("symbol")).agg(F.sum("n").alias("n")).collect():
        ends.setdefault(r["lang"], np.zeros(256))[r["symbol"]] = r["n"]
    few = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    for r in counts.groupBy("lang").agg(F.count("*").alias("rows"), *few).orderBy("lang").collect():
        lang, mine = r["lang"], counts.where(F.col("lang") == r["lang"])
        classes, d = Model(*_arrays(folded.where(F.col("lang") == lang))), discounts_of(*(r[f"n{k}"] for k in (1, 2, 3, 4)))
        bounds = stretches(mine, r["rows"], stretch)
        for k, (low, high) in enumerate(bounds):
            some = mine.where((F.col("gram") >= low) & (F.col("gram") < high))
            model = Bytes(*_arrays(some), d, classes, members(ends[lang]), low, high)
            if len(bounds) > 1:
                yield {lang: model}, k
                continue
            if group and size + model.size > group_bytes:
                yield group, None
                group, size = {}, 0
            group[lang] = model
            size += model.size
    if group:
        yield group, None


def repeated_words(w: Words) -> np.ndarray:
    """Per text, the words inside 3-word windows that the text holds twice or more."""
    n, h = len(w), w.hashes
    if n < 3:
        return np.zeros(len(w.first) - 1, np.int64)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    three = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) ^ mix(text[:-2].astype(np.uint64) + np.uint64(1))
    whole = text[:-2] == text[2:]
    _, back, n_of = np.unique(three[whole], return_inverse=True, return_counts=True)
    again = np.zeros(n, bool)
    at = np.flatnonzero(whole)[n_of[back] >= 2]
    for k in range(3):
        again[at + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(again)])[w.first])


def repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    lines = [x for x in lines if x.encode("utf-8", "surrogatepass").split()]
    return len(lines) - len(set(lines))


def base_columns(texts: list[str]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    columns = []
    for first, w in word_batches(texts):
        k = len(w.first) - 1
        some = texts[first:first + k]
        in_words = np.diff(np.concatenate([[0], np.cumsum(w.ends - w.starts)])[w.first])
        sizes = np.diff(w.text_starts) - 1
        chars = np.fromiter(map(len, some), np.int64, k) - (sizes - in_words)
        symbols = [len(r) - len(r.translate(None, SYMBOLS)) for r in (t.encode("utf-8", "surrogatepass") for t in some)]
        columns.append((np.diff(w.first), chars, np.array(symbols), np.array([repeated_lines(t) for t in some]), repeated_words(w)))
    return [np.concatenate(c).astype(np.int64) for c in zip(*columns)] if columns else [np.zeros(0, np.int64)] * 5


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


BASE = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _base(b: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
    base = base_columns(texts)
    return [b.column("doc_id"), b.column("lang"), *map(pa.array, base), pa.array(base_failed(base[0], base[4]))]


def _score(models):
    def score(batches):
        for b in sliced(batches):
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            bits = np.zeros((2, len(texts)))
            for lang, raw, rows in _chunks(texts, langs):
                *sums, n = models[lang].sums(raw)
                bits[:, rows] = sums / n
            yield pa.RecordBatch.from_arrays([*_base(b, texts), *map(pa.array, bits)], [*BASE, "log_ppl", "class_ppl"])
    return score


def _digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def _score_part(models, part):
    """Sums of one stretch by text."""
    def score(batches):
        for b in sliced(batches):
            for lang, raw, _ in _chunks(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                *sums, n = models[lang].sums(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array([_digest(r) for r in raw], pa.binary()), pa.array([part] * len(n), pa.int32()),
                     *map(pa.array, sums)], ["lang", "digest", "part", "bits", "class_bits"])
    return score


def _base_by_text(batches):
    for b in sliced(batches):
        texts = b.column("text").to_pylist()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        yield pa.RecordBatch.from_arrays([*_base(b, texts), pa.array([_digest(r) for r in raw], pa.binary()),
                                          pa.array([len(r) + 1 for r in raw], pa.int64())], [*BASE, "digest", "size"])


def joined_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of languages in stretches, with the sums over all stretches of their texts."""
    sums = (parts.dropDuplicates(["lang", "digest", "part"]).groupBy("lang", "digest")
            .agg(F.sum("bits").alias("bits"), F.sum("class_bits").alias("class_bits")))
    schema = SCORED[:SCORED.index(", log_ppl")] + ", digest binary, size bigint"
    return (rows.mapInArrow(_base_by_text, schema).join(sums, ["lang", "digest"], "left")
            .select(*BASE, (F.col("bits") / F.col("size")).alias("log_ppl"), (F.col("class_bits") / F.col("size")).alias("class_ppl")))


def scored(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", group_bytes: int = GROUP_BYTES,
           stretch: int = STRETCH) -> DataFrame:
    """Base columns and log perplexities of every row, stored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"),
                       F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    counts = saved(gram_counts(rows), scratch(spark, "gram-counts"))
    folded = saved(class_counts(counts), scratch(spark, "class-counts"))
    out = spark.createDataFrame([], SCORED)
    path, parts, split = scratch(spark, "perplexity"), scratch(spark, "perplexity-parts"), {}
    out.write.parquet(path)
    for models, k in model_groups(counts, folded, group_bytes, stretch):
        shared = spark.sparkContext.broadcast(models)
        some = rows.where(F.col("lang").isin(list(models)))
        if k is None:
            some.mapInArrow(lambda it, m=shared: _score(m.value)(it), SCORED).write.mode("append").parquet(path)
        else:
            some.mapInArrow(lambda it, m=shared, k=k: _score_part(m.value, k)(it), PARTS).write.mode("append").parquet(parts)
            split |= dict.fromkeys(models)
        shared.unpersist()
    if split:
        some = rows.where(F.col("lang").isin(list(split)))
        joined_parts(some, spark.read.schema(PARTS).parquet(parts)).write.mode("append").parquet(path)
    return spark.read.schema(SCORED).parquet(path)


def bands(rows: DataFrame, lower: float = LOWER, upper: float = UPPER, floor: float = FLOOR,
          column: str = "log_ppl") -> dict[str, tuple[float, float]]:
    """Lower and upper log perplexity by language, from all rows that pass the base rules."""
    step = F.floor(F.col(column) / STEP)
    bins = rows.where("NOT base_failed").groupBy("lang", step.alias("bin")).count().collect()
    out = {}
    for lang in {r["lang"] for r in bins}:
        of = sorted((r["bin"], r["count"]) for r in bins if r["lang"] == lang)
        value = (np.array([x for x, _ in of]) + 0.5) * STEP
        below = np.cumsum([c for _, c in of])
        low, mid, high = (float(value[np.searchsorted(below, q * below[-1])]) for q in (0.25, 0.5, 0.75))
        out[lang] = (mid - lower * max((mid - low) / QUARTILE, floor), mid + upper * max((high - mid) / QUARTILE, floor))
    return out


def verdicts(docs: DataFrame, below: float = LOWER, above: float = UPPER, **columns) -> DataFrame:
    rows = scored(docs, **columns)
    inside = F.lit(True)
    for column, prefix in (("log_ppl", ""), ("class_ppl", "class_")):
        lower = upper = F.lit(None).cast("double")
        for lang, (lo, hi) in bands(rows, below, above, column=column).items():
            lower = F.when(F.col("lang") == lang, lo).otherwise(lower)
            upper = F.when(F.col("lang") == lang, hi).otherwise(upper)
        rows = rows.withColumn(f"{prefix}lower", lower).withColumn(f"{prefix}upper", upper)
        inside &= F.coalesce(F.col(column).between(F.col(f"{prefix}lower"), F.col(f"{prefix}upper")), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
