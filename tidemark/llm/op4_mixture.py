"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked to three marginals: source, language and topic. A
document of cell (s, l, t) is kept with probability ``min(1, a_s * b_l *
c_t)``; ``ROUNDS`` rounds scale a, then b, then c so that the expected tokens
of every source, language and topic meet their targets. A target is the
corpus share to the power ``POWER`` (small groups gain), normalised, times
``RATE`` of all tokens; shares can also be given.

Tempered targets of scarce groups can exceed their tokens. With a
``tolerance`` (the pipeline's ``mixing``) the targets are first filled like
water: no group's exceeds its tokens, what is missing goes to the others of its
marginal in proportion, and all three marginals sum alike; where groups that are
taken whole force more tokens of another group than its target, that target is
raised and the marginal filled anew. Groups taken whole have probability 1, the
rest is raked around them until no source, language or topic misses its target
by more than the tolerance (a share of the target), or ``MOST`` rounds are over
or bring no more, which is warned of. Without a tolerance (the query ``op4_mixture``, whose SQL
has this form) targets stay as they are for ``ROUNDS`` rounds: scarce groups
then end below their targets, and so do the others of the marginals raked first.

The corpus is reduced to its cells once. One row per source holds that
source's cells (languages * topics at most); a source's factor is computed
where its row is, from the language and topic factors of all rounds so far.
The driver only ever holds the language and topic vectors, so the number of
sources and documents is free.

A document is selected where a hash of its id and ``SALT``, as a number in
[0, 1), lies below its probability: the same documents come out on every run
and for every partitioning.

Defined results: null source and language are the empty name; a null text has
no tokens, and a cell without tokens keeps the probability its factors give;
a null id hashes as the empty text; repeated rows are selected together; an
empty table gives an empty result; other columns are ignored (``sample``
keeps them).
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, scratch, table, text_of

POWER = 0.7
RATE = 0.6
ROUNDS = 6
TOLERANCE = 1e-3  # share of a target
MOST = 200  # rounds with a tolerance
WHOLE = 1e12  # factor of a group that is taken whole
KEPT = 8  # rounds whose factors are carried before the sources' are stored
SALT = "mixture"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """Fixed rule: what a text is made of."""
    return (F.when(text.contains(" | "), "table").when(text.contains("***") | text.contains("%%%"), "markup")
            .when(text.contains("@"), "contact").otherwise("prose"))


def keyed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> list[Column]:
    text = text_of(text_col)
    return [F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
            F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), topic_of(text).alias("topic"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_tokens")]


def draw(id_col: Column) -> Column:
    """52 bits of md5 as a number in [0, 1)."""
    text = F.concat(F.lit(SALT + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class Factors:
    """Language and topic factors of every round, and the source factor they imply."""

    def __init__(self, langs: list[str], topics: list[str]):
        self.langs, self.topics = langs, topics
        self.history = [([1.0] * len(langs), [1.0] * len(topics))]

    def source(self, rounds: int | None = None, start: Column | None = None) -> Column:
        """a_s of a row with ``cells`` and ``target``, after as many rounds from ``start``."""
        rounds = len(self.history) if rounds is None else rounds
        start = F.lit(1.0) if start is None else start
        if not self.history[:rounds]:
            return start
        past = F.array(*[F.struct(_array(b).alias("b"), _array(c).alias("c")) for b, c in self.history[:rounds]])

        def step(a, f):
            got = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["w"] * F.least(
                F.lit(1.0), a * F.element_at(f["b"], x["l"]) * F.element_at(f["c"], x["t"])))
            return F.when(got > 0, a * F.col("target") / got).otherwise(a)

        return F.aggregate(past, start, step)


def fit(marked: DataFrame, power: float = POWER, rate: float = RATE, rounds: int = ROUNDS,
        shares: dict[str, dict[str, float]] | None = None, tolerance: float | None = None) -> DataFrame:
    """source, lang, topic, weight and probability per cell. ``shares``: target shares by marginal, in place of tempered ones.

    ``tolerance``: targets that can be met, raked until they are; without one, ``rounds`` rounds at the plain targets.
    """
    spark = marked.sparkSession
    shares = shares or {}
    cells = saved(marked.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("w")), scratch(spark, "cells"))
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    sums = {k: {r[k]: r["w"] for r in cells.groupBy(k).agg(F.sum("w").alias("w")).collect()} for k in ("lang", "topic")}
    langs, topics = sorted(sums["lang"]), sorted(sums["topic"])

    def targets(kind, names):
        raw = [shares[kind].get(n, 0.0) if kind in shares else (sums[kind][n] / total) ** power if total else 1.0 for n in names]
        return [rate * total * x / (sum(raw) or 1.0) for x in raw]

    lang_target, topic_target = targets("lang", langs), targets("topic", topics)
    if "source" in shares:
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shares["source"].items() for x in kv]), F.col("source")), F.lit(0.0))
    else:
        raw = (F.col("tokens") / F.lit(total)) ** F.lit(power) if total else F.lit(1.0)
    by_source = cells.groupBy("source").agg(
        F.sum("w").alias("tokens"),
        F.sort_array(F.collect_list(F.struct(
            F.array_position(_names(langs), F.col("lang")).cast("int").alias("l"),
            F.array_position(_names(topics), F.col("topic")).cast("int").alias("t"), "w"))).alias("cells"))
    by_source = by_source.withColumn("raw", raw)
    whole = by_source.agg(F.sum("raw")).first()[0] or 1.0
    by_source = saved(by_source.withColumn("target", F.lit(rate * total) * F.col("raw") / F.lit(whole)), scratch(spark, "sources"))

    if tolerance is not None and langs and total:
        of_lang, of_topic = [sums["lang"][n] for n in langs], [sums["topic"][n] for n in topics]
        return _fit_within(by_source, langs, topics, of_lang, of_topic, lang_target, topic_target, rate * total, tolerance)
    f = Factors(langs, topics)
    exploded = by_source.select("cells", "target")
    for _ in range(rounds):
        b, c = (list(x) for x in f.history[-1])
        flat = exploded.withColumn("a", f.source()).select("a", F.explode("cells").alias("x")).select("a", "x.l", "x.t", "x.w")

        def expected(kind, b=b, c=c, flat=flat):
            p = F.least(F.lit(1.0), F.col("a") * F.element_at(_array(b), F.col("l")) * F.element_at(_array(c), F.col("t")))
            return {r[kind]: r["e"] for r in flat.groupBy(kind).agg(F.sum(F.col("w") * p).alias("e")).collect()}

        got = expected("l")
        b = [x * lang_target[k] / got[k + 1] if got.get(k + 1, 0) > 0 else x for k, x in enumerate(b)]
        got = expected("t", b=b)
        c = [x * topic_target[k] / got[k + 1] if got.get(k + 1, 0) > 0 else x for k, x in enumerate(c)]
        f.history.append((b, c))
    if not langs:
        return cells.select("source", "lang", "topic", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    b, c = f.history[-1]
    flat = by_source.withColumn("a", f.source(rounds)).select("source", "a", F.explode("cells").alias("x"))
    weight = F.col("a") * F.element_at(_array(b), F.col("x.l")) * F.element_at(_array(c), F.col("x.t"))
    return flat.select("source", F.element_at(_names(langs), F.col("x.l")).alias("lang"), F.element_at(_names(topics), F.col("x.t")).alias("topic"),
                       weight.alias("weight"), F.least(F.lit(1.0), weight).alias("probability"))


def _level(total_at, goal: float, top: float) -> float:
    """Least level, up to ``top``, at which the total reaches ``goal``; ``total_at`` gives the totals of several at once."""
    low, high = 0.0, top
    for _ in range(6):
        levels = np.linspace(low, high, 65)
        k = max(1, int(np.argmax([*(np.array(total_at(levels[:-1])) >= goal), True])))
        low, high = float(levels[k - 1]), float(levels[k])
    return high


def _filled(raw: np.ndarray, tokens: np.ndarray, forced: np.ndarray, goal: float) -> np.ndarray:
    """Targets in proportion to ``raw``, between the forced tokens and all tokens of each group, that sum to ``goal``."""
    at = lambda k: np.clip(k * raw, np.minimum(forced, tokens), tokens)
    top = float((tokens[raw > 0] / raw[raw > 0]).max()) if (raw > 0).any() else 0.0
    return at(_level(lambda levels: [at(k).sum() for k in levels], goal, top))


def _fit_within(by_source: DataFrame, langs, topics, of_lang, of_topic, lang_raw, topic_raw, goal: float, tolerance: float) -> DataFrame:
    spark = by_source.sparkSession
    of = {"l": np.array(of_lang), "t": np.array(of_topic)}
    raw = {"l": np.array(lang_raw), "t": np.array(topic_raw)}
    forced = {k: np.zeros(len(v)) for k, v in of.items()}
    x = F.col("x")

    def sums_by(flat: DataFrame, kind: str, value: Column) -> np.ndarray:
        out = np.zeros(len(of[kind]))
        for r in flat.groupBy(F.col(f"x.{kind}").alias("k")).agg(F.sum(value).alias("e")).collect():
            out[r["k"] - 1] = r["e"] or 0.0
        return out

    rows = by_source.withColumn("forced", F.lit(0.0))
    for _ in range(len(langs) + len(topics) + 1):
        reach = by_source.where("raw > 0").agg(F.sum("tokens")).first()[0] or 0.0
        goal = min(goal, reach, *(float(of[k][raw[k] > 0].sum()) for k in of))
        target = {k: _filled(raw[k], of[k], forced[k], goal) for k in of}
        whole = {k: target[k] >= of[k] * (1 - 1e-12) for k in of}
        at = lambda k: F.least(F.col("tokens"), F.greatest(F.col("forced"), k * F.col("raw")))
        top = rows.agg(F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw")))).first()[0] or 0.0

        def total_at(levels, rows=rows, at=at):
            each = rows.select("tokens", "forced", "raw", F.posexplode(_array(levels)).alias("i", "k"))
            got = {r["i"]: r["e"] for r in each.groupBy("i").agg(F.sum(at(F.col("k"))).alias("e")).collect()}
            return [got.get(i, 0.0) for i in range(len(levels))]

        state = rows.withColumn("target", at(F.lit(_level(total_at, goal, top)))).withColumn("whole", F.col("target") >= F.col("tokens") * (1 - 1e-12))
        is_whole = {k: F.element_at(F.array(*[F.lit(bool(v)) for v in whole[k]]), F.col(f"x.{k}")) for k in of}
        flat = state.select("whole", F.explode("cells").alias("x"))
        now = {"l": sums_by(flat, "l", F.when(F.col("whole") | is_whole["t"], x["w"]).otherwise(0.0)),
               "t": sums_by(flat, "t", F.when(F.col("whole") | is_whole["l"], x["w"]).otherwise(0.0))}
        inside = lambda y: F.element_at(F.array(*[F.lit(bool(v)) for v in whole["l"]]), y["l"]) | F.element_at(
            F.array(*[F.lit(bool(v)) for v in whole["t"]]), y["t"])
        bound = F.aggregate("cells", F.lit(0.0), lambda s, y: s + F.when(inside(y), y["w"]).otherwise(0.0))
        state = saved(state.withColumn("bound", bound), scratch(spark, "sources-filled"))
        over = state.where(F.col("bound") > F.col("target") * (1 + 1e-9)).limit(1).count()
        if not over and all((now[k] <= target[k] * (1 + 1e-9)).all() for k in of):
            break
        forced, rows = now, state.withColumn("forced", F.col("bound")).drop("target", "whole", "bound")

    state = state.withColumn("a", F.when(F.col("whole"), WHOLE).otherwise(1.0))
    b, c = (np.where(whole[k], WHOLE, 1.0) for k in ("l", "t"))
    f = Factors(langs, topics)
    f.history = [(b.tolist(), c.tolist())]

    def factor() -> Column:
        return F.when(F.col("whole"), F.lit(WHOLE)).otherwise(f.source(start=F.col("a")))

    def chance(b, c, y=x, a=F.col("a")) -> Column:
        return F.least(F.lit(1.0), a * F.element_at(_array(b), y["l"]) * F.element_at(_array(c), y["t"]))

    def scaled(kind, factors, got):
        return np.where(whole[kind] | (got <= 0), factors, factors * target[kind] / np.where(got > 0, got, 1.0))

    def worst(got, want):
        return float(np.max(np.where(want > 0, np.abs(got / np.where(want > 0, want, 1.0) - 1), (got > 0) * 1.0)))

    error, stalled = np.inf, 0
    for k in range(1, MOST + 1):
        now = state.withColumn("a", factor())
        if len(f.history) >= KEPT:
            state = now = saved(now, scratch(spark, "sources-raked"))
            f.history = []
        flat = now.select("a", F.explode("cells").alias("x"))
        b = scaled("l", b, sums_by(flat, "l", x["w"] * chance(b, c)))
        c = scaled("t", c, sums_by(flat, "t", x["w"] * chance(b, c)))
        f.history.append((b.tolist(), c.tolist()))
        if k % 4 == 0 or k == MOST:
            got = F.aggregate("cells", F.lit(0.0), lambda s, y: s + y["w"] * chance(b, c, y))
            missed = now.where("target > 0").agg(F.max(F.abs(got / F.col("target") - 1))).first()[0] or 0.0
            before, error = error, max(missed, *(worst(sums_by(flat, n, x["w"] * chance(b, c)), target[n]) for n in ("l", "t")))
            stalled = stalled + 1 if error > 0.98 * before else 0
            if error <= tolerance or stalled == 2:  # caps of single cells can make targets contradict: more rounds change nothing
                break
    if error > tolerance:
        warnings.warn(f"mixture: after {k} rounds a marginal still misses its target by {error:.2%}", stacklevel=2)
    flat = now.select("source", "a", F.explode("cells").alias("x"))
    weight = F.col("a") * F.element_at(_array(b), x["l"]) * F.element_at(_array(c), x["t"])
    return flat.select("source", F.element_at(_names(langs), x["l"]).alias("lang"), F.element_at(_names(topics), x["t"]).alias("topic"),
                       weight.alias("weight"), F.least(F.lit(1.0), weight).alias("probability"))


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (6 decimals) and selected, per row."""
    rows = saved(docs.select(*keyed(docs)), scratch(docs.sparkSession, "marked"))
    cells = saved(fit(rows, **options), scratch(docs.sparkSession, "probabilities"))
    return (rows.join(cells, ["source", "lang", "topic"])
            .select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"),
                    (draw(F.col("doc_id")) < F.col("probability")).alias("selected")))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The selected rows of ``docs``, all columns as they are."""
    spark = docs.sparkSession
    rows = saved(docs.select(*keyed(docs)), scratch(spark, "marked"))
    cells = saved(fit(rows, **options), scratch(spark, "probabilities"))
    _, source, lang, topic, _ = keyed(docs)
    prefixed = cells.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("probability").alias("__p"))
    held = docs.withColumns({"__ks": source, "__kl": lang, "__kt": topic})
    on = (F.col("__ks") == F.col("__s")) & (F.col("__kl") == F.col("__l")) & (F.col("__kt") == F.col("__t"))
    return held.join(prefixed, on).where(draw(F.col("doc_id")) < F.col("__p")).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
