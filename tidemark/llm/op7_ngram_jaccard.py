"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word n-gram hashes. All n-grams have one global order:
by the magnitude of their frequency (from a count sketch over all texts, of a
size that follows theirs up to a bound), then by hash, so that common passages
come last. The order is cut
into ``FRAGMENTS`` fragments of about equal mass; a document's set falls into
one segment per fragment. The overlap of a pair is counted fragment by
fragment, each by itself, and the partial counts are summed per pair and
tested exactly: 100 * intersection >= threshold * union. The fragment of the
rarest n-grams comes first; a pair that can no longer be linked, were all the
rest of the smaller set shared, is not counted in the others.

Candidates share one of the first (rarest) ``n - ceil(t n) + 1`` n-grams, as
any linked pair must, and pass length and position filters, and pairs from
uncommon n-grams a filter on how many of them are shared. Equal sets are one
class before anything is joined. The documents behind an n-gram that ``PAIRED``
or fewer share are paired; those behind a more frequent one are not: in
rounds, each such n-gram compares its documents to a few pivots (those that
hold the most of such n-grams, so near the middle of their group, and mostly
the same ones for all n-grams of a group), links merge into components, and
n-grams whose documents are all in one component are done (their other pairs
cannot change a component). What then still spans
components is compared in full, pairs of different components only. So a group
of copies costs a few comparisons per member, and no link between components
is lost. N-grams are counted first; rows of those that only one set holds, as
far as a bit filter tells, are not moved, nor are sets outside a candidate
pair, nor prefixes of classes of one row. A round moves a set once, and once
more for each of its pairs.

Defined results: a null or empty text, or one without words, has the empty
set and is linked with nothing; fewer words than ``n`` are one n-gram;
repeated rows are equal sets and share a component; a null id counts for no
component's least id, and a component without any id has a null one; an empty
table gives an empty result; other columns are ignored (``deduplicate`` keeps
them). Texts are used whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mix, saved, scratch, shingles, shuffle_partitions, sliced, table, text_of, word_batches
from tidemark.llm.graph import components

FRAGMENTS = 4
BYTES_PER_SLOT = 64  # of text, for a slot of the count sketch
SKETCH_BITS = (16, 26)  # least and most: 64 MB as magnitudes at most
CHUNK = 1 << 16
PAIRED = 32  # documents
FILTER_BITS = (16, 28)  # least and most of a bit filter: 32 MB at most
BITS_PER_KEY = 64
PIVOTS = (1, 4, 16)  # per n-gram, round by round, before the rest is compared in full
SIGNATURE = "rid bigint, doc_id bigint, th bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>"


def sets_of(texts: list[str | None], n: int):
    """Sorted distinct n-gram hashes of each text, letters A-Z in lower case."""
    for _, w in word_batches(texts, lower=True):
        h = w.hashes
        for d in range(len(w.first) - 1):
            yield shingles(h[w.first[d]:w.first[d + 1]], n)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    salted = mix(s + np.uint64(0x1234567))
    a, b = np.bitwise_xor.reduce(salted) if len(s) else np.uint64(0), salted.sum(dtype=np.uint64)
    return tuple(int(x) for x in mix(np.array([a, b + np.uint64(len(s))], np.uint64)).view(np.int64))


# ---- the global order

def sketch_bits(rows: DataFrame) -> int:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(int(size // BYTES_PER_SLOT).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def _sketch(n, bits):
    """Counts of a task's n-grams by slot, in chunks: a bit for each slot hit, then their counts, compressed."""
    def sketch(batches):
        counts = np.zeros(1 << bits, np.uint8)
        for b in sliced(batches):
            held, size = [], 0
            for s in [*sets_of(b.column("text").to_pylist(), n), None]:
                if s is not None:
                    held.append(s)
                    size += len(s)
                if held and (s is None or size > 1 << 18):
                    slot, c = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
                    counts[slot] = np.minimum(counts[slot] + c, 255)
                    held, size = [], 0
        rows = []
        for k in range(0, len(counts), CHUNK):
            chunk = counts[k:k + CHUNK]
            hit = chunk > 0
            if hit.any():
                rows.append((k // CHUNK, zlib.compress(np.packbits(hit).tobytes() + chunk[hit].tobytes(), 1)))
        columns = list(zip(*rows)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary()))], ["chunk", "counts"])
    return sketch


def _merge(batches):
    """Sums chunks as they stream by; holds one array per chunk number of this task."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(*(b.column(c).to_pylist() for c in ("chunk", "counts"))):
            total = sums.setdefault(k, np.zeros(CHUNK, np.uint32))
            raw = np.frombuffer(zlib.decompress(raw), np.uint8)
            total[np.flatnonzero(np.unpackbits(raw[:CHUNK // 8]))] += raw[CHUNK // 8:]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()),
         pa.array([np.frexp(x.astype(np.float64))[1].astype(np.uint8).tobytes() for x in sums.values()], pa.binary())],
        ["chunk", "magnitude"])


class Order:
    """Rank of an n-gram: its magnitude (count below 2**magnitude), then its hash; and the fragments' cuts."""

    def __init__(self, magnitudes: np.ndarray, fragments: int):
        self.magnitudes, self.shift = magnitudes, np.uint64(65 - len(magnitudes).bit_length())
        mass = np.bincount(magnitudes, np.exp2(magnitudes.astype(np.float64)), 64)
        mass[0] = 0
        total, before, cuts = mass.sum(), np.cumsum(mass) - mass, []
        for k in range(1, fragments):
            at = total * k / fragments
            m = int(np.searchsorted(np.cumsum(mass), at, "right")) if total else 63
            m = min(m, 63)
            within = (at - before[m]) / mass[m] if mass[m] else 0.0
            cuts.append((m << 56) + int(min(max(within, 0.0), 1.0) * ((1 << 56) - 1)))
        self.cuts = np.array(cuts, np.uint64)

    def rank(self, s: np.ndarray) -> np.ndarray:
        m = self.magnitudes[s >> self.shift].astype(np.uint64)
        return (m << np.uint64(56)) | (s >> np.uint64(8))

    def ordered(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rank(s)
        by = np.argsort(r, kind="stable")
        return s[by], r[by]


def global_order(rows: DataFrame, n: int, fragments: int = FRAGMENTS) -> Order:
    bits = sketch_bits(rows)
    got = (rows.select("text").mapInArrow(_sketch(n, bits), "chunk int, counts binary")
           .repartition(min((1 << bits) // CHUNK, shuffle_partitions(rows.sparkSession)), "chunk")
           .mapInArrow(_merge, "chunk int, magnitude binary").toLocalIterator())
    magnitudes = np.zeros(1 << bits, np.uint8)
    for r in got:
        magnitudes[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["magnitude"], np.uint8)
    return Order(magnitudes, fragments)


# ---- signatures, candidates, overlaps

def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signatures(order, n, percent):
    def signatures(batches):
        rid = TaskContext.get().partitionId() << 34
        for b in sliced(batches):
            sizes, d1, d2, prefixes = [], [], [], []
            for s in sets_of(b.column("text").to_pylist(), n):
                a, c = digest(s)
                sizes.append(len(s))
                d1.append(a)
                d2.append(c)
                prefixes.append(order.value.ordered(s)[0][:prefix_size(len(s), percent) if len(s) else 0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + len(sizes))), b.column("doc_id"), b.column("th"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()),
                 pa.array(d2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["rid", "doc_id", "th", "n", "d1", "d2", "prefix"])
            rid += len(sizes)
    return signatures


def _segments(order, n, words_):
    """Rows (d1, d2, fragment, segment) of the texts that the filter may hold; copies in a task once, fragment 0 even if empty."""
    def segments(batches):
        o, bits, seen = order.value, words_.value, set()
        for b in sliced(batches):
            rows = []
            hit = may_hold(bits, b.column("key").to_numpy(zero_copy_only=False))
            for s in sets_of(b.column("text").filter(pa.array(hit)).to_pylist(), n):
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                if len(seen) < 1 << 16:
                    seen.add(d)
                ordered, rank = o.ordered(s)
                cut = np.concatenate([[0], np.searchsorted(rank, o.cuts), [len(s)]])
                rows += [(*d, f, ordered[cut[f]:cut[f + 1]].view(np.int64)) for f in range(len(cut) - 1) if not f or cut[f] < cut[f + 1]]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))],
                                             ["d1", "d2", "fragment", "segment"])
    return segments


def bit_filter(of: DataFrame, key: str) -> np.ndarray:
    """Two bits per key, from its halves, modulo a size that follows their number up to a bound; it only saves work, the join behind it decides."""
    bits = min(max((BITS_PER_KEY * of.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    half = F.explode(F.array(key, F.shiftrightunsigned(key, 32))).alias("half")
    at = of.select(half).select(F.col("half").bitwiseAND((1 << bits) - 1).alias("at"))
    words_ = (at.select(F.shiftright("at", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
              .groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words_.column("w").to_numpy()] = words_.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    def held(half):
        at = half & np.uint64(64 * len(bits) - 1)
        return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    keys = keys.view(np.uint64)
    return held(keys) & held(keys >> np.uint64(32))


def _sifted(filter_, key: str, held: bool):
    """The rows whose key the filter may hold, or those whose key it surely does not."""
    def sifted(batches):
        bits = filter_.value
        for b in sliced(batches):
            yield b.filter(pa.array(may_hold(bits, b.column(key).to_numpy(zero_copy_only=False)) == held))
    return sifted


def _tokens(shared, copied=None):
    """Rows (rid, n, pos, token) of the prefixes' n-grams that the filter may hold; of the sets that ``copied`` surely does not, if given.

    Both filters in one function: two in a row take two Python workers a task, which stay.
    """
    def tokens(batches):
        bits = shared.value
        for b in sliced(batches):
            if copied is not None:
                b = b.filter(pa.array(~may_hold(copied.value, b.column("d1").to_numpy(zero_copy_only=False))))
            prefix = b.column("prefix")
            token, size = prefix.flatten().to_numpy(), prefix.value_lengths().to_numpy()
            hit = np.flatnonzero(may_hold(bits, token))
            row = np.repeat(np.arange(len(size)), size)[hit]
            pos = hit - (np.cumsum(size) - size)[row]
            yield pa.RecordBatch.from_arrays(
                [b.column("rid").take(pa.array(row)), b.column("n").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(token[hit])],
                ["rid", "n", "pos", "token"])
    return tokens


def segments_of(rows: DataFrame, order, n: int, bits) -> DataFrame:
    """d1, d2, fragment, segment of the sets whose key the filter may hold, from one more pass over the texts."""
    found = rows.select("text", "key").mapInArrow(_segments(order, n, bits), "d1 bigint, d2 bigint, fragment int, segment array<bigint>")
    return found.groupBy("d1", "d2", "fragment").agg(F.first("segment").alias("segment"))


def links(pairs: DataFrame, sets: DataFrame, segments: DataFrame, percent: int, fragments: int = FRAGMENTS) -> DataFrame:
    """The pairs (a, b) that are linked: partial overlaps by fragment, summed per pair.

    Fragment 0, which every set has, goes first and leaves only the pairs that
    can still be linked. Segments are keyed by digest as they come, so that all
    four joins read them where their one exchange has put them.
    """
    def named(x: str) -> DataFrame:
        return sets.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"))

    def met(of: DataFrame, parts: list[int], how: str) -> DataFrame:
        of = of.withColumn("fragment", F.explode(F.array(*map(F.lit, parts))))
        for x in "ab":
            side = segments.select(F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"), "fragment", F.col("segment").alias(f"s{x}"))
            of = of.join(side, [f"{x}1", f"{x}2", "fragment"], how)
        return of

    both = F.when(F.col("sa").isNull() | F.col("sb").isNull(), 0).otherwise(F.size(F.array_intersect("sa", "sb")))
    known = ["a", "b", "na", "nb"]
    first = met(pairs.join(named("a"), "a").join(named("b"), "b"), [0], "inner").select(
        *known, "a1", "a2", "b1", "b2", both.alias("o"), F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb")).alias("rest"))
    still = first.where((F.col("o") + F.col("rest")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    partial = met(still, [*range(1, max(fragments, 2))], "left").select(*known, "o", both.alias("more"))
    total = partial.groupBy(*known, "o").agg(F.sum("more").alias("more")).withColumn("o", F.col("o") + F.col("more"))
    return total.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def join(docs: DataFrame, n: int, percent: int, id_col="doc_id", text_col="text", fragments: int = FRAGMENTS) -> DataFrame:
    """Per row: rid (a row number), doc_id, th (a hash of its text), n_shingles, component (least rid) and component_id (least doc_id)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    keep = lambda df, name: saved(df, scratch(spark, name))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("key", F.xxhash64("doc_id", "th"))
    order = sc.broadcast(global_order(rows, n, fragments))
    signed = keep(rows.mapInArrow(_signatures(order, n, percent), SIGNATURE), "signatures")
    classes = keep(signed.where("n > 0").groupBy("d1", "d2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")), "classes")

    # N-grams of one set only are counted and left where they are: the others alone are moved with their rows.
    copied = sc.broadcast(bit_filter(classes.where("k > 1"), "d1"))
    brief, schema = signed.select("rid", "n", "d1", "prefix"), "rid bigint, n bigint, d1 bigint, prefix array<bigint>"
    several = brief.mapInArrow(_sifted(copied, "d1", True), schema).join(classes.select("rid"), "rid", "left_semi")
    several = keep(several, "of-several-rows")
    prefixes = brief.mapInArrow(_sifted(copied, "d1", False), schema).unionByName(several).select("rid", "n", "prefix")
    counted = prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    shared = keep(counted.where("k > 1"), "shared")
    bits = sc.broadcast(bit_filter(shared, "token"))
    pieces = "rid bigint, n bigint, pos int, token bigint"
    tokens = brief.mapInArrow(_tokens(bits, copied), pieces).unionByName(several.mapInArrow(_tokens(bits), pieces))
    tokens = keep(tokens.join(shared, "token"), "shared-tokens")
    for used in (bits, copied):
        used.unpersist()
    few = tokens.where(F.col("k") <= PAIRED).drop("k").repartition("token")  # one exchange for both sides of its join
    many = tokens.where(F.col("k") > PAIRED)
    # A set of many frequent n-grams is near the middle of its group: it is the better pivot.
    weight = F.least(F.sum("k"), F.lit((1 << 31) - 1)).alias("weight")
    weights = keep(many.groupBy("rid").agg(weight, F.count(F.lit(1)).alias("frequent")), "weights")
    many = keep(many.drop("k").join(weights.drop("frequent"), "rid"), "frequent-tokens")

    def other(of: DataFrame, *more) -> DataFrame:
        return of.select("token", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), *more)

    # What two sets can share from an n-gram on must reach the overlap that a link needs.
    reaches = F.least(F.col("na") - F.col("pa"), F.col("n") - F.col("pos")) * (100 + percent) >= (F.col("na") + F.col("n")) * percent
    sizes = (F.col("na") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("na") * percent)

    def candidates(met: DataFrame) -> DataFrame:
        return met.where(reaches & sizes).select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b"))

    def counted_candidates(met: DataFrame) -> DataFrame:
        """As candidates, of all n-grams that PAIRED or fewer share: what both prefixes share and what is behind the prefix
        of the larger set must reach it too, with as many frequent n-grams as both hold."""
        found = met.where(sizes).groupBy("a", "rid", "na", "n").agg(F.count(F.lit(1)).alias("m"), F.max(reaches).alias("reaches")).where("reaches")
        for x in ("a", "rid"):
            found = found.join(weights.select(F.col("rid").alias(x), F.col("frequent").alias(f"more_{x}")), x, "left")
        more = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_rid", F.lit(0)))
        behind = F.floor((F.greatest("na", "n") * percent + 99) / 100) - 1
        return (found.where((F.col("m") + more + behind) * (100 + percent) >= (F.col("na") + F.col("n")) * percent)
                .select("a", F.col("rid").alias("b")))

    labels, spread = None, many.withColumn("label", F.col("rid"))
    for turn in range(len(PIVOTS) + 1):
        if turn:
            spread = many.join(labels, many["rid"] == labels["a"], "left").select(
                "token", "rid", "n", "pos", "weight", F.coalesce("b", "rid").alias("label"))
            open_ = (spread.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
                     .agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token"))
            spread = keep(spread.join(open_, "token"), "open-tokens")
        label = F.col("label").alias("la")
        if turn < len(PIVOTS):
            # The same pivots for as many n-grams of a group as possible, dealt anew each round: few distinct pairs.
            drawn = F.xxhash64("rid", F.lit(turn))
            key = F.shiftleft((1 << 31) - 1 - F.col("weight"), 32).bitwiseOR(drawn.bitwiseAND((1 << 32) - 1))
            slot = F.pmod(drawn, F.lit(PIVOTS[turn]))
            pivots = spread.groupBy("token", slot.alias("slot")).agg(F.min(key).alias("key")).drop("slot")
            pivot = other(spread.withColumn("key", key).join(pivots, ["token", "key"]), label)
            pairs = candidates(spread.join(pivot, "token").where("la <> label"))
        else:
            pairs = candidates(spread.join(other(spread, label), "token").where("la < label"))
        if turn == 0:
            pairs = pairs.unionByName(counted_candidates(few.join(other(few), "token").where("a < rid")))
        pairs = keep(pairs.distinct(), "pairs")
        wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        wanted = keep(wanted, "wanted")
        if turn and wanted.isEmpty():
            continue
        sets = signed.select("rid", "doc_id", "th", "n", "d1", "d2").join(wanted, "rid").withColumn("key", F.xxhash64("doc_id", "th"))
        sets = keep(sets.select("rid", "key", "n", "d1", "d2"), "sets")
        bits = sc.broadcast(bit_filter(sets, "key"))
        new = keep(links(pairs, sets, segments_of(rows, order, n, bits), percent, fragments), "links")
        bits.unpersist()
        if labels is None or not new.isEmpty():
            labels = components(new if labels is None else labels.unionByName(new))

    order.unpersist()
    of = classes.join(labels, classes["rid"] == labels["a"], "left").select(
        "d1", "d2", "rid", "least", F.coalesce("b", "rid").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    members = of.join(least, "component").select("d1", "d2", "component", "component_id")
    with_words = signed.where("n > 0").select("rid", "doc_id", "th", "n", "d1", "d2").join(members, ["d1", "d2"])
    without = signed.where("n = 0").select("rid", "doc_id", "th", "n", F.col("rid").alias("component"), F.col("doc_id").alias("component_id"))
    return (with_words.select("rid", "doc_id", "th", "n", "component", "component_id").unionByName(without)
            .withColumnRenamed("n", "n_shingles"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row per group of linked documents, the one of least id; all columns as they are.

    Rows are told apart by id and text: of one id with two texts in two
    groups both stay. A row without an id comes last in its group; rows of
    the kept id and text become one. Texts without words stay, all of them.
    """
    name, text = "__jaccard_th", text_of(text_col)
    found = join(docs, n, percent, id_col, text_col).where("n_shingles > 0")
    found = saved(found.groupBy("component", "doc_id", "th").agg(F.count(F.lit(1)).alias("k")), scratch(docs.sparkSession, "members"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = found.groupBy("component").agg(F.min(order).alias("kept"))
    found = found.join(kept, "component").withColumn("stays", order == F.col("kept")).where("NOT stays OR k > 1")
    found = saved(found.select("doc_id", "th", "stays"), scratch(docs.sparkSession, "marked"))  # of known size to the joins below
    key, marks = "__jaccard_key", bit_filter(found.select(F.xxhash64("doc_id", "th").alias("key")), "key")
    marks = docs.sparkSession.sparkContext.broadcast(marks)
    hashed = docs.withColumn(name, F.xxhash64(text)).withColumn(key, F.xxhash64(F.col(id_col).cast("bigint"), name))
    # Rows that are surely not marked stay where they are; only the others meet the joins.
    alone = hashed.mapInArrow(_sifted(marks, key, False), hashed.schema)
    hashed = hashed.mapInArrow(_sifted(marks, key, True), hashed.schema)

    def same(of: DataFrame):
        return hashed[id_col].cast("bigint").eqNullSafe(of["doc_id"]) & (hashed[name] == of["th"])

    again = found.where("stays").select("doc_id", "th")
    once = alone.unionByName(hashed.join(found, same(found), "left_anti"))
    repeated = hashed.join(again, same(again), "left_semi").dropDuplicates([id_col, name])
    return once.unionByName(repeated).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")
