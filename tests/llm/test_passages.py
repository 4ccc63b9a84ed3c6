"""Repeated passages, collocations and Orchard clustering against plain code."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op11_repeats as op11
from tidemark.llm import op12_collocations as op12
from tidemark.llm import op13_orchard as op13
from tidemark.llm import packed

SMALL = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- asking and answering
def test_answers_name_every_frequent_key():
    rng = np.random.default_rng(1)
    chunks = [np.unique(packed.placed(rng.integers(0, 300, 200).astype(np.uint64) << np.uint64(29), 4), return_counts=True)
              for _ in range(5)]
    asked = pa.concat_tables([packed.counted(c, *k) for c, k in enumerate(chunks)])
    total = Counter()
    for keys, counts in chunks:
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    replies = [packed.frequent(4, 7)(asked.filter(pa.compute.equal(asked["bucket"], b))) for b in set(asked["bucket"].to_pylist())]
    answers = pa.concat_tables(replies)
    for c, (keys, _) in enumerate(chunks):
        mine = answers.filter(pa.compute.equal(answers["chunk"], c))
        assert packed.passed(mine, 7).tolist() == [k for k in keys.tolist() if total[k] >= 4]
        assert not len(packed.passed(mine, 6))
    with pytest.raises(ValueError):
        packed.frequent(256, 0)


# ---------------------------------------------------------------- repeated passages
def covered(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                hit[i:i + size] = True
        out.append((len(w), hit))
    return out


def passages():
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    shared, long = words(60), words(300)
    texts = [None, "", " \t\n", "one", " ".join(["same"] * 200), " ".join(words(34)), " ".join(shared[:35]),
             " ".join(words(20) + shared[5:40] + words(10)), "\n".join(words(50) + shared + words(30)),
             " ".join(words(40) + shared[10:44] + words(40)),  # 34 shared words: too few
             " ".join(long), "\t".join(long), " ".join(words(10) + long[:140] + words(5)), " ".join(words(9000)),
             " ".join(w.upper() for w in shared), " ".join(shared[:20] + shared[:20])]
    return texts


@pytest.mark.parametrize("start, size", [(None, 1 << 20), (5, 700), (35, 1 << 20)])
def test_repeats_equal_brute_force(spark, start, size):
    texts = passages()
    df = spark.createDataFrame([(None if k == 3 else k % 11, t, 1, "x") for k, t in enumerate(texts)],
                               "doc_id bigint, text string, chunk int, kept string").repartition(3)
    got = op11.repeats(df, 35, start=start, size=size).collect()
    want = Counter((None if k == 3 else k % 11, n, int(hit.sum()),
                    " ".join(w for w, h in zip((t or "").split(), hit) if not h), tuple(np.flatnonzero(hit).tolist()))
                   for k, (t, (n, hit)) in enumerate(zip(texts, covered(texts, 35))))
    assert Counter((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), r.kept,
                    tuple(i for a, b in r.spans for i in range(a, b))) for r in got) == want
    assert all(r.longest == (35 if r.spans else 0) for r in got)


def test_doubling_goes_on_until_nothing_repeats(spark):
    texts = passages()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r for r in op11.longest(df, 20, start=3).collect()}
    by_size = {size: covered(texts, size) for size in (20, 40, 80, 160, 320)}
    for k, t in enumerate(texts):
        assert got[k].longest == max([0] + [s for s, rows in by_size.items() if rows[k][1].any()])
        assert sum(b - a for a, b in got[k].spans) == int(by_size[20][k][1].sum())


def test_short_windows_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b a"), (3, "c")], "doc_id int, text string")
    got = sorted((r.doc_id, r.n_words, r.kept) for r in op11.repeats(df, 1).collect())
    assert got == [(1, 2, ""), (1, 2, ""), (2, 2, ""), (3, 1, "c")]
    got = sorted((r.doc_id, r.kept) for r in op11.repeats(df, 2).collect())
    assert got == [(1, ""), (1, ""), (2, "b a"), (3, "c")]
    assert op11.repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        op11.repeats(df, 0)


def test_chunk_table_is_not_moved(spark):
    """Only answers are exchanged: the chunk side of the last join is a bucketed scan."""
    found = op11.Repeats(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id int, text string"), 3)
    plan = found.per_document()._jdf.queryExecution().executedPlan().toString()
    left = plan[:plan.index("Exchange")]
    assert "Bucketed: true" in left and "texts" in left


# ---------------------------------------------------------------- collocations
def counted_phrases(rows, most=3):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = {}
    for lang, t in rows:
        c = out.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(low)):
            ws = re.findall("[^ \t]+", piece)
            for n in range(1, most + 1):
                for i in range(len(ws) - n + 1):
                    c[tuple(ws[i:i + n])] += 1
    return {k: v for k, v in out.items() if v}


def best(rows, most, least, top):
    out = []
    for lang, c in counted_phrases(rows, most).items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = any(100 * b >= 50 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q, b in found.items() if b * 2 >= a)
            if not inside:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(v for p, v in c.items() if len(p) == 1)
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def sentences():
    rng = random.Random(9)
    words = ["New", "york", "CITY", "the", "of", "Ärger", "ärger", "x\x1fy", "a" * 300, "日本"]
    rows = [("en", None), (None, "alpha Beta, alpha beta"), ("en", ""), ("de", " \t.;"), ("en", "the " * 400)]
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", " , ", "\x0b"]) for _ in range(rng.randint(1, 80)))
        rows.append((("en", "de", None, "und")[k % 4], text))
    return rows + rows[-30:]


@pytest.mark.parametrize("most, least, top, size", [(3, 10, 2000, 1 << 20), (4, 3, 25, 600), (2, 5, 7, 2000)])
def test_collocations_equal_brute_force(spark, most, least, top, size):
    rows = sentences()
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, chunk int, phrase string").repartition(3)
    got = op12.collocations(df, most, least, top, size=size)
    assert sorted(tuple(r)[:8] for r in got.collect()) == best(rows, most, least, top)


def test_phrase_counts_have_their_neighbours(spark):
    rows = sentences()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    got = {(r.lang, r.phrase): r for r in op12.phrase_counts(op12.shards(df, 3, size=1500), 3, 5).collect()}
    want = counted_phrases(rows, 4)
    assert len(got) == sum(a >= 5 for c in want.values() for p, a in c.items() if len(p) <= 3)
    for (lang, phrase), r in got.items():
        p = tuple(phrase.split(" "))
        c = want[lang]
        assert r.n == c[p] and r.size == len(p)
        assert r.n_left == sum(a for q, a in c.items() if len(q) == len(p) + 1 and q[1:] == p)
        assert r.n_right == sum(a for q, a in c.items() if len(q) == len(p) + 1 and q[:-1] == p)


def test_transform_orders_contexts():
    rng = np.random.default_rng(2)
    seq = np.append(0, rng.integers(0, 4, 200)).astype(np.int32)
    bwt = op12.transform(seq, 3)
    rows = sorted(range(len(seq)), key=lambda i: tuple(seq[(i + k) % len(seq)] for k in range(4)))
    assert bwt.tolist() == [int(seq[i - 1]) for i in rows]


def test_no_collocations(spark):
    df = spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")
    assert op12.collocations(df).collect() == [] and op12.collocations(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        op12.collocations(df, 1)


# ---------------------------------------------------------------- Orchard clustering
def lloyd(rows, k, rounds, dim, scale=1024):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v, float).tobytes(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centres[n] = [sum(col) // len(vs) for col in zip(*vs)]
    final = [(i, *near(v)) for i, v in kept]
    return [(i, n, d, sum(e for _, e, m in final if m == n), sum(e for _, e, _ in final)) for i, d, n in final], centres


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=5) + 3 * (k % 6)).round(3).tolist()) for k in range(150)]
    rows += [(200, rows[0][1]), (200, rows[1][1]), (None, rows[2][1]), (0, rows[0][1])]
    rows += [(300, None), (301, []), (302, [1.0]), (303, [1.0, None, 1.0, 1.0, 1.0]), (304, [1.0, float("nan"), 0.0, 0.0, 0.0]),
             (305, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (306, [-0.0, 0.0, -1e-9, 1e-9, 0.0])]
    return rows + [(400 + k, [float(k % 2)] * 5) for k in range(60)]


def test_clusters_equal_brute_force(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in vectors], "vec_id bigint, embedding array<double>, cluster int, distance double")
    out, centroids = op13.cluster(df.repartition(3), k=7, rounds=4, dim=5)
    want, centres = lloyd(vectors, 7, 4, 5)
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert centroids.tolist() == centres


def test_wide_components_and_few_vectors(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.5]), (3, [1e9, 4.0]), (4, [3e5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    out, centroids = op13.cluster(df, k=2, rounds=3, dim=2)
    want, centres = lloyd(rows, 2, 3, 2)
    assert centroids.tolist() == centres
    top = (1 << 63) - 1
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(
        str((i, n, *(x if x <= top else None for x in (d, c, a)))) for i, n, d, c, a in want)
    assert sorted((r.vec_id, r.cluster) for r in out.collect()) == sorted((i, n) for i, n, *_ in want)
    out, centroids = op13.cluster(df.where("vec_id = 4"), k=8, dim=2)
    assert len(centroids) == 1 and [tuple(r) for r in out.collect()] == [(4, 0, 0, 0, 0)]
    nothing, none = op13.cluster(df.limit(0), dim=2)
    assert nothing.collect() == [] and len(none) == 0
    unnamed, none = op13.cluster(spark.createDataFrame([(None, [1.0, 2.0])], df.schema), dim=2)
    assert [tuple(r) for r in unnamed.collect()] == [(None, None, None, None, None)] and len(none) == 0


def test_search_is_exact_and_skips_far_centroids():
    rng = np.random.default_rng(6)
    centres = rng.integers(-50, 50, (40, 2)) * 40
    x = centres[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 2))
    x[:40] = (centres[rng.integers(0, 40, 40)] + centres[rng.integers(0, 40, 40)]) // 2  # ties
    search = op13.Orchard(centres)
    now, best_of, taken = search.nearest(x)
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert now.tolist() == d.argmin(axis=1).tolist() and best_of.tolist() == d.min(axis=1).tolist()
    assert taken < 0.7 * d.size
    twins = op13.Orchard(np.array([[1, 1], [1, 1], [0, 0]]))
    assert twins.nearest(np.array([[1, 1], [0, 0]]))[0].tolist() == [0, 2]


def test_registered_clusters(spark):
    rows = op13.query(spark, SMALL).collect()
    kept = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, centres = lloyd(kept, 8, 10, 64)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert Counter(tuple(r) for r in rows) == Counter((*w, digest[w[1]]) for w in want)
