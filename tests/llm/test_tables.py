"""Mixture, WARC, Jaccard join, components, SQL of registered queries, and the pipeline."""

import base64
import gzip
import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as E
import corpus_pipeline
from conftest import MEDIUM
from tidemark.llm import op4_mixture as op4
from tidemark.llm import op6_warc as op6
from tidemark.llm import op7_ngram_jaccard as op7
from tidemark.llm.common import saved, scratch
from tidemark.llm.graph import components
from tidemark.llm.sql import LLM_ORACLES
from tools.compare import digest


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MEDIUM}/{t}.parquet')")
    s, d = E.queries()[name](spark, MEDIUM).toPandas(), con.execute(LLM_ORACLES[name]).df()
    assert sorted(s.columns) == sorted(d.columns) and len(s) == len(d) and digest(s) == digest(d)


def test_every_operator_is_registered():
    names = [k for k in E.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names if k[2:].split("_")[0].isdigit()) == [*range(1, 11)]
    assert E.queries()["pipeline"] is corpus_pipeline.run


def test_mixture_meets_targets(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randint(5, 60)), rng.choice(["en"] * 6 + ["fr", "de"]), rng.choice(["big"] * 5 + ["s1", "s2", None]))
            for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = op4.mixture(docs, rate=0.3, rounds=10).toPandas()
    total = got.n_tokens.sum()
    for kind in ("source", "lang"):
        share = got.groupby(kind).n_tokens.sum() / total
        goal = share**op4.POWER / (share**op4.POWER).sum() * 0.3 * total
        expected = (got.n_tokens * got.probability).groupby(got[kind]).sum()
        assert ((expected - goal).abs() / goal < 0.01).all()
        drawn = (got.n_tokens * got.selected).groupby(got[kind]).sum()
        assert ((drawn - goal).abs() / goal < 0.25).all()
    fixed = op4.mixture(docs, rate=0.2, shares={"lang": {"fr": 1.0}}).where("lang <> 'fr'").agg({"probability": "max"}).first()[0]
    assert fixed == 0.0


def water(raw, tokens, goal):
    """Plain water-filling: scarce groups whole, the rest in proportion."""
    full = set()
    while True:
        left = goal - sum(tokens[k] for k in full)
        level = left / sum(raw[k] for k in raw if k not in full)
        more = {k for k in raw if k not in full and level * raw[k] > tokens[k]}
        if not more:
            return {k: tokens[k] if k in full else level * raw[k] for k in raw}
        full |= more


def test_mixture_meets_all_marginals_at_production_parameters(spark):
    """Scarce topics are whole, and sources, languages and the other topics meet their targets."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = op4.mixture(docs, tolerance=op4.TOLERANCE).toPandas()
    total = got.n_tokens.sum()
    assert abs((got.n_tokens * got.probability).sum() / (op4.RATE * total) - 1) < 0.002
    for kind in ("source", "lang", "topic"):
        tokens = got.groupby(kind).n_tokens.sum().to_dict()
        goal = water({k: (n / total) ** op4.POWER for k, n in tokens.items()}, tokens, op4.RATE * total)
        expected = (got.n_tokens * got.probability).groupby(got[kind]).sum()
        assert all(abs(expected[k] / goal[k] - 1) < 0.002 for k in goal), kind
    assert got[got.topic != "prose"].probability.min() == 1.0


def test_mixture_edges(spark, docs, none):
    got = op4.mixture(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["probability"] <= 1 for r in got)
    s = op4.sample(docs)
    assert s.columns == docs.columns and s.count() == sum(r["selected"] for r in got)
    assert op4.mixture(none).count() == 0 and op4.sample(none).count() == 0


PAGES = [(1, "http://www.a.example/x?q=1#f", "<p>one</p>"), (2, "https://b.example:8443", "same é"), (7, "https://b.example/2", "same é"),
         (5, "http://user@B.example/", "same é"), (9, None, None), (10, "", ""), (None, "http://[bad", "same é"), (7, "https://b.example/2", "same é"),
         (11, "line\r\nbreak: x", "\r\n\r\nWARC/1.1\r\n" * 3), (12, "http://a.example/long", "z" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, digest string")


def test_warc_round_trip(spark, pages):
    out = scratch(spark, "t6")
    directory = op6.write(pages, out, block=3)
    got = op6.read(directory).collect()
    assert len(got) == len(PAGES)
    keeper = defaultdict(lambda: -1)
    for i, _, h in PAGES:
        keeper[h or ""] = max(keeper[h or ""], -1 if i is None else i)
    want = []
    for i, u, h in PAGES:
        body, k = (h or "").encode(), keeper[h or ""]
        revisit = i != k
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response",
                     k if revisit else None, u))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    keys = [x for r in sorted(directory.collect(), key=lambda r: (r["part"], r["offset"])) for x in (r["first_key"], r["last_key"])]
    assert keys == sorted(keys)
    path = spark.read.parquet(out + "/captures").first()["file"].removeprefix("file:")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_lookup_and_least(spark, pages):
    directory = op6.write(pages, scratch(spark, "t6"), least=7, block=2)
    assert op6.read(directory).where("record_type = 'revisit' AND payload_bytes < 7").count() == 0
    asked = spark.createDataFrame([("http://B.example:443/2",), ("http://a.example/none",), (None,), ("https://b.example/2",)], "url string")
    got = op6.lookup(directory, asked)
    assert sorted(r["page_id"] for r in got.collect()) == [7, 7, 9, 10]
    nothing = op6.write(pages.limit(0), scratch(spark, "t6"))
    assert op6.read(nothing).count() == 0 and op6.lookup(nothing, asked).count() == 0


def test_url_keys():
    assert op6.url_key("https://www.Example.com:443/A?b") == "com,example,www)/A?b"
    assert op6.url_key("http://x.org:81") == "org,x:81)/"


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(3, 3)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        k = min(n, len(ws))
        sets.append({tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if ws else set())
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for v, (k, _) in enumerate(rows):
        if k is not None:
            least[find(v)] = min(k, least.get(find(v), math.inf))
    return [(k, len(sets[v]), least.get(find(v))) for v, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("n,percent,paired", [(4, 85, 32), (5, 80, 4), (1, 50, 2)])
def test_join_equals_brute_force(spark, docs, texts, monkeypatch, n, percent, paired):
    """A large group of near copies, a passage that all texts share, and chains of links."""
    monkeypatch.setattr(op7, "PAIRED", paired)
    rng = random.Random(n)
    base = [f"b{rng.randrange(60)}" for _ in range(150)]
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, texts[9]), (None, texts[9]), (None, "no id at all")]
    for k in range(60):
        ws = list(base)
        for _ in range(rng.randrange(6)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(ws)))
    for k in range(25):
        rows.append((300 + k, passage + " " + " ".join(f"u{rng.randrange(400)}" for _ in range(rng.choice([0, 3, 8, 60])))))
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, component_id int")
    got = op7.join(df, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, n, percent), key=key)


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies with one to six edits each: every step's pairs stay near the number of members, not of their pairs."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(240):
        words = list(base)
        for at in rng.sample(range(300), rng.randint(1, 6)):
            words[at] = f"e{rng.randint(0, 10 ** 6)}"
        rows.append((k, " ".join(words)))
    made = []

    def counting(df, path):
        out = saved(df, path)
        if "/pairs-" in path:
            made.append(out.count())
        return out

    monkeypatch.setattr(op7, "saved", counting)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in op7.join(df, 5, 80).collect()}
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    assert got == dict(enumerate(least))
    assert sum(made) < 10 * len(rows), made  # all pairs: 28,680


def test_pairs_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Texts of one length that share a fifth of their words, and one true link: the others are told apart by their prefixes."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        passage = [f"p{k // 2}x{j}" for j in range(40)]
        rows.append((k, " ".join([*passage, *(f"u{rng.randrange(10 ** 9)}" for _ in range(160))])))
    rows.append((99, rows[7][1] + " more"))
    made = []

    def counting(df, path):
        out = saved(df, path)
        if "/pairs-" in path:
            made.append(out.count())
        return out

    monkeypatch.setattr(op7, "saved", counting)
    got = op7.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 85))
    assert sum(made) == 1, made


def test_links_of_sets_that_lack_fragments(spark):
    """Sets whose n-grams all fall in one fragment, or in none that the other has: (1, 2) and (3, 4) are linked."""
    sets = {1: [[1, 2], [], [3]], 2: [[1, 2], [], [3]], 3: [[], [7, 8], []], 4: [[], [7, 8], []], 5: [[9, 10], [], []], 6: [[1, 2], [4], []]}
    known = spark.createDataFrame([(k, sum(map(len, v)), k * 10, k * 100) for k, v in sets.items()], "rid bigint, n bigint, d1 bigint, d2 bigint")
    segments = spark.createDataFrame([(k * 10, k * 100, f, x) for k, v in sets.items() for f, x in enumerate(v) if not f or x],
                                     "d1 bigint, d2 bigint, fragment int, segment array<bigint>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a bigint, b bigint")
    assert sorted(map(tuple, op7.links(pairs, known, segments, 85, 3).collect())) == [(1, 2), (3, 4)]
    assert sorted(map(tuple, op7.links(pairs, known, segments, 50, 3).collect())) == [(1, 2), (1, 6), (2, 6), (3, 4)]


def test_sketch_of_few_hits_is_small(spark):
    """Counts of a task go compressed: n-grams that hit a third of the slots take well under a byte a slot, and merge exactly."""
    texts = [" ".join(f"w{k}x{j}" for j in range(20_000)) for k in range(2)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = list(op7._sketch(4, 16)(iter([batch])))
    assert sum(len(r) for b in out for r in b.column("counts").to_pylist()) < 1 << 15
    slots, counts = np.unique(np.concatenate(list(op7.sets_of(texts, 4))) >> np.uint64(48), return_counts=True)
    want = np.zeros(1 << 16, np.uint8)
    want[slots] = np.frexp(counts * 2.0)[1]
    merged = next(op7._merge(iter([*out, *out]))).to_pydict()
    assert merged["chunk"] == [0] and np.array_equal(np.frombuffer(merged["magnitude"][0], np.uint8), want)


def test_deduplicate(spark, docs, texts, none):
    left = op7.deduplicate(docs)
    assert left.columns == docs.columns
    want = {k for k, _, c in brute(list(enumerate(texts)), 5, 80) if c in (None, k)} | {k for k, t in enumerate(texts) if not (t or "").split()}
    ids = [r["doc_id"] for r in left.collect()]
    assert {*ids} == want and len(ids) == len(want)  # the row without an id is a copy of row 9, which stays
    assert op7.deduplicate(none).count() == 0 and op7.join(none, 4, 85).count() == 0


def test_deduplicate_tells_rows_apart_by_id_and_text(spark):
    """One id with two texts, copies without an id, repeated rows, clashing names, texts without words."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (3, c + " d"), (4, ""), (4, ""), (None, None), (5, b.upper()), (1, a)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id int, text string, th int")
    got = op7.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(
        map(str, [(1, a), (2, b), (3, c + " d"), (4, ""), (4, ""), (None, None)]))
    alone = spark.createDataFrame([(None, c), (None, c), (None, c + " d"), (9, a)], "doc_id int, text string")
    assert sorted(r["text"] for r in op7.deduplicate(alone).collect())[0] == a and op7.deduplicate(alone).count() == 2


def test_no_task_takes_two_python_workers(spark, docs, monkeypatch):
    most = []

    def chain(plan):
        """Python functions in a row on top of this plan, and of all below into ``most``."""
        kids = plan.children()
        n, name = max([chain(kids.apply(k)) for k in range(kids.size())], default=0), plan.nodeName()
        n = n + (name == "MapInArrow") if name in ("MapInArrow", "Project", "Filter", "Union", "Generate") else 0
        most.append(n)
        return n

    def watched(df, path):
        chain(df._jdf.queryExecution().optimizedPlan())
        return saved(df, path)

    monkeypatch.setattr(op7, "saved", watched)
    chain(op7.deduplicate(docs)._jdf.queryExecution().optimizedPlan())
    assert max(most) == 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, MEDIUM).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and after.exceptAll(docs).count() == 0
        docs = after
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    got = corpus_pipeline.token_ids(spark, docs, MEDIUM)
    assert got.count() == sizes[-1] == corpus_pipeline.run(spark, MEDIUM).count()
