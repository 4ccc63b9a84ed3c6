"""Every byte of a text counts in its perplexity, and long models come in stretches."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import op2_perplexity as op2

GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def greek(rng, syllables):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(90)) + "."


def disguised(rng, text):
    """Other letters in the place of each, of the same symbol class of bytes."""
    same = defaultdict(list)
    for x in GREEK:
        same[tuple(op2.CLASS[list(x.encode())])].append(x)
    return "".join(rng.choice(same[tuple(op2.CLASS[list(x.encode())])]) if x in GREEK else x for x in text)


def test_symbols_of_a_class_are_told_apart(spark):
    rng = np.random.default_rng(8)
    good = [greek(rng, ["τα", "ρι", "μο", "σελ", "κεν", "δυ", "λορ", "βι"]) for _ in range(200)]
    other = [disguised(rng, t) for t in good[:3]]
    for a, b in zip(good, other):
        assert a != b and np.array_equal(op2.grams([a.encode()])[0], op2.grams([b.encode()])[0])
    docs = spark.createDataFrame([(k, t, "el") for k, t in enumerate(good + other)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in op2.verdicts(docs).collect()}
    kept = {k for k, r in got.items() if r["kept"]}
    assert len(kept) >= 198 and kept.isdisjoint({200, 201, 202})
    for k in range(3):
        assert got[200 + k]["class_ppl"] == got[k]["class_ppl"] and got[200 + k]["log_ppl"] > got[k]["log_ppl"] + 0.5


def test_case_digits_and_marks_count(spark):
    texts = ["the 1st of 3 dogs, (all) ran"] * 20 + ["THE 1st of 3 dogs, (all) ran", "the 9st of 3 dogs, (all) ran", "the 1st of 3 dogs, [all} ran"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["log_ppl"] for r in op2.scored(docs).collect()}
    assert len({got[k] for k in range(20)}) == 1
    assert all(got[k] > got[0] + 0.1 for k in (20, 21, 22))


def test_perplexity_by_plain_code(spark):
    rng = np.random.default_rng(9)
    texts = ["", "\x00a\x00", "Zwei wörter", "日本語 テキスト", *("".join(rng.choice(list("abAB é5#"), 60)) for _ in range(12))]
    docs = spark.createDataFrame([(k, t, "xx") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in op2.scored(docs).collect()}
    byte_of = lambda s: 38 if s == 255 else 0 if s == 0 else int(op2.CLASS[s])
    windows = []
    for t in texts:
        s = [0, 0, 0, *(x or 255 for x in t.encode()), 0]
        windows.append([tuple(s[i:i + 4]) for i in range(len(s) - 3)])
    n = Counter(w for ws in windows for w in ws)
    ends = Counter(w[3] for ws in windows for w in ws)
    by_class = Counter()
    for s in range(256):
        by_class[byte_of(s)] += ends[s] + 1
    folded = Counter()
    for w, k in n.items():
        folded[sum(byte_of(x) << 6 * (3 - i) for i, x in enumerate(w))] += k
    keys = np.array(sorted(folded))
    classes = op2.Model(keys, np.array([folded[k] for k in keys]))
    d = op2.discounts(np.array(list(n.values())))
    of = defaultdict(list)
    for w, k in n.items():
        of[w[:3]].append(k)
    for k, ws in enumerate(windows):
        bits = shape = 0.0
        for w in ws:
            c = float(classes.logs_of(np.array([sum(byte_of(x) << 6 * (3 - i) for i, x in enumerate(w))]))[0])
            total, off = sum(of[w[:3]]), sum(d[min(x, 3)] for x in of[w[:3]])
            share = (ends[w[3]] + 1) / by_class[byte_of(w[3])]
            bits -= math.log2((n[w] - d[min(n[w], 3)]) / total + off / total * 2**c * share)
            shape -= c
        assert got[k]["log_ppl"] == pytest.approx(bits / len(ws), abs=1e-5)
        assert got[k]["class_ppl"] == pytest.approx(shape / len(ws), abs=1e-5)


def test_bytes_sum_to_one():
    rng = np.random.default_rng(10)
    raw = [bytes(rng.choice(list(b"abAB \xc3\xa9"), 3000).tolist()) for _ in range(2)]
    h, _ = op2.grams(raw, op2.BYTES, 8)
    classes = op2.Model(*np.unique(op2.grams(raw)[0], return_counts=True))
    assert np.array_equal(op2.class_grams(h), op2.grams(raw)[0])
    keys, n = np.unique(h, return_counts=True)
    model = op2.Bytes(keys, n, op2.discounts(n), classes, op2.members(np.bincount(h & 255, minlength=256)))
    for context in (0, int(h[100]) >> 8, 5 << 16):
        p = np.exp2(model.logs_of(((context << 8) + np.arange(256)).astype(np.uint32))[0].astype(float))
        assert abs(p.sum() - 1) < 1e-4


def test_stretches_give_the_same(spark, docs, none):
    whole, some = rows(op2.scored(docs)), rows(op2.scored(docs, stretch=300))
    assert len(whole) == len(some) == docs.count()
    for a, b in zip(whole, some):
        assert a[:8] == b[:8] and b[8:] == pytest.approx(a[8:], abs=1e-9)
    assert op2.scored(none, stretch=300).count() == 0
