"""Perplexity, toxicity, the language model and decontamination against plain code."""

import math
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import op2_perplexity as op2
from tidemark.llm import op3_toxicity as op3
from tidemark.llm import op5_hmm as op5
from tidemark.llm import op10_decontaminate as op10
from tidemark.llm.common import Words


def of(texts, k):
    return texts[k if k is not None else 9] or ""


def test_word_hashes_tell_words_apart():
    raw = ["the cat  the\tdog", "", "cat " + "y" * (3 << 20)]
    w = Words([r.encode() for r in raw])
    assert [w.word(i).decode() for i in range(len(w))] == [x for r in raw for x in r.split()]
    assert w.first.tolist() == [0, 4, 4, 6]
    h = w.hashes
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 4
    assert Words([b"y" * (3 << 20)]).hashes[0] == h[5]


def test_base_columns(texts):
    n, chars, symbols, lines, again = op2.base_columns([t or "" for t in texts] + ["a#\n \na#\nb|c\n\n", "a b c a b c a"])
    for k, t in enumerate([t or "" for t in texts] + ["a#\n \na#\nb|c\n\n", "a b c a b c a"]):
        ws = t.encode().split()
        assert n[k] == len(ws) and chars[k] == sum(len(x.decode()) for x in ws)
        assert symbols[k] == sum(c in "#*$%&|<>" for c in t)
        held = [x for x in t.split("\n") if x.encode().split()]
        assert lines[k] == len(held) - len(set(held))
        three = Counter(zip(ws, ws[1:], ws[2:]))
        marked = {i + j for i, x in enumerate(zip(ws, ws[1:], ws[2:])) if three[x] > 1 for j in range(3)}
        assert again[k] == len(marked)


def test_grams_and_model_sum_to_one():
    raw = [b"abab", b"", b"b a\xc3\xa9"]
    h, bounds = op2.grams(raw)
    assert bounds.tolist() == [0, 5, 6, 12] and len(h) == 12
    for r, a, b in zip(raw, bounds, bounds[1:]):
        c = [0, 0, 0, *op2.CLASS[np.frombuffer(r, np.uint8)].tolist(), 0]
        assert h[a:b].tolist() == [c[i] << 18 | c[i + 1] << 12 | c[i + 2] << 6 | c[i + 3] for i in range(len(r) + 1)]
    rng = np.random.default_rng(0)
    h, _ = op2.grams([bytes(rng.choice(list(b"abcd ."), 4000).tolist()) for _ in range(3)])
    model = op2.Model(*np.unique(h, return_counts=True))
    for context in (0, int(h[100]) >> 6, 5 << 12):
        p = np.exp2(model.logs_of((context << 6) + np.arange(64)).astype(float))
        assert abs(p.sum() - 1) < 1e-4


def test_verdicts(spark, docs, texts, none):
    rows = op2.verdicts(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        ws = of(texts, r["doc_id"]).encode().split()
        assert r["n_words"] == len(ws) and r["base_failed"] == (len(ws) < 50 or 100 * r["n_repeat_words"] > 50 * len(ws))
        assert not (r["kept"] and r["base_failed"])
    assert op2.verdicts(none).count() == 0


def test_bands_reject_noise_and_loops(spark):
    rng = np.random.default_rng(2)
    syllables = ["ta", "ri", "mo", "sel", "ken", "du", "lor", "vi"]
    good = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(90)) + "." for _ in range(200)]
    noise = ["".join(chr(rng.integers(33, 126)) + (" " if k % 6 == 5 else "") for k in range(500)) for _ in range(2)]
    loop = [" ".join(f"{'$' * 6}{k % 10}{'$' * 6}" for k in rng.integers(0, 10, 90)) for _ in range(2)]
    docs = spark.createDataFrame([(k, t, "xx") for k, t in enumerate(good + noise + loop)], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in op2.verdicts(docs, group_bytes=1).where("kept").collect()}
    assert kept == set(range(200))


def test_bands_follow_the_spread_of_each_side(spark):
    """Skewed and narrow distributions: junk a few spreads out is rejected on both sides, the bulk stays."""
    rng = np.random.default_rng(6)
    z = np.clip(rng.normal(0, 1, 4000), -2.8, 2.8)
    bulk = 2 + np.where(z < 0, 0.02 * z, 0.03 * z)
    rows = [("xx", False, float(x)) for x in [*bulk, *[1.9] * 60, *[2.15] * 60]] + [("xx", True, 9.0)] * 4000
    (low, high), = op2.bands(spark.createDataFrame(rows, "lang string, base_failed boolean, log_ppl double")).values()
    assert 1.9 < low < bulk.min() and bulk.max() < high < 2.15


def test_toxicity_learns_from_its_folds_and_is_fair(spark):
    rng = np.random.default_rng(4)
    words = [f"w{''.join(rng.choice(list('abcdefg'), 5))}" for _ in range(300)]
    rows = []
    for k in range(600):
        toxic = k % 4 == 0
        t = list(rng.choice(words, 30)) + (["vilescum"] if toxic and k % 16 else [])
        if toxic and k % 3 == 0:
            t.append("muslim")  # the term goes with the label here, and must not carry it
        rows.append((k, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, None, "x"), (601, "", "x")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    fair, plain = op3.fit(docs, labels), op3.fit(docs, labels, penalty=0.0)
    neutral = ["the muslim neighbours wabcde", "the buddhist neighbours wabcde", "the neighbours wabcde"]
    gap = lambda m: float(np.ptp(np.log(m.scores(neutral) / (1 - m.scores(neutral)))))
    assert gap(fair) < 0.5 * gap(plain)
    got = {r["doc_id"]: r for r in op3.score(docs, fair).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None)
    held = [k for k, _, _ in rows if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == rows[k][2] for k in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    left = op3.clean(docs, fair)
    assert left.columns == docs.columns and left.count() == sum(1 - r["predicted"] for r in got.values())


def test_toxicity_without_labels_or_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in op3.score(docs, op3.fit(docs, empty)).collect()} == {0}
    assert op3.score(none, op3.fit(none, empty)).count() == 0


def test_swaps_stay_in_their_group():
    got = op3.swaps({"the", "gay", "man"})
    assert got and all(len(s) == 3 and "the" in s and (("gay" in s) != ("man" in s)) for s in got)


def plain_forward(m, symbols):
    a, total = m.start, 0.0
    for t, s in enumerate(symbols):
        a = (a if t == 0 else a @ m.move) * m.emit[s]
        total += math.log(a.sum())
        a = a / a.sum()
    return total


def test_forward_and_counts():
    rng = np.random.default_rng(6)
    m = op5.Hmm.initial(np.full(7, 1 / 7), 3)
    seqs = [rng.integers(0, 7, n) for n in (1, 40, 5, 17)]
    flat, bounds = np.concatenate(seqs), np.cumsum([0, 1, 40, 5, 17])
    assert np.allclose(op5.forward(m, flat, bounds), [plain_forward(m, s) for s in seqs])
    sums = op5.expected_counts(m, flat, bounds, np.array([True, False, True, True]))
    assert np.isclose(sums[:3].sum(), 3) and np.isclose(sums[3:6].sum(), 1)
    assert np.isclose(sums[6:15].sum(), 63 - 4) and np.allclose(sums[15:].reshape(7, 3).sum(1), np.bincount(flat, minlength=7))
    before = sum(plain_forward(m, s) for s in seqs)  # Baum-Welch without priors never lowers the likelihood
    k = 3
    start = sums[:3] + sums[3:6]
    move, emit = sums[6:15].reshape(k, k), sums[15:].reshape(7, k)
    new = op5.Hmm(start / start.sum(), start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    assert sum(plain_forward(new, s) for s in seqs) > before


def test_scores(spark, docs, texts, none):
    got = op5.language_model(docs, classes=8, head=20, rounds=2).collect()
    rows = [(k, (t or "").encode().lower().split() + ["<end>"]) for k, t in enumerate(texts)]
    rows += [rows[9], (None, rows[9][1])]
    learned = [ws for k, ws in rows if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for ws in learned for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        ws = dict(rows)[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert np.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0
    assert op5.language_model(none).count() == 0


def test_word_beyond_the_head_is_scored_by_its_class(spark):
    docs = spark.createDataFrame([(k, "a a b c d e f g h") for k in range(2, 30)], "doc_id bigint, text string")
    small = {r["doc_id"]: r["score"] for r in op5.language_model(docs, classes=4, head=4, rounds=1).collect()}
    large = {r["doc_id"]: r["score"] for r in op5.language_model(docs, classes=4, head=100, rounds=1).collect()}
    assert all(np.isclose(small[k], large[k]) for k in small)


def least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = np.random.default_rng(8)
    for _ in range(200):
        p = "".join(rng.choice(list("abc "), rng.integers(1, 90)))
        t = "".join(rng.choice(list("abc "), rng.integers(0, 130)))
        assert op10.Pattern(p).least(t, 99) == least_edits(p, t)


def test_matches_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    items = ["".join(rng.choice(list("abcde "), n)) for n in (5, 30, 60, 120, 240)]
    rows = [None, "", "abc"]
    for _ in range(60):
        s = list(items[rng.integers(len(items))])
        for _ in range(rng.integers(0, 14)):
            at = rng.integers(len(s))
            s[at:at + 1] = list(rng.choice(list("abcde"), rng.integers(0, 3)))
        filler = ["".join(rng.choice(list("abcde \n"), 80)) for _ in range(2)]
        rows.append(filler[0] + "".join(s).upper() + filler[1])
    docs = spark.createDataFrame(list(enumerate(rows)) + [(None, rows[5])], "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (90, None), (91, "  ")], "item_id bigint, text string")
    want = Counter()
    for k, t in [*enumerate(rows), (None, rows[5])]:
        for i, p in enumerate(items):
            p, budget = op10.normalised(p), int(op10.RATE * len(op10.normalised(p)))
            d = least_edits(p, op10.normalised(t or ""))
            if d <= budget:
                want[k, i, d, budget] += 1
    for block in (1 << 20, 100):
        assert Counter(map(tuple, op10.matches(docs, bench, block_chars=block).collect())) == want
    left = op10.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {*range(len(rows)), None} - {k[0] for k in want}


def test_decontamination_of_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert op10.matches(docs, bench).count() == 0 and op10.clean(docs, bench).count() == docs.count()
    assert op10.matches(none, spark.createDataFrame([(1, "abc")], "item_id bigint, text string")).count() == 0
