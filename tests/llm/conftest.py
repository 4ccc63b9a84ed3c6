import random

import pytest

EDGE = [None, "", " \t\n", "one", "Zwei wörter", "a a a a a a a a", "x" * 5000, "日本語 テキスト", "▁ ▁a b"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases, copies, near copies, and a very long text."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.replace(base.split()[60], "changed")
    return [*EDGE, base, base, base.upper(), near, prose(rng, 80), prose(rng, 6000), base + "\n" + base + "\n" + base]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Repeated rows, a null id, and extra columns whose names clash with the operators' own."""
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", 1, "x", 2.0) for k, t in enumerate(texts)]
    rows += [rows[9], (None, texts[9], "en", "s1", 1, "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_tokens int, digest string, score double")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
