"""The entry module keeps the engine's queries when the training-data operators cannot be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(blocked: str) -> set[str]:
    code = (f"import sys; sys.modules[{blocked!r}] = None if {blocked!r} else sys; import __spark_entry__ as e; "
            "print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())")
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


def test_engine_queries_without_the_operators():
    engine = names("tidemark.llm")
    assert "pit_features" in engine and not any(n.startswith("op") and n[2].isdigit() for n in engine)
    assert names("corpus_pipeline") == engine
    assert names("ahocorasick") == engine or "op1_token_counts" in names("ahocorasick")
