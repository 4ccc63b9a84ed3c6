"""Property test: nearest-rank percentiles equal the reference definition
for any mix of groups, duplicates and slice counts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from test_metrics import reference_percentile
from tidemark.operators.percentile import nearest_rank

values = st.lists(st.tuples(st.integers(0, 4), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=120)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=values, slices=st.sampled_from([None, 1, 3, 13]), p=st.sampled_from([1, 25, 50, 95, 99, 100]))
def test_nearest_rank_property(spark, rows, slices, p):
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["q"] for r in nearest_rank(df, ["g"], "v", {"q": p}, num_slices=slices).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert got == {g: reference_percentile(vs, p) for g, vs in groups.items()}
