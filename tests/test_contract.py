"""Contract reading, lint, order and coercion."""

import json
import os

import pytest
from pyspark.sql import Row

from tidemark.operators import contract as con

TIDE = con.Contract("tide-3", "buoy", (("depth_m", "float32"), ("swell", "int32"), ("zone", "str"),
                                       ("calm", "bool"), ("speed_kn", "float64")), "drift")


def buoys(spark, *rows):
    return spark.createDataFrame(rows, "zone string, speed_kn double, swell double, calm int, depth_m string, note string")


def test_projection_takes_the_contract_order_and_nothing_else(spark):
    df = buoys(spark, ("north", 4.5, 2.0, 0, "11.25", "x"), ("south", None, 7.9, 1, "3", None))
    assert con.vector(df, TIDE, keep=["note"]).columns == ["note", "depth_m", "swell", "zone", "calm", "speed_kn"]


def test_every_dtype_of_one_row(spark):
    r = con.coerce(buoys(spark, ("north", 4.5, -2.9, 3, "11.25", "x")), TIDE, strict=True).collect()[0]
    assert (r["depth_m"], r["swell"], r["zone"], r["calm"], r["speed_kn"]) == (11.25, -2, "north", True, 4.5)
    assert (r["dtype_status"], r["error_feature"]) == ("ok", None)


@pytest.mark.parametrize("absent", ["depth_m", "calm", "speed_kn"])
def test_a_frame_without_a_declared_feature_is_refused(spark, absent):
    with pytest.raises(con.FeatureParityError, match=absent):
        con.coerce(buoys(spark).drop(absent), TIDE, strict=False)


def test_the_first_failing_feature_in_contract_order_is_named(spark):
    df = buoys(spark, ("a", 1.0, float("inf"), 0, "deep", "both"), ("b", 1.0, float("nan"), 0, "1", "swell only"),
               ("c", 1.0, 3e9, 0, "1", "too large for int32"), ("d", 1.0, 1.0, 0, "1e1", "fine"))
    got = {r["note"]: r["error_feature"] for r in con.coerce(df, TIDE, strict=False, keep=["note"]).collect()}
    assert got == {"both": "depth_m", "swell only": "swell", "too large for int32": "swell", "fine": None}


def test_missing_values_by_mode(spark):
    df = buoys(spark, (None, None, None, None, None, None))
    strict = con.coerce(df, TIDE, strict=True).collect()[0]
    assert (strict["error_feature"], strict["zone"], strict["calm"]) == ("swell", "None", False)
    loose = con.coerce(df, TIDE, strict=False).collect()[0]
    assert loose["dtype_status"] == "ok" and all(loose[n] is None for n in TIDE.names)


def test_integer_text_and_truthy_text(spark):
    c = con.Contract("v", "k", (("n", "int64"), ("t", "bool")), "t")
    df = spark.createDataFrame([("5", "False"), ("3.9", "")], "n string, t string")
    a, b = con.coerce(df, c, strict=False).collect()
    assert (a["n"], a["t"], a["error_feature"]) == (5, True, None)
    assert (b["n"], b["t"], b["error_feature"]) == (None, False, "n")


def test_a_contract_without_features_and_a_folder_of_two(spark, tmp_dir):
    _write(tmp_dir, "none.json", {"version": "v0", "entity_key": "k", "target": "y", "features": []})
    _write(tmp_dir, "one.json", {"version": "v1", "entity_key": "k", "target": "y",
                                 "features": [{"name": "a", "dtype": "int32"}]})
    both = con.read_contracts(spark, tmp_dir)
    assert con.lint_contracts(both).count() == 0
    empty = con.collect_contract(both.where(both.source_file.endswith("none.json")))
    assert empty.names == [] and con.coerce(buoys(spark), empty, strict=True).columns == ["error_feature", "dtype_status"]
    with pytest.raises(con.FeatureParityError, match="one contract file"):
        con.collect_contract(both)


def _write(tmp_dir, name, obj):
    p = os.path.join(tmp_dir, name)
    with open(p, "w") as fh:
        json.dump(obj, fh)
    return p


def test_read_and_lint_contracts(spark, tmp_dir):
    _write(tmp_dir, "good.json", {"version": "v1", "entity_key": "station_id", "target": "y",
                                  "features": [{"name": "a", "dtype": "float64"}, {"name": "b", "dtype": "int32"}]})
    _write(tmp_dir, "dup.json", {"version": "v1", "entity_key": "station_id", "target": "y",
                                 "features": [{"name": "a", "dtype": "float64"}, {"name": "a", "dtype": "float64"},
                                              {"name": " ", "dtype": "float128"}]})
    _write(tmp_dir, "env.json", {"version": "v1", "features": [{"name": "x", "dtype": "float64"}]})
    entries = con.read_contracts(spark, tmp_dir)
    found = {(os.path.basename(r["source_file"]), r["name"], r["rule"])
             for r in con.lint_contracts(entries).collect()}
    assert ("dup.json", "a", "duplicate_name") in found
    assert ("dup.json", " ", "blank_name") in found
    assert ("dup.json", " ", "unknown_dtype") in found
    assert ("env.json", None, "missing_entity_key") in found and ("env.json", None, "missing_target") in found
    assert not any(f[0] == "good.json" for f in found)
    good = con.collect_contract(entries.where(entries.source_file.endswith("good.json")))
    assert good.names == ["a", "b"] and good.entity_key == "station_id"
    with pytest.raises(con.FeatureParityError):
        con.collect_contract(entries.where(entries.source_file.endswith("dup.json")))
