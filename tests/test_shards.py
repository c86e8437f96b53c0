"""Hidden states as NumPy shards."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsonde.sources import shards as S

ROWS = [(t, layer, f"u{i}", [float(np.float32(i + layer / 7))] * (2 + layer)) for t in ("m", "n") for layer in (0, 3) for i in range(23)]


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "hidden")
    S.write_shards(spark.createDataFrame(ROWS, S.SCHEMA), path, 3)
    return path


def rows(df):
    return sorted((r["tag"], r["layer"], r["uid"], list(r["h"])) for r in df.collect())


def test_round_trip_and_layout(spark, stored, tmp_path):
    assert rows(S.read_shards(spark, stored)) == sorted(ROWS)
    names = sorted(p.name for p in (tmp_path / "hidden" / "m").iterdir())
    assert names == sorted([f"uids_{k}.json" for k in range(3)] + [f"h_{k}_L{n}.npy" for k in range(3) for n in (0, 3)])
    uids = json.loads((tmp_path / "hidden" / "m" / "uids_1.json").read_text())
    assert np.load(tmp_path / "hidden" / "m" / "h_1_L3.npy").shape == (len(uids), 5)
    assert not [p for p in (tmp_path / "hidden").iterdir() if p.name.startswith("_")]


def test_shards_written_by_numpy(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "uids_0.json").write_text(json.dumps(["a", "b"]))
    np.save(tmp_path / "x" / "h_0_L2.npy", np.arange(6, dtype=np.float16).reshape(2, 3))
    assert rows(S.read_shards(spark, str(tmp_path))) == [("x", 2, "a", [0.0, 1.0, 2.0]), ("x", 2, "b", [3.0, 4.0, 5.0])]
    np.save(tmp_path / "x" / "h_0_L3.npy", np.zeros((3, 1), np.float32))
    with pytest.raises(Exception, match="shape"):
        S.read_shards(spark, str(tmp_path)).collect()


def test_filters_choose_files(spark, stored):
    df = S.read_shards(spark, stored).filter("tag = 'm' AND layer IN (3, 9) AND uid > 'u1'")
    assert rows(df) == sorted(r for r in ROWS if r[0] == "m" and r[1] == 3 and r[2] > "u1")
    assert df.rdd.getNumPartitions() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter .*layer", plan) and re.search(r"Filter .*uid", plan)


def test_append_and_a_failed_write(spark, stored):
    S.write_shards(spark.createDataFrame([("m", 0, "new", [1.0, 2.0])], S.SCHEMA), stored, 1, "append")
    assert rows(S.read_shards(spark, stored)) == sorted([*ROWS, ("m", 0, "new", [1.0, 2.0])])
    bad = spark.createDataFrame([("m", 0, "z", [1.0])], S.SCHEMA).withColumn("uid", F.when(F.rand(1) > 2, "q").otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        S.write_shards(bad, stored, 1, "append")
    assert len(rows(S.read_shards(spark, stored))) == len(ROWS) + 1
