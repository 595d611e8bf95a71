"""Versioned stores: a crash before the pointer moves, two writers at once, readers of an old version, empty changes."""

import pytest
from pyspark.sql import functions as F

from feedloom.sources.versioned import KeyedStore

SCHEMA = "id string, v int"


def rows(df):
    return {r["id"]: r["v"] for r in df.collect()}


def test_versions(spark, tmp_path):
    s = KeyedStore(spark, f"{tmp_path}/s", "id", SCHEMA, buckets=4)
    make = lambda *kv: spark.createDataFrame([(k, v, v) for k, v in kv], "id string, v int, at int")
    assert rows(s.read()) == {} and s.versions() == []
    assert s.upsert(make(*((f"k{i}", i) for i in range(40)), ("../x", 1)), "at") == 1
    first = s.read()  # opened before what follows
    assert s.upsert(make(("k1", 100), ("k1", 90), ("new", 7)), "at") == 2
    assert rows(s.read())["k1"] == 100 and rows(s.read())["new"] == 7 and len(rows(s.read())) == 41
    assert rows(first) == {f"k{i}": i for i in range(40)} == rows(s.read(1))
    touched = {r[0] for r in s.read(2).select(F.input_file_name()).distinct().collect()} - {r[0] for r in s.read(1).select(F.input_file_name()).distinct().collect()}
    assert {f.split("__bucket=")[1].split("/")[0] for f in touched} == {str(r[0]) for r in make(("k1", 1), ("new", 1)).select(s._bucket()).collect()}

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):  # all rows are written, the pointer is not
        s.upsert(make(("k2", -1)), "at", before_commit=crash)
    assert s.versions() == [1, 2] and rows(s.read())["k2"] == 2

    seen = []

    def other():
        if not seen:
            seen.append(s.upsert(make(("k3", -3)), "at"))

    assert s.upsert(make(("k4", -4)), "at", before_commit=other) == 4 and seen == [3]  # it began again on what the other wrote
    now = rows(s.read())
    assert (now["k3"], now["k4"]) == (-3, -4)
    assert s.delete(make(("k3", 0), ("absent", 0))) == 5 and "k3" not in rows(s.read())
    assert s.upsert(make(("k5", 5)).limit(0), "at") == 6 and rows(s.read()) == {k: v for k, v in now.items() if k != "k3"}
    s.vacuum(keep=1)
    assert s.versions() == [6] and len(rows(s.read())) == 40
    with pytest.raises(Exception):
        s.read(1).collect()
