"""The store of buckets: only touched ones are written, failures leave the version before, versions can be read."""

import os

import pytest
from pyspark.sql import functions as F

from unitgraph.plans.store import FILE, Store

SCHEMA = "repo_id bigint, file_path string, qualified_name string, body string"


def files_below(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows(spark, files, body):
    made = spark.createDataFrame([(r, f) for r, f in files], "repo_id bigint, file_path string")
    return made.select(*FILE, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("qualified_name"), F.lit(body).alias("body"))


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"), {"units": SCHEMA, "hashes": "repo_id bigint, file_path string, hash string"}, buckets=16)
    first = rows(spark, [(k % 3, f"f{k}") for k in range(200)], "old")
    made.replace(first, {"units": first, "hashes": first.select(*FILE).distinct().withColumn("hash", F.lit("0"))})
    return made


def content(store, name="units", version=None):
    return sorted(map(tuple, store.read(name, version).collect()))


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    before, old = files_below(tmp_path), content(store)
    fresh = rows(spark, [(1, "f1")], "new")
    touched = spark.createDataFrame([(1, "f1"), (2, "f2"), (9, "nowhere")], "repo_id bigint, file_path string")
    written = store.replace(touched, {"units": fresh})
    after = files_below(tmp_path)
    assert len(written) <= 3 and {k: after[k] for k in before} == before and len(after) - len(before) <= 3
    assert content(store) == sorted([r for r in old if r[:2] not in ((1, "f1"), (2, "f2"))] + [(1, "f1", "a", "new"), (1, "f1", "b", "new")])
    assert content(store, version=0) == old and store.read("hashes").count() == 200
    assert Store(spark, store.folder, store.tables, buckets=99).buckets == 16
    assert sorted(map(tuple, store.read_files("units", touched).collect())) == [(1, "f1", "a", "new"), (1, "f1", "b", "new")]


def test_rows_outside_the_files_are_left_out(spark, store):
    old = content(store)
    assert store.replace(rows(spark, [(1, "f1")], ""), {"units": rows(spark, [(1, "f4")], "new")})
    assert content(store) == [r for r in old if r[:2] != (1, "f1")]


def test_a_failed_write_leaves_the_version_before(spark, store):
    old = content(store)
    boom = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        store.replace(rows(spark, [(1, "f1")], ""), {"units": rows(spark, [(1, "f1")], "new").withColumn("body", boom("body"))}, ("w", 5))
    assert content(store) == old and not store.done(("w", 5))
    store.replace(rows(spark, [(1, "f1")], ""), {"units": rows(spark, [(1, "f1")], "new")}, ("w", 5))
    assert (1, "f1", "a", "new") in content(store) and store.done(("w", 5)) and store.done(("w", 4)) and not store.done(("w", 6))
    assert store.replace(rows(spark, [(1, "f1")], ""), {"units": rows(spark, [(1, "f1")], "newest")}, ("w", 5)) == []


def test_a_second_writer_fails(spark, store, monkeypatch):
    monkeypatch.setattr(store, "versions", lambda: [])
    with pytest.raises(RuntimeError, match="another run"):
        store._switch(0, {})


def test_delete_clean_and_empty(spark, store, tmp_path):
    store.delete_repositories(spark.createDataFrame([(1,)], "repo_id bigint"))
    assert {r[0] for r in content(store)} == {0, 2} == {r[0] for r in content(store, "hashes")}
    for k in range(4):
        store.replace(rows(spark, [(0, "f0")], ""), {"units": rows(spark, [(0, "f0")], str(k))})
    kept = content(store)
    gone = store.clean()
    assert gone and len(store.versions()) == 3 and content(store) == kept and (0, "f0", "a", "3") in kept
    assert store.replace(spark.createDataFrame([], "repo_id bigint, file_path string"), {"units": store.read("units").limit(0)}) == []
    empty = Store(spark, str(tmp_path / "other"), {"units": SCHEMA})
    assert empty.read("units").count() == 0 and empty.delete_repositories(spark.createDataFrame([(1,)], "repo_id bigint")) == []
    nulls = spark.createDataFrame([(None, None, "q", None), (1, None, "r", "x")], SCHEMA)
    empty.replace(nulls, {"units": nulls})
    assert empty.read("units").count() == 0  # rows without a repository and a file belong to no file


def test_changed_files_are_found_once(spark, store, tmp_path):
    """However many tables a change has: what it asks for isn't computed again, and nothing of it stays."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    files = spark.createDataFrame([(k % 3, f"f{k}") for k in range(50)], "repo_id bigint, file_path string").mapInPandas(tell, "repo_id bigint, file_path string")
    fresh = rows(spark, [(k % 3, f"f{k}") for k in range(50)], "new")
    store.replace(files, {"units": fresh, "hashes": fresh.select(*FILE).distinct().withColumn("hash", F.lit("1"))})
    assert seen.value == 50 and store.read("units").where("body = 'new'").count() == 100 and store.read("hashes").count() == 200
    assert os.listdir(tmp_path / "store" / "asked") == []
