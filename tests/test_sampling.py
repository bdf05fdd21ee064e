import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "a" if i < 60 else "b" if i < 90 else "c") for i in range(100)] + [(1000, None)]
    return spark.createDataFrame(data, "id long, label string").repartition(3)


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


CLASSES = {"a": range(60), "b": range(60, 90), "c": range(90, 100)}


def test_limit(rows):
    got = {(r["label"], r["id"]) for r in sampling.limit_per_class(rows, 20, "label", "id").collect()}
    assert got == {(k, i) for k, ids in CLASSES.items() for i in order(ids)[:20]}
    assert sampling.limit_per_class(rows, None, "label", "id").count() == 100


def test_fixed_split(rows):
    got = {(r["id"], r["split"]) for r in sampling.fixed_split(rows, 6, 3, "label", "id").collect()}
    assert got == {(i, "train" if k < 6 else "val") for ids in CLASSES.values() for k, i in enumerate(order(ids)[:9])}
    with pytest.raises(ValueError, match="'c' has 10 rows"):
        sampling.fixed_split(rows, 8, 3, "label", "id")


def test_ratio_split_is_exact(rows):
    got = sampling.ratio_split(rows, 0.25, "label", "id").groupBy("label", "split").count().collect()
    counts = {(r["label"], r["split"]): r["count"] for r in got}
    assert counts == {("a", "val"): 15, ("a", "train"): 45, ("b", "val"): 8, ("b", "train"): 22, ("c", "val"): 2, ("c", "train"): 8}


def test_ranks_run_through_buckets(rows):
    got = {(r["id"], r["rn"]) for r in sampling.ranked(rows, "label", "id").collect()}
    assert got == {(i, k + 1) for ids in CLASSES.values() for k, i in enumerate(order(ids))}


def test_rounds(rows):
    out = sampling.coverage_rounds(rows, 25, "label", "id").collect()
    assert len(out) == 3 * 3 * 25
    assert {r["id"] for r in out} == set(range(100))
    firsts = [r["id"] for r in sorted(out, key=lambda r: (r["round"], r["slot"])) if r["label"] == "a" and not r["refill"]]
    assert firsts == order(range(60))
    assert all(r["id"] in CLASSES[r["label"]] for r in out)
    assert sampling.coverage_rounds(rows, 25, "label", "id", max_rounds=1).count() == 75
    assert sampling.coverage_rounds(rows, 25, "label", "id", unique=True).count() == 100
    with pytest.raises(ValueError):
        sampling.coverage_rounds(rows, None, "label", "id")


def test_large_limits_rank_in_buckets(rows, monkeypatch):
    """Beyond the limit that Spark applies before the shuffle a class doesn't meet in one task, and the rows are the same."""
    want = sorted(map(tuple, sampling.first_per_class(rows, 20, "label", "id").select("id", "rn").collect()))
    monkeypatch.setattr(sampling, "SMALL_LIMIT", 10)
    assert sorted(map(tuple, sampling.first_per_class(rows, 20, "label", "id").select("id", "rn").collect())) == want


def test_empty(spark):
    none = spark.createDataFrame([], "id long, label string")
    assert sampling.coverage_rounds(none, 5, "label", "id").count() == 0
    assert sampling.ratio_split(none, 0.2, "label", "id").count() == 0
    assert sampling.fixed_split(none, 2, 1, "label", "id").count() == 0


def test_dispatch(rows):
    with pytest.raises(ValueError, match="split"):
        sampling.split(rows, sampling.Samples(split="other"))
    got = sampling.split(rows, sampling.Samples(train=2, val=1, per_class=None), "label", "id")
    assert got.count() == 9
    assert [r["idx"] for r in sampling.label_index(rows, "label").orderBy(F.col("label")).collect()] == [0, 1, 2]
