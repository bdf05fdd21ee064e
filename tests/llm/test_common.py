import pytest
from pyspark.sql import functions as F

from tessera.llm import _common


@pytest.fixture
def plain(spark):
    """Sort-merge joins over eight partitions, as a large cluster would plan them."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hot_key_is_dealt_over_partitions(plain):
    """90 % of the rows have one key and 5 % none: the largest partition stays near the mean."""
    rows = plain.range(20_000).select("id", F.expr("case when id % 20 = 0 then null when id % 20 < 19 then 'hot' else concat('k', id % 97) end").alias("key"))
    rows = _common.materialize(rows, "rows")
    facts = _common.materialize(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")), "facts")
    out = _common.skew_join(rows, facts, "key", "n", 20_000, ["id"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 8
    assert out.columns == ["key", "id", "n", "first"] or set(out.columns) == {"key", "id", "n", "first"}
    want = {tuple(r) for r in rows.join(facts, "key", "left").select("id", "key", "n", "first").collect()}
    assert {tuple(r) for r in out.select("id", "key", "n", "first").collect()} == want
    assert _common.skew_join(rows, facts, "key", "n", 20_000, ["id"], "inner").count() == 19_000


def test_samples_are_bounded_by_bytes(spark):
    """Long texts and ids that repeat neither fill nor end the sample."""
    rows = [(k, "a", "word " * (k % 7 + 1)) for k in range(300)] + [(1000, "b", "x" * 5000), (1001, "b", None), (None, "b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, label string, text string").union(spark.range(3000).selectExpr("7L", "'a'", "'word word'"))
    got = _common.bounded_sample(docs, 3, 100, 64_000).collect()
    assert len(got) == 100 == len({r["o"] for r in got}) and max(r["size"] for r in got) <= 1000
    tight = _common.bounded_sample(docs, 3, 300, 1280).collect()
    assert 1200 < sum(r["size"] for r in tight) <= 1280
    assert _common.bounded_sample(docs.limit(0), 3, 10, 640).count() == 0


def test_scratch_tables(spark):
    import glob

    mark = _common.scratch_mark()
    one, two = (_common.materialize(spark.range(3), "t") for _ in range(2))
    held = two.where("id > 0")
    _common.purge_scratch(spark, mark, held)
    assert held.count() == 2 and not glob.glob(one._scratch.removeprefix("file://"))
    _common.purge_scratch(spark, mark)
    assert not glob.glob(two._scratch.removeprefix("file://")) and _common.scratch_mark() == mark


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        _common.scratch_root(Session())
