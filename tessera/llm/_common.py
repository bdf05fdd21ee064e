"""Shared plumbing of the training-data operators: scratch tables and Arrow text buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python kernel takes at once; a single longer text is taken alone and whole.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a kernel.
BATCH_BYTES = 4 << 20

_own_root: dict[str, str] = {}
_made: list[str] = []


def configure(spark: SparkSession) -> None:
    """Session settings that queries and pipeline stages want; they say nothing about results. Arrow batches are bounded
    by bytes as well as rows, so that a kernel's memory doesn't depend on the rows' sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``). Where that is unset, a local master gets a folder of
    our own and any other an error: executors of a cluster can't see each other's temporary folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_root:
            folder = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, folder, True)
            _own_root[app] = "file://" + folder
        root = _own_root[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back: lineage is cut,
    nothing is computed twice, and a lost executor costs only a re-read."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read any more."""
    if table._scratch in _made:
        _made.remove(table._scratch)
        _delete(table.sparkSession, table._scratch)


def scratch_mark() -> int:
    """How many scratch tables there are; what is made later can be purged alone."""
    return len(_made)


def purge_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the scratch tables made by this process after ``since``, but those that ``keep`` still reads. Call when no
    other DataFrame from these operators is needed any more."""
    read = keep.inputFiles() if keep is not None else []
    needed = {p for p in _made[since:] if any(f"/{p.rpartition('/')[2]}/" in f for f in read)}
    for path in [p for p in _made[since:] if p not in needed]:
        _made.remove(path)
        _delete(spark, path)


#: Keys that count as hot at most, and over how many groups each one's rows are dealt.
HOT_KEYS, SALTS = 1024, 128


def skew_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, spread: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each ``key``, ``count`` of whose ``rows`` have it, ``total`` in all). Keys
    with more than ``total / HOT_KEYS`` rows, of which there can't be more than ``HOT_KEYS``, are broadcast as such; their
    rows, and rows without a key, are dealt over ``SALTS`` groups by a hash of the columns ``spread``, and their fact is
    repeated for each group. So no key's rows meet in one task, and what is broadcast is bounded at any size."""
    salt, hot = free_name(rows, "__salt"), free_name(rows, "__hot")
    big = F.col(count) > max(total // HOT_KEYS, 1)
    marked = rows.join(F.broadcast(facts.where(big).select(key, F.lit(True).alias(hot))), key, "left")
    dealt = marked.withColumn(salt, F.when(F.col(hot) | F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")).drop(hot)
    told = facts.withColumn(salt, F.explode(F.when(big, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(told, [key, salt], how).drop(salt)


def quoted(names: list[str]) -> list[F.Column]:
    """Columns by their whole names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with as many underscores as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)``. ``configure`` bounds the batches' bytes; kernels cut them with ``slices`` anyway."""
    return df.mapInArrow(run, schema)


def with_column(docs: DataFrame, text: str, name: str, kind: T.DataType, compute: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """All columns of ``docs``, whatever their names are, and ``name``: what ``compute`` makes of the column ``text``."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, plain[at]):
                column = part.column(at)
                yield pa.RecordBatch.from_arrays([*part.columns, compute(column.cast(pa.string()) if column.type != pa.string() else column)], [*plain, "added"])

    fields = [T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)]
    return map_batches(docs.toDF(*plain), run, T.StructType([*fields, T.StructField("added", kind)])).toDF(*docs.columns, name)


def hash_bound(share: float) -> int:
    """The signed 64-bit number that a share of all hashes doesn't exceed."""
    return (1 << 63) - 1 if share >= 1 else int((2 * max(share, 0.0) - 1) * ((1 << 63) - 1))


def bounded_sample(rows: DataFrame, salt: int, most: int, limit: int, few: bool = False) -> DataFrame:
    """``o, size, label, text`` of at most ``most`` ids and ``limit`` text bytes in all, in the order ``o`` of a hash of the
    id. ``rows`` has ``doc_id, label, text``; an id that repeats gives its shortest text, smallest label and first text.
    Texts of more than a 64th of ``limit`` are no candidates, and one that would pass the limit is left out, so that long
    texts neither end nor fill the sample. The driver sees ids' hashes and sizes only. ``few`` says that ``rows`` has few ids
    anyway, so that they needn't be counted first."""
    o = F.xxhash64("doc_id", F.lit(salt))
    small = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= limit // 64))
    n = 0 if few else small.agg(F.approx_count_distinct("doc_id")).first()[0]
    near = small.where(o <= hash_bound(1.2 * most / max(n, 1))).select("doc_id", F.struct(F.octet_length("text").alias("size"), "label", "text").alias("r"))
    one = materialize(near.groupBy("doc_id").agg(F.min("r").alias("r")).select(o.alias("o"), "r.*"), "sample")
    chosen, used = [], 0
    for row in one.select("o", "size").orderBy("o", "size").limit(most).collect():
        if used + row["size"] <= limit:
            used += row["size"]
            chosen.append((row["o"],))
    return one.join(F.broadcast(rows.sparkSession.createDataFrame(chosen, "o long").distinct()), "o", "left_semi")


def crc_of_id(column: str = "doc_id") -> F.Column:
    """CRC-32 of the decimal text of an id, the fold key of the learning operators."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, followed by 32 zero bytes, and the n + 1 offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.zeros(last - first + 32, dtype=np.uint8)
    if last > first:
        data[: last - first] = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=last)[first:]
    return data, offsets - first


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes each (one row at least), so that the
    working memory of a kernel depends on the longest text and not on the batch."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
