"""Image metadata: the CSV scan and the lookup of image files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that an error lists.
SHOWN = 5
#: Images that are read by a list of paths at most.
LISTED = 20_000


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, dx`` of a metadata CSV with a header, as strings whatever the other columns are."""
    names = spark.read.option("header", True).csv(path).columns
    for wanted in ("image_id", "dx"):
        if wanted not in names:
            raise ValueError(f"{path} has no column {wanted}")
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", True).csv(path).select("image_id", "dx")


def list_files(spark: SparkSession, roots: Sequence[str], suffix: str = ".jpg") -> DataFrame:
    """``image_id, path, root_rank`` of the images under each root; contents aren't read."""
    parts = []
    for rank, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(root)
        name = F.regexp_extract("path", r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
        parts.append(files.select(name.alias("image_id"), "path", F.lit(rank).alias("root_rank")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def resolve(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """``metadata`` with ``image_path``: of equal names the file of the first root. Null where there is no file."""
    first = files.groupBy("image_id").agg(F.min_by("path", F.struct("root_rank", "path")).alias("image_path"))
    return metadata.join(first, "image_id", "left")


def missing(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``metadata`` without a file."""
    return metadata.join(files.select("image_id").distinct(), "image_id", "left_anti")


def load(spark: SparkSession, csv: str, roots: Sequence[str]) -> DataFrame:
    """``image_id, dx, image_path``. Files that are missing are an error that tells how many and which first."""
    metadata, files = scan(spark, csv), list_files(spark, roots)
    lost = missing(metadata, files)
    shown = [r["image_id"] for r in lost.orderBy("image_id").limit(SHOWN).collect()]
    if shown:
        raise FileNotFoundError(f"{lost.count()} images are missing, the first: {', '.join(map(str, shown))}")
    return resolve(metadata, files).select("image_id", "dx", "image_path")


def read_images(spark: SparkSession, rows: DataFrame, roots: Sequence[str], partitions: int | None = None, listed: int = LISTED) -> DataFrame:
    """``rows`` (with ``image_path``; a table) and ``image``, decoded on the executors by Spark's image source. Up to
    ``listed`` images are read by their paths, so that no other file is opened; more are read as whole folders and joined,
    since their paths would fill the driver. The rows are dealt out for the feature kernel."""
    paths = [r[0] for r in rows.select("image_path").distinct().limit(listed + 1).collect()]
    source = spark.read.format("image").option("dropInvalid", False)
    images = None
    if len(paths) <= listed and not any(set(p) & set("*?[]{}\\") for p in paths):
        images = source.load(paths) if paths else source.schema("image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>").load(list(roots)).limit(0)
    else:
        for root in roots:
            part = source.option("pathGlobFilter", "*.jpg").load(root)
            images = part if images is None else images.unionByName(part)
    clean = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  one spelling of local addresses
    keyed = images.select(clean(F.col("image.origin")).alias("_path"), "image")
    out = rows.withColumn("_path", clean(F.col("image_path"))).join(keyed, "_path").drop("_path")
    return out.repartition(partitions) if partitions else out
