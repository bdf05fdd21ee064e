"""One query for each operator, over the test tables, and the same in DuckDB's SQL.

Stand-ins: an embedding is a feature vector, and scaled to 0..255 an 8 x 8 plane whose mask is u > 127; three vectors
with following ids are a colour plane; ``documents.lang`` is an imbalanced class; pages are ids of image files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import learners
from ..functions.features import Texture, feature_columns
from ..operators import balancing, metrics, sampling, scaling, thresholds
from ..sources import metadata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``id, label, features``: near-balanced classes 0 to 9."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"))


def lang_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``id, label, features`` with the language as an imbalanced class."""
    docs = table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return vectors(spark, d).drop("label").join(docs, "id").select("id", "label", "features")


def langs(spark: SparkSession, d: str) -> DataFrame:
    """``id, label`` of all documents with a language."""
    return table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))


LD = "ld AS (SELECT doc_id AS id, lang AS label FROM documents WHERE lang IS NOT NULL)"
V = "v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"
LV = "lv AS (SELECT e.vec_id AS id, d.lang AS label, CAST(e.embedding AS DOUBLE[]) AS features FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.lang IS NOT NULL)"


def _key(id_: str = "id") -> str:
    return f"md5('42:' || {id_})"


@query("""SELECT CAST(row_number() OVER (ORDER BY g, n) - 1 AS INTEGER) AS pos, name FROM (
  SELECT 0 AS g, i AS n, 'lbp_roi_' || i AS name FROM range(256) r(i) UNION ALL SELECT 1, i, 'lbp_bimf1_' || i FROM range(256) r(i)
  UNION ALL SELECT 2, i, 'glcm_' || ['contrast', 'homogeneity', 'energy', 'correlation'][i + 1] FROM range(4) r(i)
  UNION ALL SELECT 3 + c, i, 'hsv_' || ['h', 's', 'v'][c + 1] || '_' || i FROM range(3) t(c), range(24) r(i) WHERE c = 0 OR i < 8
  UNION ALL SELECT 6, i, 'abcd_' || ['asymmetry', 'border_irregularity', 'color_var', 'diameter'][i + 1] FROM range(4) r(i))""")
def feature_names(spark, d):
    """Names and places of the 560 features."""
    return spark.createDataFrame(list(enumerate(feature_columns(Texture()))), "pos int, name string")


# --- samples and splits ---------------------------------------------------------------------------------------------


@query(f"WITH {LD} SELECT label AS class, count(*) AS count FROM ld GROUP BY label")
def class_distribution(spark, d):
    return sampling.class_counts(langs(spark, d), "label").orderBy("class")


@query(f"WITH {V}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key()}, id) AS rn FROM v) SELECT id, label FROM r WHERE rn <= 20")
def limit_per_class(spark, d):
    return sampling.limit_per_class(vectors(spark, d).select("id", "label"), 20, "label", "id")


_SPLIT = f"WITH {V}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key()}, id) AS rn FROM v), s AS (SELECT id, label, CASE WHEN rn <= 14 THEN 'train' ELSE 'val' END AS split FROM r WHERE rn <= 23)"


@query(f"{_SPLIT} SELECT * FROM s")
def sample_fixed_split(spark, d):
    return sampling.fixed_split(vectors(spark, d).select("id", "label"), 14, 9, "label", "id", 23)


@query(f"{_SPLIT} SELECT label, split, count(*) AS n FROM s GROUP BY label, split")
def split_class_counts(spark, d):
    return sample_fixed_split(spark, d).groupBy("label", "split").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT doc_id AS id, lang AS label FROM documents WHERE lang IS NOT NULL),
c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM d GROUP BY label),
b AS (SELECT label, n, ceil(t * 0.2) AS want, floor(n * ceil(t * 0.2) / t) AS base, n * ceil(t * 0.2) / t - floor(n * ceil(t * 0.2) / t) AS rest FROM c),
a AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, n DESC, label) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS n_val FROM b),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key()}, id) AS rn FROM d)
SELECT id, label, CASE WHEN rn <= n_val THEN 'val' ELSE 'train' END AS split FROM r JOIN a USING (label)""")
def stratified_ratio_split(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return sampling.ratio_split(docs, 0.2, "label", "id").select("id", "label", "split")


_ROUNDS = f"""WITH {LD}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key()}, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM ld),
k AS (SELECT CAST(ceil(max(n) / 25.0) AS BIGINT) AS rounds FROM r),
slots AS (SELECT label, n, unnest(range(rounds)) AS round FROM (SELECT DISTINCT label, n FROM r), k),
cells AS (SELECT label, n, round, unnest(range(25)) AS slot FROM slots),
picked AS (SELECT label, round, slot, round * 25 + slot >= n AS refill,
  CASE WHEN round * 25 + slot < n THEN round * 25 + slot + 1 ELSE CAST('0x' || substr(md5('42:' || label || ':' || round || ':' || slot), 1, 8) AS BIGINT) % n + 1 END AS rn FROM cells),
rows_ AS (SELECT CAST(p.round AS INTEGER) AS round, CAST(p.slot AS INTEGER) AS slot, p.label, r.id, p.refill FROM picked p JOIN r USING (label, rn))"""


@query(f"{_ROUNDS} SELECT * FROM rows_")
def coverage_rounds(spark, d):
    return sampling.coverage_rounds(langs(spark, d), 25, "label", "id")


@query(f"{_ROUNDS} SELECT round, label, count(*) AS n, count(DISTINCT id) AS n_ids FROM rows_ GROUP BY round, label")
def coverage_round_counts(spark, d):
    return coverage_rounds(spark, d).groupBy("round", "label").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query(f"{_ROUNDS} SELECT round, slot, label, id FROM rows_ WHERE refill")
def coverage_refill(spark, d):
    return coverage_rounds(spark, d).where("refill").drop("refill")


@query("SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx FROM (SELECT DISTINCT d.lang FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL)")
def label_index(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return sampling.label_index(docs, "lang").withColumn("idx", F.col("idx").cast("long"))


def _image_files(spark, d):
    pages = table(spark, d, "pages")
    name = F.col("page_id").cast("string").alias("image_id")
    first = pages.where("page_id % 3 = 0").select(name, F.concat(F.lit("part_1/"), "page_id").alias("path"), F.lit(0).alias("root_rank"))
    second = pages.where("page_id % 3 = 1 or page_id % 6 = 0").select(name, F.concat(F.lit("part_2/"), "page_id").alias("path"), F.lit(1).alias("root_rank"))
    return pages.select(name, F.col("url").alias("dx")), first.unionByName(second)


@query("SELECT CAST(page_id AS VARCHAR) AS image_id, url AS dx, CASE page_id % 3 WHEN 0 THEN 'part_1/' || page_id WHEN 1 THEN 'part_2/' || page_id END AS image_path FROM pages")
def path_resolve_priority(spark, d):
    return metadata.resolve(*_image_files(spark, d))


@query("SELECT CAST(page_id AS VARCHAR) AS image_id, url AS dx FROM pages WHERE page_id % 3 = 2")
def path_missing(spark, d):
    return metadata.missing(*_image_files(spark, d))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'non_en' END AS label FROM documents")
def stage1_relabel(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("non_en").alias("label"))


@query("SELECT doc_id, lang AS label FROM documents WHERE lang <> 'en'")
def stage2_filter(spark, d):
    return table(spark, d, "documents").where("lang <> 'en'").select("doc_id", F.col("lang").alias("label"))


# --- planes ---------------------------------------------------------------------------------------------------------


def planes(spark: SparkSession, d: str) -> DataFrame:
    """``id, u``: 64 values of 0 to 255 in raster order."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"))
    low, span = F.array_min("v"), F.nullif(F.array_max("v") - F.array_min("v"), F.lit(0.0))
    return rows.select("id", F.transform("v", lambda x: F.coalesce(F.floor((x - low) / span * 255), F.lit(0)).cast("int")).alias("u"))


U = "px AS (SELECT id, list(CAST(coalesce(floor((val - low) / nullif(high - low, 0) * 255), 0) AS BIGINT) ORDER BY p) AS u FROM (SELECT vec_id AS id, unnest(range(64)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS val, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high FROM embeddings) GROUP BY id)"


def cell(dy: int, dx: int, outside: str = "NULL", u: str = "u", w: int = 8) -> str:
    return f"(CASE WHEN p // {w} + {dy} BETWEEN 0 AND {w - 1} AND p % {w} + {dx} BETWEEN 0 AND {w - 1} THEN {u}[p + {w * dy + dx} + 1] ELSE {outside} END)"


def stage(name: str, source: str, value: str, w: int = 8) -> str:
    return f"{name} AS (SELECT id, list(val ORDER BY p) AS u FROM (SELECT id, p, {value} AS val FROM {source}, range({w * w}) r(p)) GROUP BY id)"


def around(size: int, pick: str, w: int = 8) -> str:
    r = size // 2
    return f"{pick}({', '.join(cell(a, b, w=w) for a in range(-r, r + 1) for b in range(-r, r + 1))})"


def mirrored_mean(w: int = 8) -> str:
    at = lambda axis, k: f"(CASE WHEN {axis} + {k} < 0 THEN -({axis} + {k}) WHEN {axis} + {k} > {w - 1} THEN {2 * w - 2} - ({axis} + {k}) ELSE {axis} + {k} END)"
    terms = [f"u[{w} * {at(f'p // {w}', a)} + {at(f'p % {w}', b)} + 1]" for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return f"(({' + '.join(terms)}) / 9.0::DOUBLE)"


def plane_sql(stages: list[str], last: str, value: str = "CAST(u[p + 1] AS BIGINT)") -> str:
    return f"WITH {', '.join([U, *stages])} SELECT id, p // 8 AS y, p % 8 AS x, {value} AS value FROM {last}, range(64) r(p)"


def run_planes(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``id`` and the flat columns that ``kernel`` makes of a stack (n, 8, 8); its arrays have shape (n, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, u = batch.column("id").to_numpy(), np.stack(batch.column("u").to_numpy(zero_copy_only=False)).reshape(-1, 8, 8).astype(np.int64)
            out = {k: np.asarray(v).reshape(len(ids), -1) for k, v in kernel(u).items()}
            rows = next(iter(out.values())).shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, rows)), *[pa.array(v.ravel()) for v in out.values()]], ["id", *out])

    return df.mapInArrow(run, "id long, " + schema)


def plane_values(spark, d, kernel: Callable[[np.ndarray], np.ndarray], kind: str = "long") -> DataFrame:
    def cells(u: np.ndarray) -> dict[str, np.ndarray]:
        out = kernel(u)
        y, x = np.mgrid[: out.shape[1], : out.shape[2]]
        spread = lambda a: np.broadcast_to(a.ravel(), (len(out), a.size))
        return {"y": spread(y), "x": spread(x), "value": out.astype(np.float64) if kind == "double" else out.astype(np.int64)}

    out = run_planes(planes(spark, d), cells, f"y long, x long, value {kind}")
    return out.withColumn("value", F.round("value", 6) + 0.0) if kind == "double" else out  # no negative zero


@query(plane_sql([], "px"))
def patch_quantize(spark, d):
    return planes(spark, d).select("id", F.posexplode("u").alias("p", "value")).select("id", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.col("value").cast("long").alias("value"))


@query(f"WITH {U} SELECT id, u[p + 1] // 32 AS level, count(*) AS n FROM px, range(64) r(p) GROUP BY ALL")
def patch_levels(spark, d):
    return planes(spark, d).select("id", F.explode("u").alias("u")).groupBy("id", F.floor(F.col("u") / 32).alias("level")).agg(F.count("*").alias("n"))


@query(plane_sql([stage("a", "px", around(5, "greatest"))], "a"))
def patch_dilate(spark, d):
    return plane_values(spark, d, lambda u: K.dilate(u, 5))


@query(plane_sql([stage("a", "px", around(5, "least"))], "a"))
def patch_erode(spark, d):
    return plane_values(spark, d, lambda u: K.erode(u, 5))


_CLOSE = [stage("a", "px", around(5, "greatest")), stage("b", "a", around(5, "least"))]


@query(plane_sql(_CLOSE, "b"))
def patch_close(spark, d):
    return plane_values(spark, d, lambda u: K.close(u, 5))


@query(plane_sql([stage("a", "px", around(3, "least")), stage("b", "a", around(3, "greatest"))], "b"))
def patch_open(spark, d):
    return plane_values(spark, d, lambda u: K.open_(u, 3))


@query(f"WITH {', '.join([U, *_CLOSE])} SELECT id, p // 8 AS y, p % 8 AS x, CAST(b.u[p + 1] - px.u[p + 1] AS BIGINT) AS value FROM b JOIN px USING (id), range(64) r(p)")
def patch_blackhat(spark, d):
    return plane_values(spark, d, lambda u: K.blackhat(u, 5))


@query(plane_sql([stage("a", "px", mirrored_mean())], "a", "round(u[p + 1], 6)"))
def patch_mean_filter(spark, d):
    return plane_values(spark, d, lambda u: K.mean_filter(u, 3), "double")


@query(f"WITH {U} SELECT id, p // 16 AS y, p % 8 // 2 AS x, round(avg(u[p + 1]), 6) AS value FROM px, range(64) r(p) GROUP BY ALL")
def patch_downsample(spark, d):
    return plane_values(spark, d, lambda u: K.downsample(u, 1), "double")


@query(f"WITH {U} SELECT id, q // 16 AS y, q % 16 AS x, CAST(u[(q // 32) * 8 + (q % 16) // 2 + 1] AS BIGINT) AS value FROM px, range(256) r(q)")
def patch_upsample(spark, d):
    return plane_values(spark, d, lambda u: K.upsample(u, 16, 16))


_ENV = [
    stage("w", "px", mirrored_mean()), stage("top", "w", around(5, "greatest")), stage("low", "w", around(5, "least")),
    stage("mt", "top", mirrored_mean()), stage("ml", "low", mirrored_mean()),
    "e AS (SELECT id, list(((CASE WHEN w.u[p + 1] >= top.u[p + 1] THEN w.u[p + 1] ELSE mt.u[p + 1] END) + (CASE WHEN w.u[p + 1] <= low.u[p + 1] THEN w.u[p + 1] ELSE ml.u[p + 1] END)) / 2 ORDER BY p) AS u FROM w JOIN top USING (id) JOIN low USING (id) JOIN mt USING (id) JOIN ml USING (id), range(64) r(p) GROUP BY id)",
]


@query(plane_sql(_ENV, "e", "round(u[p + 1], 6)"))
def patch_envelope(spark, d):
    return plane_values(spark, d, lambda u: K.envelope_mean(K.mean_filter(u, 3), 5, 3), "double")


@query(f"WITH {', '.join([U, *_ENV, stage('s', 'e', mirrored_mean())])} SELECT id, p // 8 AS y, p % 8 AS x, round(px.u[p + 1] - s.u[p + 1], 6) + 0 AS value FROM s JOIN px USING (id), range(64) r(p)")
def patch_bimf1(spark, d):
    return plane_values(spark, d, K.first_mode, "double")


def _trend(n: int, source: str, w: int, window: int = 3) -> list[str]:
    """SQL stages of a plane's trend at a scale of ``w`` cells a side, the last one named ``t{n}``."""
    k = 8 // w
    small = stage(f"d{n}", source, f"(({' + '.join(f'u[{k} * (p // {w}) * 8 + {a} * 8 + {k} * (p % {w}) + {b} + 1]' for a in range(k) for b in range(k))}) / {k * k}.0::DOUBLE)", w)
    names = f"w{n} JOIN hi{n} USING (id) JOIN lo{n} USING (id) JOIN mt{n} USING (id) JOIN ml{n} USING (id)"
    at = lambda name: f"{name}{n}.u[p + 1]"
    mean = f"((CASE WHEN {at('w')} >= {at('hi')} THEN {at('w')} ELSE {at('mt')} END) + (CASE WHEN {at('w')} <= {at('lo')} THEN {at('w')} ELSE {at('ml')} END)) / 2"
    return [
        small, stage(f"w{n}", f"d{n}", mirrored_mean(w), w), stage(f"hi{n}", f"w{n}", around(window, "greatest", w), w), stage(f"lo{n}", f"w{n}", around(window, "least", w), w),
        stage(f"mt{n}", f"hi{n}", mirrored_mean(w), w), stage(f"ml{n}", f"lo{n}", mirrored_mean(w), w),
        f"e{n} AS (SELECT id, list({mean} ORDER BY p) AS u FROM {names}, range({w * w}) r(p) GROUP BY id)",
        stage(f"up{n}", f"e{n}", f"u[(p // 8 // {k}) * {w} + p % 8 // {k} + 1]"), stage(f"t{n}", f"up{n}", mirrored_mean()),
    ]


@query(f"""WITH {', '.join([U, *_trend(1, 'px', 8), *_trend(2, 't1', 4)])},
m AS (SELECT id, 1 AS level, p, px.u[p + 1] - t1.u[p + 1] AS v FROM px JOIN t1 USING (id), range(64) r(p) UNION ALL SELECT id, 2, p, t1.u[p + 1] - t2.u[p + 1] FROM t1 JOIN t2 USING (id), range(64) r(p) UNION ALL SELECT id, 0, p, t2.u[p + 1] FROM t2, range(64) r(p))
SELECT id, CAST(level AS BIGINT) AS level, p // 8 AS y, p % 8 AS x, round(v, 6) + 0 AS value FROM m""")
def patch_modes(spark, d):
    """Two modes at two scales, and what is left (level 0), with a window of 3 x 3."""

    def kernel(u):
        modes, rest = K.decompose(u, 2, 3, 3)
        out = np.stack([rest, *modes], axis=1)
        level, y, x = np.indices(out.shape[1:])
        return {"level": np.broadcast_to(level, out.shape), "y": np.broadcast_to(y, out.shape), "x": np.broadcast_to(x, out.shape), "value": out}

    return run_planes(planes(spark, d), kernel, "level long, y long, x long, value double").withColumn("value", F.round("value", 6) + 0.0)


@query(f"WITH {', '.join([U, *_CLOSE])} SELECT id, p // 8 AS y, p % 8 AS x, CAST(b.u[p + 1] - px.u[p + 1] > 10 AS BIGINT) AS value FROM b JOIN px USING (id), range(64) r(p)")
def patch_hair_mask(spark, d):
    return plane_values(spark, d, lambda u: K.blackhat(u, 5) > 10)


@query(f"WITH {U}, s AS (SELECT id, list_transform(u, lambda x: x // 3) AS u FROM px) SELECT id, p // 8 AS y, p % 8 AS x, CAST(coalesce(floor((u[p + 1] - list_min(u)) * 255.0::DOUBLE / nullif(list_max(u) - list_min(u), 0)), 0) AS BIGINT) AS value FROM s, range(64) r(p)")
def patch_stretch(spark, d):
    return plane_values(spark, d, lambda u: K.stretch(u // 3))


_LEVEL = ["ph0 AS (SELECT id, list(sin(pi() / 5 * (p // 8)) * sin(pi() / 5 * (p % 8)) ORDER BY p) AS u, list(px.u[p + 1] / 255.0::DOUBLE ORDER BY p) AS f FROM px, range(64) r(p) GROUP BY id)"]
for _k in (1, 2):
    _at = lambda dy, dx: f"u[8 * greatest(0, least(7, p // 8 + {dy})) + greatest(0, least(7, p % 8 + {dx})) + 1]"
    _LEVEL += [
        f"c{_k} AS (SELECT id, p, f[p + 1] AS f, {_at(0, 0)} AS h, {_at(0, 1)} AS e, {_at(0, -1)} AS w, {_at(1, 0)} AS s, {_at(-1, 0)} AS n FROM ph{_k - 1}, range(64) r(p))",
        f"m{_k} AS (SELECT id, coalesce(avg(f) FILTER (WHERE h > 0), 0) AS mi, coalesce(avg(f) FILTER (WHERE h <= 0), 0) AS mo FROM c{_k} GROUP BY id)",
        f"g{_k} AS (SELECT *, 1 / sqrt(1e-16 + pow(e - h, 2) + pow((s - n) / 2, 2)) AS ce, 1 / sqrt(1e-16 + pow(h - w, 2) + pow((s - n) / 2, 2)) AS cw, 1 / sqrt(1e-16 + pow(s - h, 2) + pow((e - w) / 2, 2)) AS cs, 1 / sqrt(1e-16 + pow(h - n, 2) + pow((e - w) / 2, 2)) AS cn, 0.5 / (1 + h * h) AS dl FROM c{_k} JOIN m{_k} USING (id))",
        f"ph{_k} AS (SELECT id, list((h + dl * (0.2 * (e * ce + w * cw + s * cs + n * cn) + pow(f - mo, 2) - pow(f - mi, 2))) / (1 + 0.2 * dl * (ce + cw + cs + cn)) ORDER BY p) AS u, list(f ORDER BY p) AS f FROM g{_k} GROUP BY id)",
    ]


@query(f"WITH {', '.join([U, *_LEVEL])} SELECT id, p // 8 AS y, p % 8 AS x, round(u[p + 1] + 1e-9, 6) + 0 AS value FROM ph2, range(64) r(p)")
def patch_level_steps(spark, d):
    """Two steps of the level set on whole planes (0 to 255 read as 0 to 1)."""

    def kernel(u):
        out = []
        for plane in u / 255.0:
            phi = K.checkerboard(8, 8)
            for _ in range(2):
                phi = K.level_step(phi, plane)
            out.append(phi)
        return np.stack(out)

    cells = lambda u: (lambda out: dict(zip(("y", "x", "value"), (*(np.broadcast_to(a, out.shape) for a in np.mgrid[:8, :8]), out), strict=True)))(kernel(u))
    return run_planes(planes(spark, d), cells, "y long, x long, value double").withColumn("value", F.round(F.col("value") + 1e-9, 6) + 0.0)


def _pattern() -> str:
    terms = []
    for k in range(8):
        dy, dx = round(-np.sin(2 * np.pi * k / 8), 5), round(np.cos(2 * np.pi * k / 8), 5)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = float(dy - y0), float(dx - x0)
        g = lambda a, b: f"{cell(a, b, '0')}::DOUBLE"
        sample = f"((1 - {fy!r}::DOUBLE) * ((1 - {fx!r}::DOUBLE) * {g(y0, x0)} + {fx!r}::DOUBLE * {g(y0, x0 + 1)}) + {fy!r}::DOUBLE * ((1 - {fx!r}::DOUBLE) * {g(y0 + 1, x0)} + {fx!r}::DOUBLE * {g(y0 + 1, x0 + 1)}))"
        terms.append(f"(CASE WHEN round({sample} - u[p + 1], 9) >= 0 THEN {1 << k} ELSE 0 END)")
    return " + ".join(terms)


@query(f"""WITH {U}, {stage('c', 'px', _pattern())},
h AS (SELECT c.id, c.u[p + 1] AS bin, count(*) AS n FROM c JOIN px USING (id), range(64) r(p) WHERE px.u[p + 1] > 127 GROUP BY ALL)
SELECT id, CAST(bin AS BIGINT) AS bin, round(n / sum(n) OVER (PARTITION BY id), 6) AS share FROM h""")
def patch_lbp_hist(spark, d):
    def kernel(u):
        h = K.histogram(K.lbp(u), u > 127, 256, 0, 256)
        return {"bin": np.broadcast_to(np.arange(256), h.shape), "share": h}

    return run_planes(planes(spark, d), kernel, "bin long, share double").where("share > 0").withColumn("share", F.round("share", 6))


@query(f"""WITH {U}, {stage('c', 'px', _pattern())}, k AS (SELECT id, p, CAST(u[p + 1] AS BIGINT) AS c FROM c, range(64) r(p)),
t AS (SELECT id, p, c, bit_count(xor(c, (c >> 1) | ((c & 1) << 7))) AS changes FROM k)
SELECT id, CASE WHEN changes <= 2 THEN CAST(bit_count(c) AS BIGINT) ELSE 9 END AS code, count(*) AS n FROM t GROUP BY ALL""")
def patch_lbp_uniform(spark, d):
    codes = plane_values(spark, d, lambda u: K.lbp(u, method="uniform"))
    return codes.groupBy("id", F.col("value").alias("code")).agg(F.count("*").alias("n"))


@query(f"""WITH {U}, {stage('c', 'px', _pattern())}, k AS (SELECT id, p, CAST(u[p + 1] AS BIGINT) AS c FROM c, range(64) r(p))
SELECT id, least({', '.join(f'((c >> {k}) | (c << {8 - k})) & 255' for k in range(8))}) AS code, count(*) AS n FROM k GROUP BY ALL""")
def patch_lbp_ror(spark, d):
    codes = plane_values(spark, d, lambda u: K.lbp(u, method="ror"))
    return codes.groupBy("id", F.col("value").alias("code")).agg(F.count("*").alias("n"))


@query(f"WITH {U}, m AS (SELECT id, median(u[p + 1] // 32) AS m FROM px, range(64) r(p) WHERE u[p + 1] > 127 GROUP BY id) SELECT px.id, CAST(coalesce(floor(m), 0) AS BIGINT) AS roi_median FROM px LEFT JOIN m USING (id)")
def patch_roi_median(spark, d):
    return run_planes(planes(spark, d), lambda u: {"roi_median": K.roi_median(u // 32, u > 127)}, "roi_median long")


_OFFSETS = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(K.glcm_offsets()))
_GLCM = f"""{U}, m AS (SELECT px.id, any_value(u) AS u, coalesce(floor(median(u[p + 1] // 32) FILTER (WHERE u[p + 1] > 127)), 0) AS fill FROM px, range(64) r(p) GROUP BY px.id),
{stage('q', 'm', 'CAST(CASE WHEN u[p + 1] > 127 THEN u[p + 1] // 32 ELSE fill END AS BIGINT)')},
o AS (SELECT * FROM (VALUES {_OFFSETS}) o(k, dy, dx)),
pairs AS (SELECT id, k, u[p + 1] AS i, u[p + 8 * dy + dx + 1] AS j FROM q, range(64) r(p), o WHERE p // 8 + dy BETWEEN 0 AND 7 AND p % 8 + dx BETWEEN 0 AND 7),
counts AS (SELECT id, k, i, j, count(*) AS n FROM (SELECT id, k, i, j FROM pairs UNION ALL SELECT id, k, j, i FROM pairs) GROUP BY ALL)"""


@query(f"WITH {_GLCM} SELECT id, CAST(k AS BIGINT) AS k, i, j, n FROM counts")
def patch_glcm_counts(spark, d):
    def kernel(u):
        level = K.quantized(u, u > 127)
        c = np.stack([K.glcm(level, dy, dx) for dy, dx in K.glcm_offsets()], axis=1)
        k, i, j = np.indices(c.shape[1:])
        return {"k": np.broadcast_to(k, c.shape), "i": np.broadcast_to(i, c.shape), "j": np.broadcast_to(j, c.shape), "n": c}

    return run_planes(planes(spark, d), kernel, "k long, i long, j long, n long").where("n > 0")


@query(f"""WITH {_GLCM}, pr AS (SELECT id, k, i, j, n / sum(n) OVER (PARTITION BY id, k) AS p FROM counts),
mo AS (SELECT id, k, sum(p * i) AS mi, sum(p * j) AS mj FROM pr GROUP BY ALL),
st AS (SELECT id, k, sum(p * (i - j) * (i - j)) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy,
  sqrt(sum(p * (i - mi) * (i - mi))) AS si, sqrt(sum(p * (j - mj) * (j - mj))) AS sj, sum(p * (i - mi) * (j - mj)) AS cov FROM pr JOIN mo USING (id, k) GROUP BY ALL)
SELECT id, round(avg(contrast) + 1e-9, 6) AS contrast, round(avg(homogeneity) + 1e-9, 6) AS homogeneity, round(avg(energy) + 1e-9, 6) AS energy, round(avg(CASE WHEN si < 1e-15 OR sj < 1e-15 THEN 1 ELSE cov / (si * sj) END) + 1e-9, 6) AS correlation FROM st GROUP BY id""")
def patch_glcm_stats(spark, d):
    names = ["contrast", "homogeneity", "energy", "correlation"]
    out = run_planes(planes(spark, d), lambda u: dict(zip(names, K.glcm_stats(u, u > 127).T, strict=True)), ", ".join(f"{n} double" for n in names))
    return out.select("id", *[F.round(F.col(n) + 1e-9, 6).alias(n) for n in names])  # short decimals end in exact halves


def _colour(spark, d) -> DataFrame:
    p = planes(spark, d)
    g, r = (p.select((F.col("id") - k).alias("id"), F.col("u").alias(n)) for k, n in ((1, "g"), (2, "r")))
    return p.join(g, "id").join(r, "id").select("id", F.concat("u", "g", "r").alias("u"))


def _colour_stack(u: np.ndarray) -> np.ndarray:
    return np.moveaxis(u.reshape(-1, 3, 8, 8), 1, -1)


def run_colour(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            out = {k: np.asarray(v).reshape(len(ids), -1) for k, v in kernel(_colour_stack(np.stack(batch.column("u").to_numpy(zero_copy_only=False)))).items()}
            rows = next(iter(out.values())).shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, rows)), *[pa.array(v.ravel()) for v in out.values()]], ["id", *out])

    return df.mapInArrow(run, "id long, " + schema)


_RGB = f"{U}, c AS (SELECT b.id, p, b.u[p + 1] AS b, g.u[p + 1] AS g, r.u[p + 1] AS r FROM px b JOIN px g ON g.id = b.id + 1 JOIN px r ON r.id = b.id + 2, range(64) t(p))"


@query(f"""WITH {_RGB}, x AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM c WHERE b > 127),
t AS (SELECT id, v, (d * (CASE WHEN v > 0 THEN CAST(round_even(1044480 / v, 0) AS BIGINT) ELSE 0 END) + 2048) >> 12 AS s,
  CAST(floor(((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END) * (CASE WHEN d > 0 THEN CAST(round_even(737280 / (6.0::DOUBLE * d), 0) AS BIGINT) ELSE 0 END) + 2048) / 4096) AS BIGINT) AS h FROM x),
l AS (SELECT id, 'h' AS channel, least((CASE WHEN h < 0 THEN h + 180 ELSE h END) * 24 // 180, 23) AS bin FROM t UNION ALL SELECT id, 's', least(s * 8 // 256, 7) FROM t UNION ALL SELECT id, 'v', least(v * 8 // 256, 7) FROM t),
n AS (SELECT id, channel, bin, count(*) AS n FROM l GROUP BY ALL)
SELECT id, channel, CAST(bin AS BIGINT) AS bin, round(n / sum(n) OVER (PARTITION BY id, channel), 6) AS share FROM n""")
def rgb_to_hsv_hist(spark, d):
    def kernel(bgr):
        planes_, mask = K.hsv(bgr), bgr[..., 0] > 127
        parts = [K.histogram(planes_[..., k], mask, n, 0, top) for k, (n, top) in enumerate(((24, 180), (8, 256), (8, 256)))]
        h = np.concatenate(parts, axis=1)
        name = np.repeat([0, 1, 2], [24, 8, 8])
        return {"c": np.broadcast_to(name, h.shape), "bin": np.broadcast_to(np.concatenate([np.arange(24), np.arange(8), np.arange(8)]), h.shape), "share": h}

    out = run_colour(_colour(spark, d), kernel, "c long, bin long, share double").where("share > 0")
    return out.select("id", F.substring(F.lit("hsv"), (F.col("c") + 1).cast("int"), F.lit(1)).alias("channel"), "bin", F.round("share", 6).alias("share"))


def colour_values(spark, d, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``id, y, x`` and the channels ``c0, c1, ...`` of what ``kernel`` makes of a stack (n, 8, 8, 3)."""

    def cells(bgr: np.ndarray) -> dict[str, np.ndarray]:
        out = kernel(bgr)
        y, x = np.mgrid[:8, :8]
        spread = lambda a: np.broadcast_to(a.ravel(), (len(out), 64))
        return {"y": spread(y), "x": spread(x), **{f"c{k}": out[..., k].astype(np.int64) for k in range(out.shape[-1])}}

    n = kernel(np.zeros((1, 8, 8, 3), np.int64)).shape[-1]
    return run_colour(_colour(spark, d), cells, "y long, x long, " + ", ".join(f"c{k} long" for k in range(n)))


@query(f"WITH {_RGB} SELECT id, p // 8 AS y, p % 8 AS x, CAST((b * 3735 + g * 19235 + r * 9798 + 16384) >> 15 AS BIGINT) AS c0 FROM c")
def patch_gray(spark, d):
    return colour_values(spark, d, lambda bgr: K.gray(bgr)[..., None])


def _linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END)"


def _root(v: str) -> str:
    return f"(CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787 * {v} + 16 / 116.0::DOUBLE END)"


@query(f"""WITH {_RGB}, l AS (SELECT id, p, {_linear('r')} AS r, {_linear('g')} AS g, {_linear('b')} AS b FROM c),
t AS (SELECT id, p, (r * 0.412453::DOUBLE + g * 0.357580::DOUBLE + b * 0.180423::DOUBLE) / 0.950456::DOUBLE AS x, r * 0.212671::DOUBLE + g * 0.715160::DOUBLE + b * 0.072169::DOUBLE AS y, (r * 0.019334::DOUBLE + g * 0.119193::DOUBLE + b * 0.950227::DOUBLE) / 1.088754::DOUBLE AS z FROM l),
f AS (SELECT id, p, y, {_root('x')} AS fx, {_root('y')} AS fy, {_root('z')} AS fz FROM t)
SELECT id, p // 8 AS y, p % 8 AS x, CAST(greatest(0, least(255, round_even((CASE WHEN y > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * y END) * 255 / 100, 0))) AS BIGINT) AS c0,
  CAST(greatest(0, least(255, round_even(500 * (fx - fy) + 128, 0))) AS BIGINT) AS c1, CAST(greatest(0, least(255, round_even(200 * (fy - fz) + 128, 0))) AS BIGINT) AS c2 FROM f""")
def patch_lab(spark, d):
    return colour_values(spark, d, K.bgr_to_lab)


@query(f"WITH {_RGB}, s AS (SELECT id, stddev_pop(b) AS b, stddev_pop(g) AS g, stddev_pop(r) AS r FROM c WHERE b > 127 GROUP BY id) SELECT id, round((b + g + r) / 3, 6) AS color_std FROM s")
def patch_color_std(spark, d):
    kernel = lambda bgr: {"color_std": np.array([c[c[..., 0] > 127].astype(float).std(axis=0).mean() for c in bgr])}
    return run_colour(_colour(spark, d), kernel, "color_std double").withColumn("color_std", F.round("color_std", 6))


@query(f"""WITH {U}, {stage('m', 'px', 'CAST(u[p + 1] > 127 AS INTEGER)')},
a AS (SELECT id, avg(abs(u[p + 1] - u[8 * (p // 8) + 7 - p % 8 + 1])) FILTER (WHERE p % 8 < 4) AS lr, avg(abs(u[p + 1] - u[8 * (7 - p // 8) + p % 8 + 1])) FILTER (WHERE p // 8 < 4) AS tb FROM m, range(64) r(p) GROUP BY id)
SELECT id, round((lr + tb) / 2, 6) AS asymmetry FROM a""")
def patch_asymmetry(spark, d):
    return run_planes(planes(spark, d), lambda u: {"asymmetry": K.asymmetry(u > 127)}, "asymmetry double").withColumn("asymmetry", F.round("asymmetry", 6))


@query(f"WITH {U}, a AS (SELECT id, CAST(sum(CASE WHEN u[p + 1] > 127 THEN 1 ELSE 0 END) AS BIGINT) AS area FROM px, range(64) r(p) GROUP BY id) SELECT id, area, round(sqrt(4 * area / pi()) / 8, 6) AS diameter FROM a")
def patch_area_diameter(spark, d):
    area = F.size(F.filter("u", lambda u: u > 127)).cast("long")
    return planes(spark, d).select("id", area.alias("area")).withColumn("diameter", F.round(F.sqrt(4 * F.col("area") / F.pi()) / 8, 6))


_PARTS = f"""{U}, o AS (SELECT id, p FROM px, range(64) r(p) WHERE u[p + 1] > 127),
adj AS (SELECT a.id, a.p, b.p AS q FROM o a JOIN o b ON a.id = b.id AND abs(a.p // 8 - b.p // 8) <= 1 AND abs(a.p % 8 - b.p % 8) <= 1),
reach AS (SELECT id, p, p AS q FROM o UNION SELECT r.id, r.p, adj.q FROM reach r JOIN adj ON adj.id = r.id AND adj.p = r.q),
part AS (SELECT id, p, min(q) AS component FROM reach GROUP BY id, p)"""


@query(f"WITH RECURSIVE {_PARTS} SELECT id, p // 8 AS y, p % 8 AS x, component FROM part")
def patch_components(spark, d):
    def kernel(u):
        label = np.stack([K.components(m) for m in u > 127])
        y, x = np.indices(label.shape[1:])
        return {"y": np.broadcast_to(y, label.shape), "x": np.broadcast_to(x, label.shape), "component": label}

    return run_planes(planes(spark, d), kernel, "y long, x long, component long").where("component >= 0")


@query(f"WITH RECURSIVE {_PARTS}, s AS (SELECT id, component, count(*) AS area FROM part GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, component) AS k FROM s) SELECT id, component, area FROM t WHERE k = 1")
def patch_largest_component(spark, d):
    def kernel(u):
        first, size = [], []
        for m in u > 127:
            big = K.largest_component(m) if m.any() else np.zeros_like(m)
            first.append(int(np.flatnonzero(big)[0]) if big.any() else -1)
            size.append(int(big.sum()))
        return {"component": np.array(first), "area": np.array(size)}

    return run_planes(planes(spark, d), kernel, "component long, area long").where("area > 0")


_SETTLED = f"""{_PARTS.replace("u[p + 1] > 127", "u[p + 1] > CASE WHEN id % 10 = 0 THEN 255 ELSE 127 END")}, sizes AS (SELECT id, component, count(*) AS n FROM part GROUP BY ALL),
top AS (SELECT id, component FROM sizes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, component) = 1),
m0 AS (SELECT px.id, list(CASE WHEN top.id IS NULL OR part.component = top.component THEN 1 ELSE 0 END ORDER BY r.p) AS u, any_value(top.id IS NULL) AS bare FROM px LEFT JOIN top USING (id) CROSS JOIN range(64) r(p) LEFT JOIN part ON part.id = px.id AND part.p = r.p GROUP BY px.id),
{", ".join([stage("m1", "m0", around(5, "greatest")), stage("m2", "m1", around(5, "least")), stage("m3", "m2", around(3, "least")), stage("m4", "m3", around(3, "greatest"))])}"""


@query(f"WITH RECURSIVE {_SETTLED} SELECT m4.id, p // 8 AS y, p % 8 AS x, CAST(CASE WHEN bare THEN 1 ELSE m4.u[p + 1] END AS BIGINT) AS value FROM m4 JOIN m0 USING (id), range(64) r(p)")
def patch_settled_mask(spark, d):
    """Largest component, closed and opened. Every tenth plane has an empty mask, which becomes all ones."""
    rows = planes(spark, d).withColumn("u", F.transform("u", lambda x: F.when(F.col("id") % 10 == 0, 0).otherwise(x)))

    def kernel(u):
        out = np.stack([K.settled(m) for m in u > 127])
        y, x = np.mgrid[:8, :8]
        return {"y": np.broadcast_to(y, out.shape), "x": np.broadcast_to(x, out.shape), "value": out.astype(np.int64)}

    return run_planes(rows, kernel, "y long, x long, value long")


def _turn(y: str, x: str, back: str) -> str:
    """The first direction from (y, x), clockwise after ``back``, in which the component goes on."""
    at = f"({y} + dy[({back} + k) % 8 + 1])", f"({x} + dx[({back} + k) % 8 + 1])"
    return f"list_filter(range(1, 9), lambda k: {at[0]} BETWEEN 0 AND 7 AND {at[1]} BETWEEN 0 AND 7 AND list_contains(m, 8 * {at[0]} + {at[1]}))[1]"


_WALK = f"""{_PARTS}, cells AS (SELECT id, component, list(p) AS m, min(p) // 8 AS y, min(p) % 8 AS x, [0, -1, -1, -1, 0, 1, 1, 1] AS dy, [-1, -1, 0, 1, 1, 1, 0, -1] AS dx FROM part GROUP BY id, component),
begun AS (SELECT *, {_turn('y', 'x', '0')} % 8 AS d FROM cells),
walk AS (SELECT id, component, m, dy, dx, y, x, d, y AS y0, x AS x0, d AS d0, 0 AS n, 0.0::DOUBLE AS length, 0 AS area FROM begun WHERE d IS NOT NULL
  UNION ALL SELECT id, component, m, dy, dx, ny, nx, (back + {_turn('ny', 'nx', 'back')}) % 8, y0, x0, d0, n + 1, length + CASE WHEN d % 2 = 1 THEN sqrt(2) ELSE 1 END, area + x * ny - nx * y
  FROM (SELECT *, y + dy[d + 1] AS ny, x + dx[d + 1] AS nx, CASE WHEN d % 2 = 1 THEN (d + 5) % 8 ELSE (d + 6) % 8 END AS back FROM walk WHERE n = 0 OR y <> y0 OR x <> x0 OR d <> d0)),
ring AS (SELECT id, component, length, abs(area) / 2 AS area FROM walk WHERE n > 0 AND y = y0 AND x = x0 AND d = d0 UNION ALL SELECT id, component, 0, 0 FROM begun WHERE d IS NULL),
best AS (SELECT id, length FROM ring QUALIFY row_number() OVER (PARTITION BY id ORDER BY area DESC, component) = 1)"""


@query(f"WITH RECURSIVE {_WALK}, a AS (SELECT id, count(*) AS n FROM o GROUP BY id) SELECT id, round(length, 6) AS length, round(length * length / (4 * pi() * n + 1e-7), 6) AS irregularity FROM best JOIN a USING (id) WHERE n > 1")
def patch_border(spark, d):
    """Length and irregularity of the border that encloses the largest area."""

    def kernel(u):
        length = np.array([K.outline(m)[0] for m in u > 127])
        area = (u > 127).sum(axis=(1, 2))
        return {"length": length, "irregularity": length**2 / (4 * np.pi * area + 1e-7), "area": area}

    rows = run_planes(planes(spark, d), kernel, "length double, irregularity double, area long").where("area > 1")
    return rows.select("id", F.round("length", 6).alias("length"), F.round("irregularity", 6).alias("irregularity"))


@query(f"""WITH {U}, h AS (SELECT id, (p // 32) * 2 + (p % 8) // 4 AS tile, u[p + 1] AS bin, count(*) AS n FROM px, range(64) r(p) GROUP BY ALL)
SELECT id, CAST(tile AS BIGINT) AS tile, bin, CAST(least(n, 2) AS BIGINT) AS clipped, CAST(n - least(n, 2) AS BIGINT) AS excess FROM h""")
def tile_histogram_clip(spark, d):
    """Four tiles of 4 x 4 cells, two of a value at most; the excess before it is spread."""

    def kernel(u):
        raw = np.stack([K.clipped_histograms(p, (2, 2), 0)[0].reshape(4, 256) for p in u])
        tile, bin_ = np.indices(raw.shape[1:])
        return {"tile": np.broadcast_to(tile, raw.shape), "bin": np.broadcast_to(bin_, raw.shape), "clipped": np.minimum(raw, 2), "excess": raw - np.minimum(raw, 2)}

    return run_planes(planes(spark, d), kernel, "tile long, bin long, clipped long, excess long").where("clipped > 0")


_CORNERS = " + ".join(f"({'fy' if a else '(1 - fy)'}) * ({'fx' if b else '(1 - fx)'}) * max(m) FILTER (WHERE tile = 2 * greatest(0, least(1, y0 + {a})) + greatest(0, least(1, x0 + {b})))" for a in (0, 1) for b in (0, 1))


@query(f"""WITH {U}, h AS (SELECT id, (p // 32) * 2 + (p % 8) // 4 AS tile, u[p + 1] AS bin, count(*) AS n FROM px, range(64) r(p) GROUP BY ALL),
rest AS (SELECT id, tile, sum(n - least(n, 2)) AS over FROM h GROUP BY ALL),
cells AS (SELECT id, p, u[p + 1] AS v, floor(p // 8 / 4.0::DOUBLE - 0.5) AS y0, floor(p % 8 / 4.0::DOUBLE - 0.5) AS x0, p // 8 / 4.0::DOUBLE - 0.5 - floor(p // 8 / 4.0::DOUBLE - 0.5) AS fy, p % 8 / 4.0::DOUBLE - 0.5 - floor(p % 8 / 4.0::DOUBLE - 0.5) AS fx FROM px, range(64) r(p)),
below AS (SELECT c.id, c.p, c.v, c.y0, c.x0, c.fy, c.fx, h.tile, sum(CASE WHEN h.bin <= c.v THEN least(h.n, 2) ELSE 0 END) AS held FROM cells c JOIN h ON h.id = c.id GROUP BY ALL),
map AS (SELECT b.*, least(255, round_even((held + CASE WHEN over > 0 THEN least(over, v // greatest(256 // over, 1) + 1) ELSE 0 END) * (255 / 16.0::DOUBLE), 0)) AS m FROM below b JOIN rest USING (id, tile))
SELECT id, p // 8 AS y, p % 8 AS x, CAST(round_even({_CORNERS}, 0) AS BIGINT) AS value FROM map GROUP BY id, p, y0, x0, fy, fx""")
def patch_clahe(spark, d):
    """Four tiles of 4 x 4 cells, two of a value at most, the excess spread, tables blended between tile centres."""
    return plane_values(spark, d, lambda u: np.stack([K.clahe(p, 40.0, (2, 2)) for p in u]))


# --- scaling and neighbours -----------------------------------------------------------------------------------------

_LONG = f"{V}, l AS (SELECT id, label, unnest(range(64)) AS dim, unnest(features) AS v FROM v), s AS (SELECT dim, avg(v) AS mean, stddev_pop(v) AS std FROM l GROUP BY dim)"


@query(f"WITH {_LONG} SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def feature_scaler_stats(spark, d):
    return scaling.feature_stats(vectors(spark, d)).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_LONG} SELECT id, CAST(dim AS INTEGER) AS dim, round((v - mean) / (CASE WHEN std > 0 THEN std ELSE 1 END), 6) AS z FROM l JOIN s USING (dim)")
def feature_scaled(spark, d):
    v = vectors(spark, d)
    return scaling.scaled(v, scaling.feature_stats(v)).select("id", F.posexplode("features").alias("dim", "z")).withColumn("z", F.round("z", 6))


@query(f"WITH {_LONG} SELECT round(1 / (64 * var_pop(v)), 6) AS gamma FROM l")
def gamma_scale(spark, d):
    return scaling.gamma_scale(vectors(spark, d)).select(F.round("gamma", 6).alias("gamma"))


@query(f"WITH {LD}, c AS (SELECT label, count(*) AS n FROM ld GROUP BY label) SELECT label AS class, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(spark, d):
    return scaling.class_weights(langs(spark, d)).select("class", F.round("weight", 6).alias("weight"))


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB or one row, so that a kernel gets pairs of blocks one by one. It says nothing about results."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def _near(source: str, same: bool, k: int) -> str:
    on = " AND a.label = b.label" if same else ""
    return f"""dist AS (SELECT a.id, b.id AS nn_id, b.label AS nn_label, round(pow(array_distance(CAST(a.features AS DOUBLE[64]), CAST(b.features AS DOUBLE[64])), 2), 9) AS d2 FROM {source} a JOIN {source} b ON a.id <> b.id{on}),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS rank FROM dist QUALIFY rank <= {k})"""


@query(f"WITH {V}, {_near('v', True, 5)} SELECT id, nn_id, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM nn")
def knn_same_class(spark, d):
    return balancing.nearest(vectors(spark, d), 5).select("id", "nn_id", "rank", F.round("d2", 6).alias("d2"))


_TARGETS = f"{LV}, c AS (SELECT label, count(*) AS n FROM lv GROUP BY label), t AS (SELECT label, n, max(n) OVER () - n AS n_new FROM c)"


@query(f"WITH {_TARGETS} SELECT * FROM t")
def smote_targets(spark, d):
    return balancing.targets(lang_vectors(spark, d))


def _draw(what: str) -> str:
    return f"CAST('0x' || substr(md5('42:{what}:' || label || ':' || slot), 1, 8) AS BIGINT)"


@query(f"""WITH {_TARGETS}, {_near('lv', True, 5)}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key()}, id) AS rn FROM lv),
slots AS (SELECT label, n, unnest(range(n_new)) AS slot FROM t),
pick AS (SELECT label, slot, {_draw('base')} % n + 1 AS rn, {_draw('near')} % 5 + 1 AS rank, {_draw('u')} / 4294967296.0::DOUBLE AS u FROM slots),
g AS (SELECT p.label, p.slot, r.id AS base_id, nn.nn_id, p.u FROM pick p JOIN r USING (label, rn) JOIN nn ON nn.id = r.id AND nn.rank = p.rank),
f AS (SELECT g.label, g.slot, g.base_id, g.nn_id, g.u, unnest(range(64)) AS dim, unnest(a.features) AS x, unnest(b.features) AS z FROM g JOIN lv a ON a.id = g.base_id JOIN lv b ON b.id = g.nn_id)
SELECT label, slot, base_id, nn_id, round(any_value(u), 9) AS u, round(sum(x + u * (z - x)), 5) AS total FROM f GROUP BY label, slot, base_id, nn_id""")
def smote_samples(spark, d):
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return balancing.smote(lang_vectors(spark, d)).select("label", "slot", "base_id", "nn_id", F.round("u", 9).alias("u"), F.round(total, 5).alias("total"))


@query(f"""WITH {V}, {_near('v', False, 3)}, n AS (SELECT id, nn_label, count(*) AS n FROM nn GROUP BY ALL),
w AS (SELECT id, nn_label AS vote FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, nn_label) = 1),
m AS (SELECT label FROM v GROUP BY label ORDER BY count(*), label LIMIT 1)
SELECT v.id, v.label, w.vote, (v.label = (SELECT label FROM m) OR w.vote = v.label) AS keep FROM v JOIN w USING (id)""")
def enn_keep(spark, d):
    return balancing.vote_keeps(vectors(spark, d))


@query(f"WITH {LV} SELECT CAST(id AS VARCHAR) AS id, label FROM lv")
def balance_none(spark, d):
    """Rows as they are, without a strategy."""
    return balancing.balance(lang_vectors(spark, d), "none").select("id", "label")


@query(f"""WITH {_TARGETS}, {_near('lv', True, 5).replace('dist AS', 'sd AS').replace('nn AS', 'sn AS').replace('FROM dist', 'FROM sd')}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key()}, id) AS rn FROM lv),
slots AS (SELECT label, n, unnest(range(n_new)) AS slot FROM t),
pick AS (SELECT label, slot, {_draw('base')} % n + 1 AS rn, {_draw('near')} % 5 + 1 AS rank, {_draw('u')} / 4294967296.0::DOUBLE AS u FROM slots),
g AS (SELECT p.label, p.slot, r.id AS base_id, sn.nn_id, p.u FROM pick p JOIN r USING (label, rn) JOIN sn ON sn.id = r.id AND sn.rank = p.rank),
whole AS MATERIALIZED (SELECT CAST(id AS VARCHAR) AS id, label, features FROM lv UNION ALL
  SELECT 'new:' || g.label || ':' || g.slot, g.label, list_transform(list_zip(a.features, b.features), lambda z: z[1] + g.u * (z[2] - z[1])) FROM g JOIN lv a ON a.id = g.base_id JOIN lv b ON b.id = g.nn_id),
{_near('whole', False, 3)}, votes AS (SELECT id, nn_label, count(*) AS n FROM nn GROUP BY ALL),
w AS (SELECT id, nn_label AS vote FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, nn_label) = 1),
m AS (SELECT label FROM whole GROUP BY label ORDER BY count(*), label LIMIT 1)
SELECT x.id, x.label FROM whole x JOIN w USING (id) WHERE x.label = (SELECT label FROM m) OR w.vote = x.label""")
def smoteenn_rows(spark, d):
    """Oversampling, then cleaning: the chain as a run takes it."""
    _small_batches(spark)
    return balancing.balance(lang_vectors(spark, d), "smoteenn").select("id", "label")


_MACHINE = """l AS (SELECT label, unnest(range(64)) AS dim, unnest(features) AS x FROM v), m AS (SELECT label, dim, avg(x) AS m FROM l GROUP BY ALL),
sv AS (SELECT list(m ORDER BY dim) AS features, ((CAST(label AS INTEGER) % 7) - 3) / 10.0::DOUBLE AS coef FROM m GROUP BY label)"""


def class_means(rows: DataFrame) -> list:
    """Rows ``label, c``: the mean vector of each class, classes in order."""
    long = rows.select("label", F.posexplode("features").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return long.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c")).orderBy("label").collect()


def _machine_scores(spark, d) -> DataFrame:
    """``id, label, score`` of a machine with the classes' means as vectors and (class mod 7 - 3) / 10 as dual variables."""
    rows = vectors(spark, d)
    means = class_means(rows)
    pair = learners.PairMachine(("a", "b"), np.array([r["c"] for r in means]), np.array([(int(r["label"]) % 7 - 3) / 10 for r in means]), 0.25)
    model = learners.SvmModel(["a", "b"], learners.Scaler(np.zeros(64), np.ones(64)), 0.02, [pair])
    shared = spark.sparkContext.broadcast(model)  # a vector a class

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(features.to_numpy()))[:, 0] if len(features) else [], dtype="float64")

    return rows.select("id", "label", score("features").alias("score"))


@query(f"WITH {V}, {_MACHINE} SELECT v.id, round(sum(coef * exp(-0.02::DOUBLE * pow(array_distance(CAST(v.features AS DOUBLE[64]), CAST(sv.features AS DOUBLE[64])), 2))) + 0.25, 9) AS score FROM v, sv GROUP BY v.id")
def svm_scores(spark, d):
    """Decision values of a machine whose vectors and dual variables are given."""
    return _machine_scores(spark, d).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {V}, {_MACHINE}, sc AS (SELECT v.id, any_value(v.label) AS label, sum(coef * exp(-0.02::DOUBLE * pow(array_distance(CAST(v.features AS DOUBLE[64]), CAST(sv.features AS DOUBLE[64])), 2))) + 0.25 AS s FROM v, sv GROUP BY v.id),
c AS (SELECT count(*) FILTER (WHERE label < '5') AS n1, count(*) FILTER (WHERE label >= '5') AS n0 FROM sc),
r AS (SELECT s, ln((n0 + 1) / (n1 + 1)) AS b, CASE WHEN label < '5' THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t, 1 / (1 + exp(ln((n0 + 1) / (n1 + 1)))) AS p FROM sc, c),
ab AS (SELECT any_value(b) AS b, sum(s * (t - p)) AS g1, sum(t - p) AS g2, sum(s * s * p * (1 - p)) + 1e-12 AS h11, sum(s * p * (1 - p)) AS h12, sum(p * (1 - p)) + 1e-12 AS h22 FROM r)
SELECT round(-(h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), 3) AS slope, round(b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12), 3) AS offset_ FROM ab""")
def sigmoid_step(spark, d):
    """The first Newton step of a sigmoid on the scores of ``svm_scores``, classes 0 to 4 against the rest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        t, b = learners.sigmoid_targets(np.where(pdf["label"] < "5", 1, -1))
        _, move = learners.sigmoid_move(pdf["score"].to_numpy(), t, 0.0, b)
        return pd.DataFrame({"slope": [move[0]], "offset_": [b + move[1]]})

    rows = _machine_scores(spark, d).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "slope double, offset_ double")  # one task, as a fit is
    return rows.select(F.round("slope", 3).alias("slope"), F.round("offset_", 3).alias("offset_"))


_NET = f"""{V}, l AS (SELECT id, label, unnest(range(64)) AS i, unnest(features) AS x FROM v), n AS (SELECT count(*) AS n FROM v),
h AS (SELECT id, label, j, sum(x * (((i * 4 + j) % 7) - 3) / 20.0::DOUBLE) + j / 50.0::DOUBLE AS a FROM l, range(4) r(j) GROUP BY id, label, j),
z AS (SELECT id, label, k, sum(greatest(a, 0) * (((j * 10 + k) % 5) - 2) / 10.0::DOUBLE) AS z FROM h, range(10) r(k) GROUP BY ALL),
p AS (SELECT id, label, k, exp(z) / sum(exp(z)) OVER (PARTITION BY id) AS p FROM z),
b AS (SELECT id, k, (p - CASE WHEN label = CAST(k AS VARCHAR) THEN 1 ELSE 0 END) / n AS b FROM p, n),
back AS (SELECT h.id, h.j, sum(b * (((h.j * 10 + b.k) % 5) - 2) / 10.0::DOUBLE) * (CASE WHEN any_value(a) > 0 THEN 1 ELSE 0 END) AS b FROM h JOIN b USING (id) GROUP BY ALL)"""


@query(f"""WITH {_NET}, g AS (SELECT 1 AS layer, i AS row, j AS col, sum(x * b) + 0.1::DOUBLE * (((i * 4 + j) % 7) - 3) / 20.0::DOUBLE / any_value(n) AS g FROM l JOIN back USING (id), n GROUP BY i, j
UNION ALL SELECT 2, j, k, sum(greatest(a, 0) * b) + 0.1::DOUBLE * (((j * 10 + k) % 5) - 2) / 10.0::DOUBLE / any_value(n) FROM h JOIN b USING (id), n GROUP BY j, k)
SELECT CAST(layer AS BIGINT) AS layer, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(g, 9) + 0 AS gradient FROM g""")
def mlp_gradients(spark, d):
    """Gradients of one batch, all rows, for a network of given weights with four hidden units."""
    i, j, k = np.arange(64)[:, None], np.arange(4), np.arange(10)
    layers = [((i * 4 + j) % 7 - 3) / 20, j / 50], [((j[:, None] * 10 + k) % 5 - 2) / 10, np.zeros(10)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, grads = learners.mlp_gradients(np.stack(pdf["features"].to_numpy()).astype(np.float64), np.eye(10)[pdf["label"].astype(int)], [tuple(x) for x in layers], 0.1)
        parts = [(np.full(g.size, n + 1), *(a.ravel() for a in np.indices(g.shape)), g.ravel()) for n, (g, _) in enumerate(grads)]
        return pd.DataFrame(dict(zip(("layer", "row", "col", "gradient"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))

    rows = vectors(spark, d).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "layer long, row long, col long, gradient double")  # one task, as a fit is
    return rows.withColumn("gradient", F.round("gradient", 9) + 0.0)


# --- decisions and metrics ------------------------------------------------------------------------------------------

LABELS = [str(k) for k in range(10)]


def centroid_scores(spark: SparkSession, d: str) -> DataFrame:
    """``id, truth, cls, k, p``: softmax of negative distances to the classes' mean vectors, rounded."""
    v = vectors(spark, d)
    means = class_means(v)
    each = []
    for k, row in enumerate(means):
        square = F.aggregate(F.zip_with("features", F.array(*[F.lit(x) for x in row["c"]]), lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x)
        each.append(F.struct(F.lit(row["label"]).alias("cls"), F.lit(k).alias("k"), F.exp(-F.sqrt(square)).alias("e")))
    rows = v.select("id", F.col("label").alias("truth"), F.array(*each).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["e"])
    return rows.withColumn("t", total).select("id", "truth", "t", F.explode("s").alias("s")).select("id", "truth", "s.cls", "s.k", F.round(F.col("s.e") / F.col("t"), 9).alias("p"))


_SCORES = f"""{V}, l AS (SELECT id, label, unnest(range(64)) AS dim, unnest(features) AS x FROM v), m AS (SELECT label, dim, avg(x) AS m FROM l GROUP BY ALL),
e AS (SELECT l.id, l.label AS truth, m.label AS cls, exp(-sqrt(sum((l.x - m.m) * (l.x - m.m)))) AS e FROM l JOIN m USING (dim) GROUP BY ALL),
sc AS (SELECT id, truth, cls, round(e / sum(e) OVER (PARTITION BY id), 9) AS p FROM e)"""


def _decide(threshold: str = "0.5", source: str = "sc") -> str:
    return f"SELECT id, truth, cls AS pred FROM {source} QUALIFY row_number() OVER (PARTITION BY id ORDER BY p / greatest({threshold}, 1e-6) DESC, cls) = 1"


@query(f"WITH {_SCORES}, d AS ({_decide()}) SELECT id, truth, pred FROM d")
def centroid_predict(spark, d):
    scores = centroid_scores(spark, d)
    truth = scores.groupBy("id").agg(F.first("truth").alias("truth"))
    return thresholds.decide(scores).join(truth, "id").select("id", "truth", "pred")


_GRID = "g AS (SELECT a.label AS truth, b.label AS pred FROM (SELECT DISTINCT label FROM v) a, (SELECT DISTINCT label FROM v) b)"


@query(f"WITH {_SCORES}, d AS ({_decide()}), {_GRID} SELECT g.truth, g.pred, count(d.id) AS n FROM g LEFT JOIN d USING (truth, pred) GROUP BY ALL")
def confusion_matrix(spark, d):
    labels = vectors(spark, d).select("label").distinct()
    return metrics.confusion_matrix(centroid_predict(spark, d), labels)


_CLASS = """c AS (SELECT truth, pred, count(*) AS n FROM d GROUP BY ALL),
cs AS (SELECT class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted FROM (
  SELECT truth AS class, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM c UNION ALL SELECT pred, 0, 0, n FROM c) GROUP BY class),
s AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM cs)"""
_SUMMARY = "round(sum(tp) / sum(support), 9) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 9) AS balanced_accuracy, round(avg(precision), 9) AS precision_macro, round(avg(recall), 9) AS recall_macro, round(avg(f1), 9) AS f1_macro"


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"WITH {_SCORES}, d AS ({_decide()}), {_CLASS} SELECT {_SUMMARY} FROM s")
def metrics_summary(spark, d):
    return _rounded(metrics.summary(centroid_predict(spark, d)), metrics.METRICS)


@query(f"""WITH {_SCORES}, d AS ({_decide()}), {_CLASS}, t AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS a FROM s),
rep AS (SELECT class AS row, precision, recall, f1, support FROM s UNION ALL SELECT 'accuracy', a, a, a, n FROM t
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s)
SELECT row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rep""")
def classification_report(spark, d):
    return _rounded(metrics.report(centroid_predict(spark, d)), ("precision", "recall", "f1"))


@query(f"WITH {_SCORES} SELECT id, cls, round(p / sum(p) OVER (PARTITION BY id) + 5e-10, 6) AS p FROM sc")
def pair_coupling(spark, d):
    """Probabilities recovered from those of each pair of classes: the pairs are consistent, so what they came from is the answer."""

    @F.pandas_udf("array<double>")
    def coupled(probs: pd.Series) -> pd.Series:
        if not len(probs):
            return pd.Series([], dtype=object)
        p = np.stack(probs.to_numpy()).astype(np.float64)
        return pd.Series(list(learners.couple(p[:, :, None] / (p[:, :, None] + p[:, None, :]))))

    rows = _scored(spark, d).withColumn("p", coupled("probs"))
    names = F.array(*[F.lit(c) for c in LABELS])
    return rows.select("id", F.explode(F.arrays_zip(names.alias("cls"), F.col("p"))).alias("z")).select("id", "z.cls", F.round(F.col("z.p") + 5e-10, 6).alias("p"))  # scores have nine digits: no exact halves


def _two_stage(spark, d) -> DataFrame:
    scores = centroid_scores(spark, d)
    first = scores.groupBy("id", F.when(F.col("cls") == "0", "0").otherwise("non_0").alias("cls")).agg(F.sum("p").alias("p"))
    second = scores.where("cls <> '0'")
    return thresholds.compose_two_stages(first, second, LABELS[:8], "0", "non_0")


@query(f"""WITH {_SCORES}, f AS (SELECT id, sum(CASE WHEN cls = '0' THEN p END) AS p0, sum(CASE WHEN cls <> '0' THEN p END) AS p1 FROM sc GROUP BY id),
q AS (SELECT id, '0' AS cls, p0 AS q FROM f UNION ALL SELECT id, cls, p1 * p FROM sc JOIN f USING (id) WHERE cls <> '0' AND cls < '8')
SELECT id, cls, round(q / sum(q) OVER (PARTITION BY id), 7) AS p FROM q""")
def two_stage_compose(spark, d):
    return _two_stage(spark, d).withColumn("p", F.round("p", 7))


_LIMITS = {"0": 0.3, "3": 0.7, "5": 0.0, "7": 0.45}
_LIMIT_SQL = f"CASE cls {' '.join(f'WHEN {k!r} THEN {v}' for k, v in _LIMITS.items())} ELSE 0.5 END"


@query(f"WITH {_SCORES}, d AS ({_decide(f'({_LIMIT_SQL})::DOUBLE')}) SELECT id, pred FROM d")
def threshold_apply(spark, d):
    return thresholds.decide(centroid_scores(spark, d), thresholds.as_table(spark, _LIMITS))


def _scored(spark, d) -> DataFrame:
    rows = centroid_scores(spark, d).groupBy("id", "truth").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("s"))
    return rows.select("id", "truth", F.transform("s", lambda s: s["p"]).alias("probs"))


_POINTS = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate(thresholds.grid()))


@query(f"""WITH {_SCORES}, points AS (SELECT * FROM (VALUES {_POINTS}) t(g, thr)),
d AS (SELECT g, thr, id, truth, cls AS pred FROM sc, points QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY p / greatest(CASE WHEN cls = '3' THEN thr ELSE 0.5::DOUBLE END, 1e-6::DOUBLE) DESC, cls) = 1),
c AS (SELECT g, thr, truth, pred, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT g, thr, class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (SELECT g, thr, truth AS class, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM c UNION ALL SELECT g, thr, pred, 0, 0, n FROM c) GROUP BY ALL),
o AS (SELECT g, thr, sum(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END) / 10 AS f1, coalesce(max(CASE WHEN class = '3' THEN (CASE WHEN support > 0 THEN tp / support ELSE 0 END) END), 0) AS recall FROM s GROUP BY ALL)
SELECT CAST(g AS INTEGER) AS g, round(thr, 9) AS thr, round(f1 - greatest(0, 0.2 - recall), 9) AS objective FROM o""")
def threshold_grid_objective(spark, d):
    rows = thresholds.objectives(_scored(spark, d), "3", 3, {}, LABELS, ("3",), 0.2, thresholds.grid())
    return rows.select("g", F.round("thr", 9).alias("thr"), F.round("objective", 9).alias("objective"))


def _search(minority: tuple[str, ...]) -> str:
    """The pass over the classes as a chain of CTEs: each finds its class's best point with the limits found before."""
    parts = [_SCORES.replace("sc AS (", "sc AS MATERIALIZED ("), f"points AS (SELECT * FROM (VALUES {_POINTS}) t(g, thr))", "b0 AS (SELECT DISTINCT cls, 0.5::DOUBLE AS thr FROM sc)"]
    for k, c in enumerate([x for x in LABELS if x in minority] + [x for x in LABELS if x not in minority], 1):
        floor = f" - greatest(0, 0.2 - coalesce(max(CASE WHEN class = '{c}' THEN (CASE WHEN support > 0 THEN tp / support ELSE 0 END) END), 0))" if c in minority else ""
        parts += [
            f"d{k} AS (SELECT g, id, truth, sc.cls AS pred FROM sc JOIN b{k - 1} b ON b.cls = sc.cls, points QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY p / greatest(CASE WHEN sc.cls = '{c}' THEN points.thr ELSE b.thr END, 1e-6::DOUBLE) DESC, sc.cls) = 1)",
            f"c{k} AS (SELECT g, truth, pred, count(*) AS n FROM d{k} GROUP BY ALL)",
            f"s{k} AS (SELECT g, class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (SELECT g, truth AS class, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM c{k} UNION ALL SELECT g, pred, 0, 0, n FROM c{k}) GROUP BY ALL)",
            f"o{k} AS (SELECT g, sum(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END) / 10{floor} AS objective FROM s{k} GROUP BY g)",
            f"t{k} AS MATERIALIZED (SELECT thr FROM o{k} JOIN points USING (g) ORDER BY round(objective, 12) DESC, g LIMIT 1)",
            f"b{k} AS MATERIALIZED (SELECT cls, CASE WHEN cls = '{c}' THEN (SELECT thr FROM t{k}) ELSE thr END AS thr FROM b{k - 1})",
        ]
    return f"WITH {', '.join(parts)} SELECT cls, round(thr, 9) AS thr FROM b{len(LABELS)}"


@query(_search(("3", "7")))
def threshold_search(spark, d):
    """The whole pass, a chain of ten dependent jobs."""
    scored = _scored(spark, d).persist()
    found = thresholds.search(scored, LABELS, ("3", "7"))
    scored.unpersist()
    return thresholds.as_table(spark, found).withColumn("thr", F.round("thr", 9))


_BY_ROUND = _ROUNDS[5:] + f""", {_SCORES}, dd AS ({_decide()}), d AS (SELECT rows_.round, dd.truth, dd.pred FROM rows_ JOIN dd USING (id)),
c AS (SELECT round, truth, pred, count(*) AS n FROM d GROUP BY ALL),
cs AS (SELECT round, class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (SELECT round, truth AS class, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM c UNION ALL SELECT round, pred, 0, 0, n FROM c) GROUP BY ALL),
rm AS (SELECT round, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END) AS f1_macro FROM cs GROUP BY round)"""


def _round_metrics(spark, d) -> DataFrame:
    rounds = coverage_rounds(spark, d).select("round", "id")
    rows = rounds.join(centroid_predict(spark, d), "id")
    return metrics.summary(rows, by=("round",)).select("round", "accuracy", "f1_macro")


@query(f"WITH {_BY_ROUND} SELECT count(*) AS rounds, round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std, round(avg(f1_macro), 9) AS f1_macro_mean, arg_max(round, {{'a': accuracy, 'r': -round}}) AS best_round, round(max(accuracy), 9) AS best_accuracy FROM rm")
def round_metrics_summary(spark, d):
    return _rounded(metrics.rounds_summary(_round_metrics(spark, d)), ("accuracy_mean", "accuracy_std", "f1_macro_mean", "best_accuracy"))


@query(f"WITH {_BY_ROUND} SELECT round, round(accuracy, 9) AS accuracy, round(f1_macro, 9) AS f1_macro FROM rm ORDER BY rm.accuracy DESC, round LIMIT 1")
def best_round(spark, d):
    top = _round_metrics(spark, d).orderBy(F.desc("accuracy"), "round").limit(1)
    return _rounded(top, ("accuracy", "f1_macro"))
