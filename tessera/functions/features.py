"""From decoded images to feature vectors: one Arrow UDF whose blocks follow the configuration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import defaults
from ..defaults import record
from . import kernels as K

Preparation = record("Preparation", defaults.PREPARATION, "Size of the image, removal of hair, evening out of light.")
Segmentation = record("Segmentation", defaults.SEGMENTATION, "Steps of the level set, and the weights of inside and outside.")
Texture = record("Texture", defaults.TEXTURE, "Which groups of features there are, and what they measure.")
#: Groups in the order of the vector.
Texture.GROUPS = ("lbp_roi", "lbp_bimf1", "glcm", "hsv", "abcd")
_MEASURES = {"glcm": ("contrast", "homogeneity", "energy", "correlation"), "abcd": ("asymmetry", "border_irregularity", "color_var", "diameter")}


def feature_columns(texture: Texture) -> list[str]:
    """Names of the enabled groups' columns, in the order of the vector."""
    parts = {"lbp_roi": range(texture.bins), "lbp_bimf1": range(texture.bins), "hsv": [f"{c}_{i}" for c, n in zip("hsv", texture.colour_bins, strict=True) for i in range(n)], **_MEASURES}
    return [f"{group}_{x}" for group in texture.GROUPS if getattr(texture, group) for x in parts[group]]


def preprocess(bgr: np.ndarray, how: Preparation) -> np.ndarray:
    """Resize, then remove hair and even out the light as configured."""
    image = K.resize_area(bgr, how.size, how.size)
    if how.hair:
        image = K.inpaint(image, (K.blackhat(K.gray(image), how.hair_window) > 10).astype(np.uint8), how.fill_radius)
    if how.light:
        lab = K.bgr_to_lab(image)
        lab[..., 0] = K.clahe(lab[..., 0], how.clip, tuple(how.tiles))
        image = K.lab_to_bgr(lab)
    return image


def image_features(bgr: np.ndarray, run) -> np.ndarray:
    """The feature vector of one image under the parts ``preparation``, ``segmentation`` and ``texture`` of a run. Planes that
    no enabled group needs aren't made: the first mode alone stands for the decomposition, and only for its histogram."""
    image, t = preprocess(bgr, run.preparation), run.texture
    mask = K.lesion_mask(image, run.segmentation.steps, run.segmentation.inside, run.segmentation.outside)
    plane = K.gray(image)

    def patterns(p: np.ndarray) -> np.ndarray:
        return K.histogram(K.lbp(p, t.points, t.radius, t.method)[None], mask[None], t.bins, 0, t.bins)[0]

    def first_mode() -> np.ndarray:
        mode = K.first_mode(plane, t.window, t.smooth)
        return plane if mode is None else K.stretch(mode)

    def colours() -> np.ndarray:
        planes = K.hsv(image)
        return np.concatenate([K.histogram(planes[None, ..., k], mask[None], t.colour_bins[k], 0, top)[0] for k, top in enumerate((180, 256, 256))])

    make = {"lbp_roi": lambda: patterns(plane), "lbp_bimf1": lambda: patterns(first_mode()), "glcm": lambda: K.glcm_stats(plane[None], mask[None], t.distances, t.angles)[0], "hsv": colours, "abcd": lambda: K.abcd(mask, image)}
    blocks = [make[group]() for group in t.GROUPS if getattr(t, group)]
    if not blocks:
        raise ValueError("no feature group is enabled")
    return np.concatenate(blocks).astype(np.float32)


def extract(images: DataFrame, run_) -> DataFrame:
    """All columns of ``images`` but ``image``, and ``features``. ``image`` is the struct of Spark's image source (BGR,
    8-bit; one, three or four channels). An image that couldn't be decoded is an error that names its origin."""
    rest = [c for c in images.columns if c != "image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = batch.column("image")
            for k in range(batch.num_rows):
                row = image[k].as_py()
                if not row or row["height"] is None or row["height"] < 1:
                    raise ValueError(f"can't read image {row and row['origin']}")
                cells = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                bgr = np.repeat(cells, 3, axis=2) if row["nChannels"] == 1 else cells[..., :3]
                vector = pa.array([image_features(bgr, run_)], pa.list_(pa.float32()))
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in rest], vector], [*rest, "features"])

    schema = T.StructType([*images.select(*rest).schema.fields, T.StructField("features", T.ArrayType(T.FloatType()))])
    return images.mapInArrow(run, schema)
