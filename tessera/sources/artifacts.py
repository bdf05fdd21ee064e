"""Run artifacts: small files on any file system Spark reaches, written and read by the driver."""

from __future__ import annotations

import json
import struct
import zlib
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

MODEL, COLUMNS, LABELS, CONFIG, THRESHOLDS = "model.zip", "feature_columns.json", "label_classes.json", "run_config.json", "thresholds.json"


class Artifacts:
    """A folder of small files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def write(self, name: str, data: bytes | str) -> None:
        fs, path = self._path(name)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(data.encode() if isinstance(data, str) else data))
        finally:
            stream.close()

    def read(self, name: str) -> bytes:
        fs, path = self._path(name)
        if not fs.exists(path):
            raise FileNotFoundError(f"{self.folder}/{name}")
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_json(self, name: str, value: Any) -> None:
        self.write(name, json.dumps(value, ensure_ascii=False, indent=2))

    def read_json(self, name: str) -> Any:
        return json.loads(self.read(name))

    def write_csv(self, name: str, header: list[str], rows: list[tuple]) -> None:
        quote = lambda v: '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\n') else str(v)
        self.write(name, "\n".join(",".join("" if v is None else quote(v) for v in r) for r in [header, *rows]) + "\n")

    def copy(self, name: str, to: Artifacts) -> bool:
        if not self.exists(name):
            return False
        to.write(name, self.read(name))
        return True


# 3 x 5 cells of the digits 0 to 9, rows from the top.
_DIGITS = ("111101101101111", "010110010010111", "111001111100111", "111001111001111", "101101111001001", "111100111001111", "111100111101111", "111001001001001", "111101111101111", "111101111001111")


def png(image: np.ndarray) -> bytes:
    """An 8-bit RGB image as PNG."""
    h, w, _ = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def heat_map(matrix: np.ndarray, cell: int = 48) -> np.ndarray:
    """A confusion matrix as an image: rows are truth; counts are white where the cell is over half the maximum."""
    k, top = len(matrix), max(int(matrix.max(initial=0)), 1)
    out = np.full((k * cell + 1, k * cell + 1, 3), 255, np.uint8)
    for i in range(k):
        for j in range(k):
            share = matrix[i, j] / top
            # Light and dark end of the blue scale.
            out[i * cell + 1 : (i + 1) * cell, j * cell + 1 : (j + 1) * cell] = np.rint((1 - share) * np.array([247, 251, 255]) + share * np.array([8, 48, 107]))
            text = str(int(matrix[i, j]))
            scale = max(1, min(3, (cell - 4) // (4 * len(text))))
            x, y = j * cell + (cell - (4 * len(text) - 1) * scale) // 2, i * cell + (cell - 5 * scale) // 2
            for n, digit in enumerate(text):
                bits = np.array([int(b) for b in _DIGITS[int(digit)]], bool).reshape(5, 3).repeat(scale, 0).repeat(scale, 1)
                area = out[y : y + 5 * scale, x + 4 * scale * n : x + 4 * scale * n + 3 * scale]
                area[bits] = 255 if matrix[i, j] > top / 2 else 0
    return out
