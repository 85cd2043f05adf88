"""Numpy arrays that all workers map from one file, instead of each holding a copy.

The driver writes the arrays one after the other into a file of the shared folder. Where that
folder is a path that workers can open, they map the file itself. In another store Spark
hands the file to every executor, once, and its workers map that copy.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from cardwatch.llm.base import scratch

_ALIGNED = 64


@dataclass(frozen=True)
class SharedArrays:
    """Where the arrays are: (dtype, shape, offset) by name, and the file, as a path or as a name Spark knows."""

    parts: dict[str, tuple[str, tuple[int, ...], int]]
    path: str | None
    name: str

    def load(self) -> dict[str, np.ndarray]:
        path = self.path or SparkFiles.get(self.name)
        return {
            name: np.memmap(path, dtype, mode="r", offset=offset, shape=shape).view(np.ndarray)
            for name, (dtype, shape, offset) in self.parts.items()
        }


def _write(arrays: dict[str, np.ndarray], path: str) -> dict[str, tuple[str, tuple[int, ...], int]]:
    parts = {}
    with open(path, "wb") as out:
        for name, array in arrays.items():
            out.write(b"\0" * (-out.tell() % _ALIGNED))
            parts[name] = (array.dtype.str, array.shape, out.tell())
            np.ascontiguousarray(array).tofile(out)
    return parts


def share(spark: SparkSession, arrays: dict[str, np.ndarray], purpose: str) -> SharedArrays:
    """Write arrays (none of them empty) where the workers of this session find them."""
    folder = scratch(spark, purpose)
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        os.makedirs(where.path, exist_ok=True)
        path = f"{where.path}/arrays"
        return SharedArrays(_write(arrays, path), path, "")
    name = folder.rsplit("/", 1)[-1]
    with tempfile.TemporaryDirectory() as own:  # the driver's, on the way to the store
        parts = _write(arrays, f"{own}/{name}")
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        store = there.getFileSystem(spark._jsc.hadoopConfiguration())
        store.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{own}/{name}"), there)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return SharedArrays(parts, None, name)
