"""Image files as tables: headers without pixels, or planes of pixels.

Files come through Spark's binary reader, so any file system works. Formats:
.npy, and uncompressed grey TIFF (8, 16, 32 bit). Workers decode one file at a
time; prefer Parquet tiles for large images.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issq.session import ship


def headers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and modification time; contents stay unread."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def npy_header(data: bytes) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, whether columns come first, and where the pixels start."""
    size = struct.unpack("<H", data[8:10])[0] if data[6] == 1 else struct.unpack("<I", data[8:12])[0]
    start = 10 if data[6] == 1 else 12
    info = ast.literal_eval(data[start : start + size].decode("latin1"))
    return tuple(info["shape"]), np.dtype(info["descr"]), info["fortran_order"], start + size


def decode_npy(data: bytes) -> np.ndarray:
    shape, kind, columns_first, start = npy_header(data)
    return np.frombuffer(data, dtype=kind, offset=start).reshape(shape, order="F" if columns_first else "C")


def decode_tiff(data: bytes) -> np.ndarray:
    """All pages of a plain TIFF, stacked."""
    end = "<" if data[:2] == b"II" else ">"
    at, pages = struct.unpack(end + "I", data[4:8])[0], []
    width_of = {1: "B", 3: "H", 4: "I"}
    while at:
        tags = {}
        for k in range(struct.unpack(end + "H", data[at : at + 2])[0]):
            p = at + 2 + 12 * k
            tag, kind, n = struct.unpack(end + "HHI", data[p : p + 8])
            if kind in width_of:
                form = end + str(n) + width_of[kind]
                where = p + 8 if struct.calcsize(form) <= 4 else struct.unpack(end + "I", data[p + 8 : p + 12])[0]
                tags[tag] = struct.unpack(form, data[where : where + struct.calcsize(form)])
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF files are not supported")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags.get(258, (8,))[0] // 8)
        body = b"".join(data[o : o + c] for o, c in zip(tags[273], tags[279]))
        pages.append(np.frombuffer(body, dtype=np.dtype(end + kind)).reshape(tags[257][0], tags[256][0]))
        next_ = at + 2 + 12 * struct.unpack(end + "H", data[at : at + 2])[0]
        at = struct.unpack(end + "I", data[next_ : next_ + 4])[0]
    return pages[0] if len(pages) == 1 else np.stack(pages)


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            image = decode_npy(data) if data[:6] == b"\x93NUMPY" else decode_tiff(data)
            flat = image.reshape(-1, *image.shape[-2:]) if image.ndim > 1 else image.reshape(1, 1, -1)
            for k, plane in enumerate(flat):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([k], pa.int32()), pa.array([plane.shape[0]], pa.int32()), pa.array([plane.shape[1]], pa.int32()), pa.array([plane.astype(float).ravel()], pa.list_(pa.float64()))],
                    names=["path", "plane", "width", "height", "v"],
                )


def planes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, plane, width, height, v (row by row)."""
    ship(spark)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return rows.mapInArrow(_planes, "path string, plane int, width int, height int, v array<double>")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if data[:6] == b"\x93NUMPY":
                shape, kind, _, _ = npy_header(data)
            else:
                image = decode_tiff(data)
                shape, kind = image.shape, image.dtype
            size = int(np.prod(shape, dtype=np.int64)) * kind.itemsize
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([list(shape)], pa.list_(pa.int64())), pa.array([kind.name]), pa.array([size], pa.int64())], names=["path", "shape", "dtype", "nbytes"])


def described(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, shape, dtype, nbytes of the pixels of each image file."""
    ship(spark)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return rows.mapInArrow(_described, "path string, shape array<long>, dtype string, nbytes long")
