"""A Spark data source for MAT files of level 5: every numeric variable as cells.

``spark.read.format("mat").load(folder_or_file)`` gives file, variable, u, v and w: the non-zero and the NaN cells of
each real matrix, rows and columns from 0, with NULL for NaN. Level 7.3 files are HDF5 and are refused by name.
Register the source with ``register(spark)``.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, variable string, u int, v int, w double"

#: Fixed values of the format: data types and array classes.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15
_SPARSE, _NUMERIC = 5, range(6, 16)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: type and size share four bytes, the data the next four
            size, kind = kind >> 16, kind & 0xFFFF
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)


def _numbers(element: tuple[int, bytes], order: str) -> np.ndarray:
    return np.frombuffer(element[1], order + _TYPES[element[0]])


def variables(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Name and dense matrix of each real numeric variable of at most two dimensions."""
    if data[:4] == b"\x89HDF" or b"MATLAB 7.3" in data[:128]:
        raise ValueError("a level 7.3 file (HDF5) is not supported")
    order = "<" if data[126:128] == b"IM" else ">"
    for kind, body in _elements(data[128:], order):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind != _MATRIX:
            continue
        parts = list(_elements(body, order))
        flags = _numbers(parts[0], order)
        of, shape, name = int(flags[0]) & 0xFF, tuple(_numbers(parts[1], order).tolist()), parts[2][1].decode("latin-1").rstrip("\0")
        if len(shape) != 2 or int(flags[0]) & 0x800:
            continue
        if of in _NUMERIC:
            yield name, _numbers(parts[3], order).astype(float).reshape(shape, order="F")
        elif of == _SPARSE:
            rows, starts, values = (_numbers(p, order) for p in parts[3:6])
            out = np.zeros(shape)
            held = int(starts[-1])
            out[rows[:held], np.repeat(np.arange(shape[1]), np.diff(starts))] = values[:held]
            yield name, out


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".mat")]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        for name, x in variables(data):
            for u, v in zip(*np.nonzero(x), strict=True):
                w = float(x[u, v])
                yield os.path.basename(partition.path), name, int(u), int(v), None if np.isnan(w) else w


class MatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatSource)
