"""HDF4 files: the subset that gridded satellite tiles use, as a parser and as a Spark data source.

A file is a magic number and blocks of descriptors (tag, reference, offset, length), big-endian. A data set is a group found by its name; its
numeric data group names the dimensions, the number type and the data, which may be deflated, chunked or linked.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The magic number, tags, special-element codes and number types of the format.
MAGIC = b"\x0e\x03\x13\x01"
NUMBER_TYPE, DIMENSIONS, DATA, DATA_GROUP, VDATA_HEADER, VDATA, VGROUP, COMPRESSED, CHUNK = 106, 701, 702, 720, 1962, 1963, 1965, 40, 61
EXTENDED = 0x4000
LINKED, COMP, CHUNKED = 1, 3, 5
DTYPES = {3: "u1", 4: "i1", 5: ">f4", 6: ">f8", 20: "i1", 21: "u1", 22: ">i2", 23: ">u2", 24: ">i4", 25: ">u4"}


@dataclass(frozen=True)
class Grid:
    name: str
    values: np.ndarray
    attributes: dict


class HdfFile:
    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not an HDF4 file")
        self.data, self.index = data, {}
        at = 4
        while at:
            count, following = struct.unpack_from(">HI", data, at)
            for k in range(count):
                tag, ref, offset, length = struct.unpack_from(">HHII", data, at + 6 + 12 * k)
                if tag not in (0, 1):
                    self.index[tag, ref] = (offset, length)
            at = following

    def element(self, tag: int, ref: int) -> bytes:
        if (tag, ref) in self.index:
            offset, length = self.index[tag, ref]
            return self.data[offset : offset + length]
        if (tag | EXTENDED, ref) in self.index:
            return self._extended(*self.index[tag | EXTENDED, ref])
        raise KeyError((tag, ref))

    def _extended(self, offset: int, length: int) -> bytes:
        (code,) = struct.unpack_from(">H", self.data, offset)
        if code == COMP:
            _, _, size, ref, _, kind = struct.unpack_from(">HHIHHH", self.data, offset)
            raw = self.element(COMPRESSED, ref)
            if kind not in (0, 4):
                raise ValueError(f"compression {kind} is not read")
            return (zlib.decompress(raw) if kind == 4 else raw)[:size]
        if code == LINKED:
            _, total, size, per_block, ref = struct.unpack_from(">HIIIH", self.data, offset)
            parts = []
            while ref:
                block = self.element(20, ref)
                (ref,) = struct.unpack_from(">H", block)
                parts += [self.element(20, r) for r in struct.unpack_from(f">{per_block}H", block, 2) if r]
            return b"".join(parts)[:total]
        if code == CHUNKED:
            return self._chunked(offset)
        raise ValueError(f"extended element {code} is not read")

    def _chunked(self, offset: int) -> bytes:
        _, _, _, _, _, _, _, ntype, table_tag, table_ref, _, _, ndims = struct.unpack_from(">HIBIIIIIHHHHI", self.data, offset)
        dims = [struct.unpack_from(">III", self.data, offset + 43 + 12 * k) for k in range(ndims)]
        shape, chunk = [d[1] for d in dims], [d[2] for d in dims]
        out, kind = np.zeros(shape, f"V{ntype}" if ntype else "u1"), f"V{ntype}" if ntype else "u1"
        table = self.element(table_tag, table_ref)
        row = 4 * ndims + 4
        for k in range(len(table) // row):
            *origin, tag, ref = struct.unpack_from(f">{ndims}IHH", table, k * row)
            part = np.frombuffer(self.element(tag, ref), kind).reshape(chunk)
            where = tuple(slice(o * c, min((o + 1) * c, s)) for o, c, s in zip(origin, chunk, shape))
            out[where] = part[tuple(slice(0, w.stop - w.start) for w in where)]
        return out.tobytes()

    def groups(self) -> Iterator[tuple[int, str, str, list[tuple[int, int]]]]:
        """(reference, name, class, members) of each group."""
        for tag, ref in list(self.index):
            if tag == VGROUP:
                raw = self.element(VGROUP, ref)
                (n,) = struct.unpack_from(">H", raw)
                tags, refs = struct.unpack_from(f">{n}H", raw, 2), struct.unpack_from(f">{n}H", raw, 2 + 2 * n)
                at, names = 2 + 4 * n, []
                for _ in range(2):
                    (size,) = struct.unpack_from(">H", raw, at)
                    names.append(raw[at + 2 : at + 2 + size].decode("latin-1").rstrip("\0"))
                    at += 2 + size
                yield ref, names[0], names[1], list(zip(tags, refs))

    def attributes(self) -> dict[str, bytes]:
        """The data of each named vdata."""
        out = {}
        for tag, ref in list(self.index):
            if tag == VDATA_HEADER:
                raw = self.element(tag, ref)
                _, _, _, fields = struct.unpack_from(">HIHH", raw)
                at = 10 + 8 * fields
                for _ in range(fields):
                    at += 2 + struct.unpack_from(">H", raw, at)[0]
                (size,) = struct.unpack_from(">H", raw, at)
                name = raw[at + 2 : at + 2 + size].decode("latin-1")
                if (VDATA, ref) in self.index or (VDATA | EXTENDED, ref) in self.index:
                    out[name] = self.element(VDATA, ref)
        return out

    def grid(self, name: str) -> Grid:
        for _, group, _, members in self.groups():
            if group != name:
                continue
            for tag, ref in members:
                if tag == DATA_GROUP:
                    raw = self.element(tag, ref)
                    parts = dict(struct.unpack_from(">HH", raw, 4 * k) for k in range(len(raw) // 4))
                    dims = self.element(DIMENSIONS, parts[DIMENSIONS])
                    (rank,) = struct.unpack_from(">H", dims)
                    shape = struct.unpack_from(f">{rank}I", dims, 2)
                    _, type_ref = struct.unpack_from(">HH", dims, 2 + 4 * rank)
                    kind = DTYPES[self.element(NUMBER_TYPE, type_ref)[1]]
                    values = np.frombuffer(self.element(DATA, parts[DATA]), kind).reshape(shape)
                    return Grid(name, values, self.attributes())
        raise KeyError(name)


def tile_of(attributes: dict, filename: str = "") -> tuple[int, int] | None:
    """(h, v) from the metadata, else from a file name with .hXXvYY."""
    text = b"".join(v for k, v in attributes.items() if k.startswith(("CoreMetadata", "ArchiveMetadata"))).decode("latin-1")
    h, v = (re.search(rf'{side}TILENUMBER"[^;]*?VALUE\s*=\s*"?(\d+)', text, re.S) for side in ("HORIZONTAL", "VERTICAL"))
    if h and v:
        return int(h[1]), int(v[1])
    m = re.search(r"h(\d\d)v(\d\d)", filename)
    return (int(m[1]), int(m[2])) if m else None


ROWS = "path string, tile_h int, tile_v int, row int, col int, x double, y double, value int"


def read(spark: SparkSession, path: str, dataset: str, fill: int | None = None) -> DataFrame:
    """A row for each cell of the data set in each file: x, y in degrees of the sinusoidal grid's tile; rows with ``fill`` go. One file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                grid = HdfFile(bytes(content)).grid(dataset)
                h, v = tile_of(grid.attributes, p) or (0, 0)
                n, m = grid.values.shape
                r, c = np.nonzero(grid.values != fill) if fill is not None else np.nonzero(np.ones_like(grid.values, bool))
                lat = 90 - 10 * v - 10 * (r + 0.5) / n
                lon = (10 * h - 180 + 10 * (c + 0.5) / m) / np.cos(np.radians(lat))
                yield pd.DataFrame({"path": p, "tile_h": h, "tile_v": v, "row": r, "col": c, "x": lon, "y": lat, "value": grid.values[r, c].astype(np.int64)})

    return files.mapInPandas(run, ROWS)


def with_day(df: DataFrame) -> DataFrame:
    """Adds ``day`` from the folder of the file: yyyy.MM.dd."""
    return df.withColumn("day", F.to_date(F.regexp_extract("path", r"(\d{4}\.\d{2}\.\d{2})", 1), "yyyy.MM.dd"))
