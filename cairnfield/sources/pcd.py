"""Point cloud files in the public PCD format: ASCII, binary and compressed, read in blocks.

Registered with ``spark.dataSource.register(PcdSource)``, then
``spark.read.format("pcd").schema(...).load(path)`` reads ASCII and binary files of mounted
folders. A binary file is cut into ranges of points, which tasks read on their own; an
ASCII file is one task that streams its lines. ``read_files`` reads files of all three
kinds on any file system that Spark knows, one task a file.
"""

from __future__ import annotations

import glob
import io
import os
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK_POINTS = 1 << 18
KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}


def header(path: str) -> dict:
    """The fields of a file's header, and the byte where its data begins."""
    with open(path, "rb") as f:
        return _header(f)


def _header(f: io.BufferedIOBase) -> dict:
    out: dict = {}
    for line in iter(f.readline, b""):
        words = line.decode("ascii").split()
        if words and not words[0].startswith("#"):
            out[words[0]] = words[1:]
        if words and words[0] == "DATA":
            break
    out["begin"] = f.tell()
    counts = list(map(int, out.get("COUNT", ["1"] * len(out["FIELDS"]))))
    out["types"] = np.dtype([(n, KINDS[t, int(s)], (c,)) if c > 1 else (n, KINDS[t, int(s)]) for n, t, s, c in zip(out["FIELDS"], out["TYPE"], out["SIZE"], counts, strict=True)])
    out["n"] = int(out["POINTS"][0]) if "POINTS" in out else int(out["WIDTH"][0]) * int(out["HEIGHT"][0])
    return out


#: LZF: the longest run of plain bytes, the longest repeat and the farthest it reaches back.
PLAIN, REPEAT, REACH = 32, 264, 1 << 13


def expanded(raw: bytes, size: int) -> bytes:
    """The ``size`` bytes that the LZF stream ``raw`` stands for; ValueError if it is damaged."""
    out, at = bytearray(), 0
    try:
        while at < len(raw):
            mark = raw[at]
            at += 1
            if mark < PLAIN:
                out += raw[at : at + mark + 1]
                at += mark + 1
                continue
            n = mark >> 5
            if n == 7:
                n += raw[at]
                at += 1
            back, n = ((mark & 31) << 8 | raw[at]) + 1, n + 2
            at += 1
            if back > len(out) or len(out) + n > size:
                raise IndexError
            begin = len(out) - back
            # a repeat may run into itself
            out += out[begin : begin + n] if back >= n else (out[begin:] * (n // back + 1))[:n]
    except IndexError:
        raise ValueError("the compressed data are damaged") from None
    if len(out) != size:
        raise ValueError(f"the compressed data hold {len(out)} bytes, not {size}")
    return bytes(out)


def compressed(raw: bytes) -> bytes:
    """An LZF stream for ``raw``: each place repeats the latest one with the same three bytes."""
    out, seen, begin, at = bytearray(), {}, 0, 0

    def plain(end: int) -> None:
        for k in range(begin, end, PLAIN):
            part = raw[k : min(end, k + PLAIN)]
            out.append(len(part) - 1)
            out.extend(part)

    while at + 2 < len(raw):
        key = raw[at : at + 3]
        before, seen[key] = seen.get(key), at
        if before is None or at - before > REACH:
            at += 1
            continue
        n, most = 3, min(REPEAT, len(raw) - at)
        while n < most and raw[before + n] == raw[at + n]:
            n += 1
        plain(at)
        back, size = at - before - 1, n - 2
        out.append(min(size, 7) << 5 | back >> 8)
        if size >= 7:
            out.append(size - 7)
        out.append(back & 255)
        begin = at = at + n
    plain(len(raw))
    return bytes(out)


def _blocks(raw: bytes, most_bytes: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """A file's fields in blocks of BLOCK_POINTS points, each with its first point's number."""
    f = io.BytesIO(raw)
    h = _header(f)
    kind, types, n = h["DATA"][0], h["types"], h["n"]
    if kind == "ascii":
        edges = np.cumsum([0, *(int(np.prod(types[c].shape)) for c in types.names)])
        for k in range(0, n, BLOCK_POINTS):
            words = [line.split() for line in islice(f, min(BLOCK_POINTS, n - k))]
            yield k, {c: np.array([w[a:b] for w in words]).astype(types[c].base).reshape(len(words), *types[c].shape) for c, a, b in zip(types.names, edges, edges[1:], strict=False)}
        return
    if kind == "binary":
        rows = np.frombuffer(raw, types, n, h["begin"])
        columns = {c: rows[c] for c in types.names}
    elif kind == "binary_compressed":
        size, whole = struct.unpack_from("<II", raw, h["begin"])
        if whole > most_bytes or whole != n * types.itemsize:
            raise ValueError(f"{n} points state {whole} bytes; {n * types.itemsize} are right and at most {most_bytes} are read at once")
        data, columns, at = expanded(raw[h["begin"] + 8 : h["begin"] + 8 + size], whole), {}, 0
        for c in types.names:
            columns[c] = np.frombuffer(data, types[c].base, n * int(np.prod(types[c].shape)), at).reshape(n, *types[c].shape)
            at += n * types[c].itemsize
    else:
        raise ValueError(f"data of kind {kind} can't be read")
    for k in range(0, n, BLOCK_POINTS):
        yield k, {c: v[k : k + BLOCK_POINTS] for c, v in columns.items()}


def _points(schema: T.StructType, most_bytes: int) -> Callable:
    kinds = {f.name: T.StructType([f]) for f in schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = {n: to_arrow_schema(kind).field(0).type for n, kind in kinds.items()}
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for first, fields in _blocks(content.as_py(), most_bytes):
                    size = len(next(iter(fields.values())))
                    number = np.arange(first, first + size)
                    columns = []
                    for name, kind in types.items():
                        values = number if name == "point_id" else fields.get(name)
                        columns.append(pa.nulls(size, kind) if values is None else pa.array(values.tolist() if values.ndim > 1 else np.ascontiguousarray(values)).cast(kind, safe=False))
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * size, pa.string()), *columns], names=["path", *types])

    return run


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [_header(io.BytesIO(content.as_py()))["n"] for content in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(n, pa.int64())], names=["path", "n"])


def read_files(spark: SparkSession, path: str, schema: str = "point_id long, x float, y float, z float", most_bytes: int = 1 << 30) -> DataFrame:
    """The points of the files at ``path`` (a file, a folder or a pattern, of any scheme that
    Spark knows), ASCII, binary or ``binary_compressed``.

    Columns of ``schema`` are taken by name; a field that a file lacks is null. ``point_id`` counts
    on from file to file in the order of their paths; files are read once more for their sizes if it is
    asked for. Spark hands a whole file to a task, which emits blocks of BLOCK_POINTS points; a
    compressed file is one stream, so it is held as a whole, up to ``most_bytes``; more is an error.
    """
    wanted = T.StructType.fromDDL(schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").load(path).select("path", "content")
    rows = files.mapInArrow(_points(wanted, most_bytes), T.StructType([T.StructField("path", T.StringType()), *wanted]))
    if "point_id" not in wanted.names:
        return rows.drop("path")
    # a row a file, as in the list of files that the driver holds
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.mapInArrow(_sizes, "path string, n long").select(F.col("path").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, F.col("path") == F.col("of")).select(*((F.col(c) + F.col("start")).alias(c) if c == "point_id" else c for c in wanted.names))


class Range(InputPartition):
    def __init__(self, path: str, first: int, number: int, offset: int):
        self.path, self.first, self.number, self.offset = path, first, number, offset


class PcdReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[Range]:
        """Ranges of points; identifiers count on from file to file in the order of names."""
        out, offset = [], 0
        for path in sorted(glob.glob(os.path.join(self.path, "*.pcd")) if os.path.isdir(self.path) else glob.glob(self.path)):
            n = header(path)["n"]
            step = BLOCK_POINTS if header(path)["DATA"] == ["binary"] else max(1, n)
            out += [Range(path, k, min(step, n - k), offset) for k in range(0, n, step)]
            offset += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.number:
            return
        h = header(partition.path)
        kind = h["DATA"][0]
        if kind not in ("ascii", "binary"):
            raise ValueError(f"{partition.path}: data are {kind}; only ascii and binary can be read so, all by read_files")
        with open(partition.path, "rb") as f:
            f.seek(h["begin"] + (partition.first * h["types"].itemsize if kind == "binary" else 0))
            if kind == "binary":
                rows = np.frombuffer(f.read(partition.number * h["types"].itemsize), h["types"])
                columns = [rows[n].tolist() if n in h["types"].names else None for n in self.names]
                for k in range(len(rows)):
                    yield tuple(partition.offset + partition.first + k if n == "point_id" else c[k] if c is not None else None for n, c in zip(self.names, columns, strict=True))
                return
            places = {n: i for i, n in enumerate(h["FIELDS"])}
            integers = {n for n, t in zip(h["FIELDS"], h["TYPE"], strict=True) if t != "F"}
            for k, line in zip(range(partition.number), f, strict=False):
                words = line.split()
                yield tuple(partition.offset + k if n == "point_id" else (int if n in integers else float)(words[places[n]]) if n in places else None for n in self.names)


class PcdWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool, data: str):
        if data not in ("binary", "binary_compressed"):
            raise ValueError(f"data are written as binary or binary_compressed, not {data}")
        self.path, self.names, self.data = path, names, data
        if overwrite and os.path.isdir(path):
            for old in glob.glob(os.path.join(path, "*.pcd")):
                os.remove(old)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Files of float fields with up to BLOCK_POINTS points each, which is all that a
        task holds; the points' order isn't kept."""
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        fields, number = [c for c in self.names if c != "point_id"], 0
        while number == 0 or block:
            block = [[float("nan") if row[c] is None else row[c] for c in fields] for row in islice(rows, BLOCK_POINTS)]
            if block or number == 0:
                self._write(fields, np.array(block, "<f4").reshape(len(block), len(fields)), f"part-{task.partitionId():05d}-{number:05d}.pcd", task.taskAttemptId())
            number += 1
        return WriterCommitMessage()

    def _write(self, fields: list[str], points: np.ndarray, file: str, attempt: int) -> None:
        name, n = os.path.join(self.path, file), len(points)
        lines = ["VERSION 0.7", f"FIELDS {' '.join(fields)}", f"SIZE {' '.join(['4'] * len(fields))}", f"TYPE {' '.join(['F'] * len(fields))}", f"COUNT {' '.join(['1'] * len(fields))}", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {self.data}"]
        data = points.tobytes()
        if self.data == "binary_compressed":
            packed = compressed(points.T.tobytes())
            data = struct.pack("<II", len(packed), len(data)) + packed
        with open(f"{name}.{attempt}", "wb") as f:
            f.write(("\n".join(lines) + "\n").encode() + data)
        os.replace(f"{name}.{attempt}", name)  # a task that runs again replaces its files


class PcdSource(DataSource):
    """Columns of the schema are taken by name; ``point_id`` is the point's number. The option
    ``data`` of a write is binary (default) or binary_compressed."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return "point_id long, x float, y float, z float"

    def reader(self, schema) -> PcdReader:
        return PcdReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> PcdWriter:
        return PcdWriter(self.options["path"], schema.names, overwrite, self.options.get("data", "binary"))
