"""Shared helpers: tables and Arrow columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.storage import dropped, new_path, shared_dir, staged

__all__ = ["as_bytes", "distinct", "dropped", "hash_below", "held_out", "new_path", "powers", "shared_dir", "small", "staged", "table", "word_hashes"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a Python task works on at once.
SOME_BYTES = 1 << 22


def small(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SOME_BYTES of a text column, or of one longer text, so
    that what a task holds besides its input doesn't depend on the size of batches."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        part = np.cumsum(sizes) // SOME_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in pairwise(edges):
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Odd, and its inverse modulo 2^64: a word's hash is a difference of running sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
HASHED = 1 << 20


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2^64; a worker remembers up to HASHED of a base."""
    if len(held := _POWERS.get(base, ())) < n:
        held = np.full(max(n, HASHED), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= HASHED:
            _POWERS[base] = held
    return held[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes without ASCII white space, in order."""
    out, at = [], 0
    while at < len(text):
        end = _word_end(text, at + HASHED)
        out.append(_hashed(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _word_end(text: bytes, at: int) -> int:
    """The first place from ``at`` on that is white space, or the end."""
    while at < len(text) and text[at] not in b" \t\n\v\f\r":
        at += 1
    return min(at, len(text))


def _hashed(raw: np.ndarray) -> np.ndarray:
    blank = np.concatenate(([True], (raw == 0x20) | (raw >= 0x09) & (raw <= 0x0D), [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, len(raw)), dtype=np.uint64)))
    h = (sums[end] - sums[start]) * powers(BASE, len(raw))[start]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def hash_below(key: Column, share: Column) -> Column:
    """True for about ``share`` of the keys, the same ones on every run."""
    return (F.xxhash64(key.cast("string")).bitwiseAND((1 << 40) - 1) / float(1 << 40)) < share


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def distinct(keep: Iterable[str], *new: str) -> list[str]:
    """The names ``keep``; ValueError if a new column has one of them."""
    names = list(keep)
    if clash := sorted({*names} & {*new}):
        raise ValueError(f"kept columns have names of new ones: {', '.join(clash)}")
    return names
