"""Removal of repeated strings through Burrows-Wheeler transforms of bounded blocks.

A string of a unit's ``length`` symbols has one anchor: the place of the smallest hash among
its grams. Equal strings have equal anchors, so only texts around anchors that occur twice
need to be compared, and each string is looked at with exactly one anchor. Symbols are bytes,
or words, which are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import as_bytes, dropped, small, staged, word_hashes

LENGTH, GRAM = 400, 64
PASSAGE, PASSAGE_GRAM = 51, 8
PRIME = 0x9E3779B97F4A7C15
#: Symbols that are hashed at once, and bits of a place among them.
PIECE, PLACE_BITS = 1 << 20, 21
#: Different surroundings of an anchor that are compared in one block; beyond it they go
#: by way of counts of their strings.
CROWD = 256
#: Symbols of a block.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What strings are made of: ``dtype`` holds a symbol."""

    length: int
    gram: int
    dtype: type

    @property
    def size(self) -> int:
        return np.dtype(self.dtype).itemsize

    def symbols(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8) if self.size == 1 else word_hashes(text)


def _mixed(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams, whose size is a power of two, by doubling."""
    h, k, power = symbols.astype(np.uint64) + np.uint64(1), 1, PRIME
    while k < gram:
        h = h[:-k] * np.uint64(power) + h[k:]
        power = power * power % (1 << 64)
        k *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(symbols: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the string at each place of ``symbols``, and the grams' hashes."""
    h = _mixed(symbols, unit.gram)
    if len(h) > 1 << PLACE_BITS:
        raise ValueError(f"{len(h)} places don't fit into {PLACE_BITS} bits")
    bits = np.uint64(PLACE_BITS)
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    window, k = unit.length - unit.gram + 1, 1
    while 2 * k <= window:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if window > k:
        low = np.minimum(low[: len(low) - (window - k)], low[window - k :])
    return (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), h


def _pieces(texts: Iterable[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Symbols to hash at once, at most as many as PLACE_BITS can number; and for each part
    its text, its place there, its place in the symbols and its number of symbols. Parts of
    one text overlap by ``length`` - 1."""
    held, parts, n = [], [], 0
    for k, text in enumerate(texts):
        for i in range(0, max(0, len(text) - length + 1), PIECE):
            some = text[i : i + PIECE + length - 1]
            if held and n + len(some) > 1 << PLACE_BITS:
                yield np.concatenate(held), parts
                held, parts, n = [], [], 0
            parts.append((k, i, n, len(some)))
            held.append(some)
            n += len(some)
            if n >= PIECE:
                yield np.concatenate(held), parts
                held, parts, n = [], [], 0
    if held:
        yield np.concatenate(held), parts


def _follows(symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Whether the surroundings of each anchor are those of the anchor before it, symbol by
    symbol. Strings [lo, hi) of neighbouring anchors adjoin, so in a run of such anchors the
    symbols have the period hi - lo."""
    out, size = np.zeros(len(lo), bool), hi - lo
    alike = (np.diff(gram) == 0) & (np.diff(size) == 0) & (np.diff(offset) == 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], alike.view(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        period, run = int(size[a]), symbols[lo[a] : hi[b] + length - 1]
        differ = np.concatenate(([0], np.cumsum(run[:-period] != run[period:])))
        at = lo[a:b] - lo[a]
        out[a + 1 : b + 1] = differ[at + period + length - 1] == differ[at]
    return out


def _anchored(units: list[Unit]) -> Callable:
    """A row for each anchor: its unit's number, the hashes of its gram and of its surroundings,
    which are the symbols of all strings that it is the anchor of, and where those begin. Of
    bytes, neighbouring anchors with equal surroundings are one row, which repeats."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in small(batches):
            texts = as_bytes(batch.column("text"))
            content = batch.column("content").to_numpy()
            for number, unit in enumerate(units):
                for symbols, parts in _pieces(map(unit.symbols, texts), unit.length):
                    place, h = anchors(symbols, unit)
                    view, size = memoryview(symbols).cast("B"), unit.size
                    who, begin, count, gram, around, anchor, repeat = [], [], [], [], [], [], []
                    for k, at, offset, n in parts:
                        own = place[offset : offset + n - unit.length + 1]
                        edge = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)]))
                        lo, hi = edge[:-1], edge[1:]
                        if size == 1:  # a document owns its words once, however often it repeats them
                            first = np.flatnonzero(~_follows(symbols[offset : offset + n], lo, hi, h[own[lo]], own[lo] - lo, unit.length))
                        else:
                            first = np.arange(len(lo))
                        repeat.append(np.diff(np.append(first, len(lo))))
                        lo, hi = lo[first], hi[first]
                        who.append(np.full(len(lo), k))
                        begin.append(lo + at)
                        count.append(hi - lo)
                        gram.append(h[own[lo]])
                        anchor.append(own[lo] - lo - offset)
                        around += [digest(view[a:b]) for a, b in zip(((lo + offset) * size).tolist(), ((hi + offset + unit.length - 1) * size).tolist(), strict=True)]
                    who = np.concatenate(who)
                    arrays = [np.concatenate(gram).view(np.int64), np.array(around, np.uint64).view(np.int64), content[who], *map(np.concatenate, (begin, count, anchor, repeat))]
                    marked = pa.array(np.full(len(who), number, np.int32))
                    yield pa.RecordBatch.from_arrays([marked, *map(pa.array, arrays[:2]), batch.column("doc_id").take(pa.array(who)), *map(pa.array, arrays[2:])], names=["unit", "gram", "around", "doc_id", "content", "begin", "strings", "anchor", "repeat"])

    return run


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` in the order of their first ``depth`` symbols, by doubling from
    as many symbols as fit into a whole number."""
    n, rank, k = len(codes), codes.astype(np.int64) + 1, 1
    base = int(rank.max()) + 1
    while base ** (2 * k) < 1 << 62 and k < depth:
        longer = rank * base**k
        longer[: n - k] += rank[k:]
        rank, k = longer, 2 * k
    key = rank
    while True:
        order = np.argsort(key)
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if k >= depth or fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        key = rank * (int(fresh[-1]) + 2)
        key[: n - k] += rank[k:] + 1
        k *= 2


class Ranks:
    """A wavelet matrix: ranks of all symbols of a sequence, for many intervals at once."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.zeros: list[np.ndarray] = []
        self.bits = max(1, (symbols - 1).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            ones = codes >> bit & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - ones))).astype(np.int32))
            codes = np.concatenate((codes[ones == 0], codes[ones == 1]))

    def within(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol in each interval [lo, hi): the interval's number, the symbol, and
        how often it occurs before lo and before hi."""
        which, symbol = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        start = np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            total = zeros[-1]
            a, b, s = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64), zeros[start].astype(np.int64)
            left, right = b > a, hi - lo > b - a
            which = np.concatenate((which[left], which[right]))
            symbol = np.concatenate((symbol[left] * 2, symbol[right] * 2 + 1))
            lo, hi, start = (
                np.concatenate((a[left], (lo - a + total)[right])),
                np.concatenate((b[left], (hi - b + total)[right])),
                np.concatenate((s[left], (start - s + total)[right])),
            )
        return which, symbol, lo - start, hi - start


def repeated(codes: np.ndarray, symbols: int, length: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Whether the string of ``length`` symbols at each place of ``codes`` has two owners: the
    smallest and largest owner at each place are ``low`` and ``high``; if they aren't given,
    each place owns itself. The last symbol is 0, the only one; strings that reach it are
    never marked.

    Intervals of suffixes with a common prefix are extended backwards by one symbol in
    breadth-first order, on the Burrows-Wheeler transform. The interval of a prefix of p + 1
    symbols ends where neighbouring suffixes share p, unless a shorter prefix ended there
    before; only then is it extended further, so there are at most as many as suffixes. After
    ``length`` rounds, boundaries without an end have common prefixes of that or more.
    """
    n = len(codes)
    order = suffix_order(codes, length)
    transform = codes[order - 1]
    ranks = Ranks(transform, symbols)
    first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=symbols))))
    ended = np.zeros(n + 1, bool)
    ended[0] = ended[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(length):
        _, symbol, before, upto = ranks.within(lo, hi)
        lo, hi = first[symbol] + before, first[symbol] + upto
        new = ~ended[hi]
        ended[hi[new]] = True
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
    begin = np.flatnonzero(ended[:n])
    least, most = (np.arange(n) if x is None else x for x in (low, high))
    several = np.minimum.reduceat(least[order], begin) != np.maximum.reduceat(most[order], begin)
    out = np.empty(n, bool)
    out[order] = np.repeat(several, np.diff(np.append(begin, n)))
    out[-length:] = False
    return out


#: The columns of surroundings: those of ``kinds`` and the symbols as bytes.
AROUND = "unit int, gram long, around long, kinds long, anchor long, low long, high long, n long, raw binary"
_NAMES = [x.split()[0] for x in AROUND.split(", ")]


def _surroundings(units: list[Unit]) -> Callable:
    """A row with the symbols of each wanted anchor's surroundings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for k, text in enumerate(as_bytes(batch.column("text"))):
                wanted, known = batch.column("wanted")[k].as_py(), {}
                for i in range(0, len(wanted), 4096):
                    some, raw = wanted[i : i + 4096], []
                    for w in some:
                        unit = units[w["unit"]]
                        if w["unit"] not in known:
                            known[w["unit"]] = unit.symbols(text)
                        raw.append(known[w["unit"]][w["begin"] : w["begin"] + w["strings"] + unit.length - 1].tobytes())
                    columns = [pa.array([w[c] for w in some], pa.int32() if c == "unit" else pa.int64()) for c in _NAMES[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], names=_NAMES)

    return run


def _marked(units: list[Unit]) -> Callable:
    """Ranges of repeated strings in each surroundings; rows come sorted by unit and gram. Of
    surroundings only the stretch of their wanted strings takes part."""

    def block(unit: Unit, rows: list[dict]) -> pa.RecordBatch:
        # 0 ends the block and 1 each surroundings; strings of interest hold neither
        joined = np.frombuffer(b"".join(r["raw"] for r in rows), unit.dtype)
        if unit.size == 1:
            used = np.zeros(256, np.int64)
            used[joined] = 1
            dense = (np.cumsum(used) + 1)[joined]
        else:
            dense = np.unique(joined, return_inverse=True)[1] + 2
        sizes = np.array([len(r["raw"]) // unit.size for r in rows])
        codes = np.ones(len(joined) + len(rows), np.int64)
        inside = np.ones(len(codes), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        codes[inside] = dense
        codes[-1] = 0
        if unit.size == 1:  # a place owns itself, and another one if its surroundings occur twice
            low = np.arange(len(codes))
            high = low + np.repeat([r["n"] > 1 for r in rows], sizes + 1)
        else:
            low, high = (np.repeat(np.array([r[c] for r in rows], np.int64), sizes + 1) for c in ("low", "high"))
        marks = repeated(codes, int(dense.max()) + 1, unit.length, low, high)
        out, at = [], 0
        for r, size in zip(rows, sizes.tolist(), strict=True):
            own = marks[at : at + size - unit.length + 1]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            out += [(r["unit"], r["gram"], r["around"], a + r["from"], b + r["from"]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            at += size + 1
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["unit", "gram", "around", "first", "upto"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, last = [], 0, None
        for batch in batches:
            for r in batch.select(["unit", "gram", "around", "low", "high", "n", "raw", "wanted"]).to_pylist():
                if (r["unit"], r["gram"], r["around"]) == last:
                    continue
                unit = units[r["unit"]]
                r["from"] = min(w["first"] for w in r["wanted"])
                upto = max(w["upto"] for w in r.pop("wanted")) + unit.length - 1
                r["raw"] = r["raw"][r["from"] * unit.size : upto * unit.size]
                if rows and (r["unit"] != last[0] or n >= BLOCK and r["gram"] != last[1]):
                    yield block(units[last[0]], rows)
                    rows, n = [], 0
                rows.append(r)
                last = r["unit"], r["gram"], r["around"]
                n += len(r["raw"]) // units[last[0]].size
        if rows:
            yield block(units[last[0]], rows)

    return run


def _slices(units: list[Unit]) -> Callable:
    """Each surroundings' strings in slices by their distance from the anchor; with the hashes
    of the symbols that all strings of a slice share, and of all its symbols and their
    distance. Strings of different surroundings can only be equal if their slices' shared
    symbols are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for number, gram, around, anchor, raw in zip(*(batch.column(c).to_pylist() for c in ("unit", "gram", "around", "anchor", "raw")), strict=True):
                unit = units[number]
                length, size, width = unit.length, unit.size, max(1, (unit.length - unit.gram + 1) // 8)
                n = len(raw) // size - length + 1
                for k in range(max(0, anchor - n + 1) // width, anchor // width + 1):
                    last = anchor - k * width
                    first, upto = max(0, last - width + 1), min(n, last + 1)
                    core = digest(raw[last * size : (last - width + 1 + length) * size])
                    full = digest(raw[first * size : (upto - 1 + length) * size], anchor - first)
                    out.append((number, gram, around, k, core - (1 << 63), full - (1 << 63), first, upto))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["unit", "gram", "around", "slice", "core", "full", "first", "upto"])

    return run


def _strings(units: list[Unit]) -> Callable:
    """A row for each string of the wanted slices of surroundings: its hash and its place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for number, gram, around, raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("unit", "gram", "around", "raw", "wanted")), strict=True):
                size, wide, view = units[number].size, units[number].length * units[number].size, memoryview(raw)
                places = [(i, w) for w in wanted for i in range(w["first"], w["upto"])]
                hashes = np.array([digest(view[i * size : i * size + wide]) for i, _ in places], np.uint64).view(np.int64)
                columns = [np.full(len(places), x) for x in (gram, around)] + [np.array([w[c] for _, w in places], np.int64) for c in ("low", "high", "n")]
                columns += [hashes, np.array([i for i, _ in places], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), number, np.int32)), *map(pa.array, columns)], names=["unit", "gram", "around", "low", "high", "n", "string", "first"])

    return run


KEY = ["unit", "gram", "around"]


def _twice(n: Column, low: Column, high: Column) -> Column:
    """Whether strings have two owners. Every place owns bytes; a document owns its words."""
    return F.when(F.col("unit") == 0, n > 1).otherwise(low != high)


def _owners() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]


def _wanted(around: DataFrame, units: list[Unit]) -> DataFrame:
    """``unit, gram, around, slice, full, first, upto``: the slices of surroundings that share
    symbols with others. No other string of surroundings with one owner can be repeated."""
    slices = staged(around.mapInArrow(_slices(units), "unit int, gram long, around long, slice long, core long, full long, first long, upto long"), "slices")
    key = ["unit", "gram", "slice", "core"]
    shared = staged(slices.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "cores")
    out = staged(slices.join(shared, key, "left_semi").drop("core"), "wanted")
    dropped(slices, shared)
    return out


def _counted(crowd: DataFrame, wanted: DataFrame, units: list[Unit]) -> DataFrame:
    """Ranges ``unit, gram, around, first, upto`` of repeated strings in many surroundings of one
    gram: slices that occur twice in whole; and of the others, and one of each of those, the
    strings that do. Rows grow with the number of surroundings only."""
    slices = staged(wanted.join(crowd.select(*KEY, "low", "high", "n"), KEY), "crowd")
    key = ["unit", "gram", "slice", "full"]
    kinds = slices.groupBy(*key).agg(*_owners(), F.min("around").alias("one"))
    kinds = staged(kinds.withColumn("twice", _twice(F.col("n"), F.col("low"), F.col("high"))), "full")
    known = staged(slices.drop("low", "high", "n").join(kinds, key), "known")
    some = known.where(~F.col("twice") | (F.col("around") == F.col("one")))
    listed = some.groupBy(*KEY).agg(F.collect_list(F.struct("first", "upto", "low", "high", "n")).alias("wanted"))
    rows = crowd.select(*KEY, "raw").join(listed, KEY)
    strings = staged(rows.mapInArrow(_strings(units), "unit int, gram long, around long, low long, high long, n long, string long, first long"), "strings")
    held = strings.groupBy("unit", "gram", "string").agg(*_owners())
    twice = staged(held.where(_twice(F.col("n"), F.col("low"), F.col("high"))).select("unit", "gram", "string"), "twice")
    single = strings.join(twice, ["unit", "gram", "string"], "left_semi").select(*KEY, "first", (F.col("first") + 1).alias("upto"))
    out = staged(known.where("twice").select(*KEY, "first", "upto").union(single), "counted")
    dropped(slices, kinds, known, strings, twice)
    return out


def _merged(first: np.ndarray, upto: np.ndarray, length: int) -> list[list[int]]:
    """Maximal runs of the symbols of strings that begin in the ranges [first, upto)."""
    order = np.argsort(first)
    lo, hi = first[order], np.maximum.accumulate(upto[order] + length - 1)
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(lo)), bool), lo[1:] > hi[:-1])))
    end = np.append(begin[1:], len(lo))[: len(begin)] - 1
    return np.stack((lo[begin], hi[end]), axis=1).tolist()


def _cut(units: list[Unit], names: list[str]) -> Callable:
    spans = pa.list_(pa.list_(pa.int64()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            kept, sizes, found = [], [], []
            ranges = batch.column("ranges")
            unit, first, upto = (ranges.flatten().field(c).to_numpy() for c in ("unit", "first", "upto"))
            edge = np.concatenate(([0], np.cumsum(ranges.value_lengths().fill_null(0).to_numpy())))
            for text, a, b in zip(as_bytes(batch.column("text")), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                owns = [unit[a:b] == u for u in range(len(units))]
                found.append([_merged(first[a:b][own], upto[a:b][own], u.length) for own, u in zip(owns, units, strict=True)] if b > a else [[] for _ in units])
                edges = [0, *(x for span in found[-1][0] for x in span), len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array([f[0] for f in found], spans), pa.array([f[1] if len(units) > 1 else [] for f in found], spans), pa.array(kept, pa.binary())],
                names=[*names, "n_bytes", "spans", "passages", "kept"],
            )

    return run


def repeated_ranges(texts: DataFrame, units: list[Unit]) -> DataFrame:
    """``doc_id, content, ranges`` of texts (doc_id, content, text) that have a repeated
    string: ranges (unit, first, upto) of the places where such strings begin."""
    found = staged(
        texts.select("doc_id", "content", "text").mapInArrow(_anchored(units), "unit int, gram long, around long, doc_id long, content long, begin long, strings long, anchor long, repeat long"),
        "anchors",
    )
    again = found.groupBy(F.col("unit").alias("own_unit"), F.col("gram").alias("shared")).agg(F.sum("repeat").alias("n")).where("n > 1").drop("n")
    again = staged(again, "again")
    found, every = staged(found.join(again, (F.col("gram") == F.col("shared")) & (F.col("unit") == F.col("own_unit")), "left_semi"), "met"), found
    dropped(every, again)
    place, owner = F.struct("doc_id", "content", "begin", "strings", "anchor"), F.when(F.col("unit") == 1, F.xxhash64("doc_id", "content")).otherwise(F.lit(0).cast("long"))
    kinds = staged(found.groupBy(*KEY).agg(F.sum("repeat").alias("n"), F.min(owner).alias("low"), F.max(owner).alias("high"), F.min(place).alias("place")), "kinds")
    twice = _twice(F.col("n"), F.col("low"), F.col("high"))
    many = staged(kinds.groupBy(F.col("unit").alias("own_unit"), F.col("gram").alias("shared")).agg(F.count("*").alias("kinds")).where("kinds > 1"), "shared")
    n_strings = F.col("place.strings")
    whole = kinds.where(twice).select(*KEY, F.lit(0).cast("long").alias("first"), n_strings.alias("upto"))
    wanted = (
        kinds.join(many, (F.col("gram") == F.col("shared")) & (F.col("unit") == F.col("own_unit")))
        .groupBy(F.col("place.doc_id").alias("place_id"), F.col("place.content").alias("place_content"))
        .agg(F.collect_list(F.struct(*KEY, "kinds", "n", "low", "high", *(F.col(f"place.{c}").alias(c) for c in ("begin", "strings", "anchor")))).alias("wanted"))
    )
    own = F.col("doc_id").eqNullSafe(F.col("place_id")) & (F.col("content") == F.col("place_content"))
    around = staged(texts.join(wanted, own).select("text", "wanted").mapInArrow(_surroundings(units), AROUND), "surroundings")
    wanted = _wanted(around, units)
    few, crowd = around.where(F.col("kinds") <= CROWD), around.where(F.col("kinds") > CROWD).dropDuplicates(KEY)
    listed = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("first", "upto")).alias("wanted"))
    blocks = few.join(listed, KEY)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work, not bytes, sizes these
    mark = "unit int, gram long, around long, first long, upto long"
    marked = blocks.repartition(parts, "gram").sortWithinPartitions(*KEY).mapInArrow(_marked(units), mark)
    marks = staged(marked.unionByName(_counted(crowd, wanted, units)).unionByName(whole).withColumnsRenamed({c: f"mark_{c}" for c in KEY}), "marks")
    here = (F.col("gram") == F.col("mark_gram")) & (F.col("around") == F.col("mark_around")) & (F.col("unit") == F.col("mark_unit"))
    # where surroundings follow themselves, all of their strings are repeated
    upto = F.col("begin") + F.col("upto") + (F.col("repeat") - 1) * F.col("strings")
    ranges = (
        found.join(marks, here)
        .groupBy("doc_id", "content")
        .agg(F.collect_set(F.struct("unit", (F.col("begin") + F.col("first")).alias("first"), upto.alias("upto"))).alias("ranges"))
    )
    out = staged(ranges, "ranges")
    dropped(found, kinds, many, around, wanted, marks)
    return out


def remove_repeats(documents: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``doc_id, n_bytes long, spans array<array<long>>, passages array<array<long>>, kept
    binary`` for each row.

    A byte of a text goes if it is covered by a string of ``length`` bytes that also begins
    anywhere else, in the same text or another. ``spans`` are the maximal runs [from, to)
    that go, ``kept`` the other bytes. Strings are judged on the input: all copies go.
    ``passages`` are the maximal runs of words (without ASCII white space, as they are) that
    are covered by strings of ``words`` words that also occur in another document, however
    many bytes these have; nothing is cut for them. It is empty if ``words`` isn't given.

    A stretch with a short period has an anchor in each period; those with equal surroundings
    are one row. Anchors whose gram occurs once go first. Of the others, those with equal surroundings are
    counted before rows are shuffled; surroundings that occur twice hold repeated strings only. Of different surroundings of
    one gram, one representative of each with its count goes on, if it shares a slice's
    symbols with others. At most CROWD of a gram lie in one block, whose repeats come from the interval expansion
    in ``repeated``. If a gram has more, their slices and the strings of these are counted:
    this is exact too and gathers nothing. No task holds more than a text, a batch or a block.

    Defined cases: null text is empty; texts shorter than ``length`` lose nothing; very long
    texts are hashed in overlapping parts, which gives the same anchors; an empty table gives
    no rows; a null doc_id is a value like others; rows with one doc_id and text are copies
    of each other, but one document for ``passages``; further columns are ignored.
    """
    units = [Unit(length, min(GRAM, 1 << (length.bit_length() - 1)), np.uint8)]
    if words is not None:
        units.append(Unit(words, min(PASSAGE_GRAM, 1 << (words.bit_length() - 1)), np.uint64))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    ranges = repeated_ranges(texts, units).withColumnsRenamed({"doc_id": "range_id", "content": "range_content"})
    own = F.col("doc_id").eqNullSafe(F.col("range_id")) & (F.col("content") == F.col("range_content"))
    spans = "array<array<bigint>>"
    return texts.join(ranges, own, "left").select("doc_id", "text", "ranges").mapInArrow(_cut(units, ["doc_id"]), f"doc_id long, n_bytes long, spans {spans}, passages {spans}, kept binary")
