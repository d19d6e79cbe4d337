"""SimHash near-duplicates, found through Golay codes of fingerprint segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import as_bytes, dropped, small, staged
from cairnfield.llm.components import components

WORDS, SEED, BITS, MOST = 4, 42, 64, 4
#: Bits of the three segments: low, middle, high.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the binary Golay code of length 23 (fixed by the code).
GOLAY = 0xC75
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
HASHED = 1 << 16
PIECE = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Fingerprints that share a key are compared with each other up to this number; beyond it
#: they go by way of their neighbours within two bits, which needs no comparison.
CROWD = 2048
#: One in so many fingerprints is counted by its keys, to know crowded keys before rows are
#: dealt. Which keys are known that way decides where a crowd is told apart, not what is linked.
COUNTED = 64


def fingerprint(raw: bytes, piece: int = PIECE) -> int:
    """The SimHash of a text's word shingles; bit 1 if set in over half of their hashes. A very
    long text is read in pieces, each with the words before it that its shingles need."""
    text, at, n, tail = raw.translate(LOWER), 0, 0, []
    set_bits = np.zeros(BITS, np.int64)
    while at < len(text):
        end = len(text) if at + piece >= len(text) else SPACE.search(text, at + piece)
        end = end if isinstance(end, int) else end.start() if end else len(text)
        words = tail + text[at:end].split()
        at = end
        if len(words) >= WORDS or (at >= len(text) and words and not n):
            n += _add_bits(words, set_bits)
            words = words[1 - WORDS :]
        tail = words
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def _add_bits(words: list[bytes], set_bits: np.ndarray) -> int:
    """Adds the bits of all shingles' hashes; returns the number of shingles."""
    n = max(1, len(words) - WORDS + 1)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, HASHED):
        hashes = [digest(text[b:e], SEED) for b, e in zip(begins[k : k + HASHED], ends[k : k + HASHED], strict=True)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return n


def _fingerprinted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = np.array([fingerprint(raw) for raw in as_bytes(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(found.view(np.int64))], names=["doc_id", "content", "print"])


def golay_table() -> np.ndarray:
    """For each 23-bit word the 12 data bits of the nearest codeword."""

    def syndromes(words: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            words = words ^ np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
        return words

    leader = np.zeros(1 << 11, np.int64)  # the error pattern of three bits or fewer
    errors = np.array([0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i)), *(1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j))])
    leader[syndromes(errors)] = errors
    table = np.empty(1 << 23, np.int16)
    for k in range(0, 1 << 23, 1 << 18):
        words = np.arange(k, k + (1 << 18))
        table[k : k + (1 << 18)] = (words ^ leader[syndromes(words)]) >> 11
    return table


def _nearby(table: np.ndarray, segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Data bits of the codewords near ``segment``, as it is and with any one bit flipped, in
    a row each; and which of them aren't repeats. Two segments that differ in at most two
    bits share one: that of a word within a bit of both."""
    flips = np.concatenate(([0], 1 << np.arange(bits)))
    found = np.sort(table[segment[:, None] ^ flips], axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    most = int(first.sum(axis=1).max(initial=1))
    order = np.argsort(~first, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(found, order, 1).astype(np.int64), np.take_along_axis(first, order, 1)


def keys(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the row of each; two within four bits share a key.

    Of four errors over three segments, either one segment has none, and then another has
    at most two: keys of one segment as it is and a near codeword of another. Or each has
    one or two: keys of near codewords of all three.
    """
    parts, at = [], 0
    for bits in SEGMENTS:
        parts.append((prints >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1))
        at += bits
    near = [_nearby(table, p, bits) for p, bits in zip(parts, SEGMENTS, strict=True)]
    out, rows = [], []
    pairs = [(i, j) for i in range(3) for j in range(3) if i != j]
    for tag, (i, j) in enumerate(pairs, 1):
        row, k = np.nonzero(near[j][1])
        out.append(tag << 36 | parts[i][row] << 12 | near[j][0][row, k])
        rows.append(row)
    a, b, c = (x[1] for x in near)
    row, i, j, k = np.nonzero(a[:, :, None, None] & b[:, None, :, None] & c[:, None, None, :])
    out.append(near[0][0][row, i] << 24 | near[1][0][row, j] << 12 | near[2][0][row, k])
    rows.append(row)
    return np.concatenate(out), np.concatenate(rows)


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = golay_table()
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        for k in range(0, len(prints), 1024):
            some = prints[k : k + 1024]
            found, row = keys(some, table)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(some[row].view(np.int64))], names=["key", "print"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Keys and fingerprints with all rows of a key together. A key of very many rows comes
    in several turns of its own, which the flag says."""
    key, prints, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), False
    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        prints = np.concatenate((prints, batch.column(1).to_numpy().view(np.uint64)))
        if not len(key):
            continue
        if crowded and (cut := int(np.searchsorted(key, key[0], "right"))) < len(key):
            yield key[:cut], prints[:cut], True
            key, prints, crowded = key[cut:], prints[cut:], False
        if key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            yield key[:cut], prints[:cut], False
            key, prints = key[cut:], prints[cut:]
        if len(key) > 4 * CROWD:
            yield key, prints, True
            # one row stays, so that the next ones are known to be of the same key
            key, prints, crowded = key[:1], prints[:1], True
    if len(key):
        yield key, prints, crowded


def linked(key: np.ndarray, prints: np.ndarray, crowded: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges among fingerprints of equal keys that differ in at most MOST bits: enough to
    connect what is connected. A crowd's fingerprints get an edge to themselves instead."""
    if crowded:
        return [prints], [prints]
    edge = np.flatnonzero(np.diff(key)) + 1
    begin = np.concatenate(([0], edge))
    size = np.diff(np.concatenate((begin, [len(key)])))
    left, right = [], []
    few = np.repeat(size, size) <= 16
    for d in range(1, 16):
        at = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
        if not len(at):
            break
        at = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= MOST]
        left.append(prints[at])
        right.append(prints[at + d])
    for b, n in zip(begin[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        run = np.unique(prints[b : b + n])
        if n > CROWD:
            left.append(run)
            right.append(run)
            continue
        while len(run) > 1:  # spread from the first one through what is left
            frontier, run = run[:1], run[1:]
            while len(frontier) and len(run):
                seed, frontier = frontier[0], frontier[1:]
                near = np.bitwise_count(run ^ seed) <= MOST
                if near.any():
                    left.append(np.full(int(near.sum()), seed))
                    right.append(run[near])
                    frontier = np.concatenate((frontier, run[near]))
                    run = run[~near]
    return left, right


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        left, right = linked(*run)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64))], names=["a", "b"])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with all words within two bits of it."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    masks = np.concatenate(([np.uint64(0)], one, [one[i] | one[j] for i in range(BITS) for j in range(i)])).astype(np.uint64)
    for batch in batches:
        for x in batch.column(0).to_numpy().view(np.uint64):
            yield pa.RecordBatch.from_arrays([pa.array((masks ^ x).view(np.int64)), pa.array(np.full(len(masks), x).view(np.int64))], names=["word", "print"])


def _crowded(prints: DataFrame) -> DataFrame:
    """``hot``: keys that probably have well over CROWD fingerprints, by those of a share of
    ``prints``, reduced by the tasks before they are shuffled."""
    counted = prints.where(F.pmod(F.xxhash64("print"), F.lit(COUNTED)) == 0).mapInArrow(_keyed, "key long, print long")
    often = counted.groupBy(F.col("key").alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * CROWD / COUNTED)
    return staged(often.select("hot"), "hot-keys")


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a long, b long`` that connect all fingerprints within MOST bits.

    ``prints`` has distinct fingerprints (print long). They are dealt by their keys; those
    of one key are compared in place, and what they emit is no more than a spanning forest
    once a key has more than 16. If a key has over CROWD fingerprints, all of these
    meet at the words within two bits of them: two are within four bits exactly if they
    share such a word. Each word's smallest fingerprint is linked to its others, so the
    rows grow with the crowd's size only and no link is lost. Keys with very many
    fingerprints are found by ``_crowded`` and their rows aren't dealt by key at all, so that
    they don't pass through one task; what that misses is seen where the rows arrive.
    """
    keyed, hot = prints.mapInArrow(_keyed, "key long, print long"), _crowded(prints)
    known = not hot.isEmpty()
    dealt = keyed.join(hot, F.col("key") == F.col("hot"), "left_anti") if known else keyed
    found = staged(dealt.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_compared, "a long, b long").distinct(), "edges")
    crowd = found.where(F.col("a") == F.col("b")).select(F.col("a").alias("print"))
    if known:
        crowd = crowd.union(keyed.join(hot, F.col("key") == F.col("hot"), "left_semi").select("print")).distinct()
    near = staged(crowd, "crowd")
    dropped(hot)
    edges = found.where(F.col("a") != F.col("b"))
    if near.isEmpty():
        dropped(near)
        return edges
    words = near.repartition("print").mapInArrow(_neighbours, "word long, print long")
    least = staged(words.groupBy("word").agg(F.min("print").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "words")
    met = words.join(least, "word").where(F.col("print") != F.col("least")).select(F.col("least").alias("a"), F.col("print").alias("b"))
    out = staged(edges.union(met.distinct()), "all-edges")
    dropped(found, near, least)
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, print long, component_id`` for each row of ``documents`` (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased; shingles are four words
    joined by a space (fewer: all of them; none: fingerprint zero), hashed by XXH64. Texts
    whose fingerprints differ in at most four bits are linked; component_id is the smallest
    doc_id that can be reached by links, the row's own included.

    Texts with one fingerprint are one node, whose smallest doc_id is taken before rows are
    shuffled. Links and components stay distributed.

    Defined cases: null text has no words; empty texts form one component; a null doc_id
    takes part, but is never a component's number (null if a component has no other);
    repeated rows are rows of one component; very long texts are read in pieces and count
    whole; an empty table gives no rows; further columns are ignored.
    """
    return _grouped(documents).select("doc_id", "print", F.col("first.doc_id").alias("component_id"))


def _grouped(documents: DataFrame) -> DataFrame:
    """``doc_id, print, own, first``: own stands for the row, first for its component's
    first row: a struct that sorts rows by doc_id, those without one last, by their text."""
    prints = documents.select("doc_id", "text", own_row()).select("doc_id", "text", "own.content").mapInArrow(_fingerprinted, "doc_id long, content string, print long")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content").alias("own")
    found = staged(prints.select("doc_id", "print", own), "prints")
    nodes = staged(found.groupBy("print").agg(F.min("own").alias("first")), "nodes")
    edges = links(nodes.select("print"))
    groups = components(edges)
    rooted = staged(nodes.join(groups, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root")), "rooted")
    firsts = staged(rooted.groupBy(F.col("root").alias("group")).agg(F.min("first").alias("first")), "firsts")
    by_print = staged(rooted.drop("first").join(firsts, F.col("root") == F.col("group")).select(F.col("print").alias("node"), "first"), "by-print")
    dropped(nodes, edges, groups, rooted, firsts)
    return found.join(by_print, F.col("print") == F.col("node"), "left").select("doc_id", "print", "own", "first")


def own_row() -> Column:
    """A row's name ``own``: its doc_id with its text's hash; rows without a doc_id sort last."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"), content.alias("content")).alias("own")


def one_of_each(documents: DataFrame, grouped: Callable[[DataFrame], DataFrame] = _grouped) -> DataFrame:
    """One row of each component of ``grouped``, with the same columns: that with the
    smallest doc_id, among equal ones or if none has a doc_id the one whose text's hash
    sorts first. Rows with one doc_id and different texts are different rows; repeated rows
    of one that stays are reduced to one."""
    kept = grouped(documents).where(F.col("own") == F.col("first"))
    ids = staged(kept.select(_name("own").alias("own_name_")).distinct(), "kept")
    named = documents.withColumn("own_name_", _name(own_row()))
    return named.join(ids, "own_name_", "left_semi").dropDuplicates(["own_name_"]).select(*documents.columns)


def _name(own: str | Column) -> Column:
    own = F.col(own) if isinstance(own, str) else own
    return F.concat(F.coalesce(own["doc_id"].cast("string"), F.lit("text")), F.lit(" "), own["content"])
