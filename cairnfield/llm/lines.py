"""Removal of repeated runs of lines by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import as_bytes, dropped, small, staged

#: Lines of the shortest run that is removed.
LEAST = 3
#: Sets windows of different numbers of lines apart.
APART = 0xD6E8FEB86659FD93


def selected(hashes: np.ndarray, size: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: of each window of ``size`` line hashes that begins in ``begin`` the smallest
    is selected, the last one among equals. Returns the selected positions, and of the
    windows that select it in a row the first and their number."""
    at, least = begin + size - 1, hashes[begin + size - 1].copy()
    for k in range(size - 2, -1, -1):
        other = hashes[begin + k]
        lower = other < least
        at[lower], least[lower] = begin[lower] + k, other[lower]
    edge = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(begin) != 1)))
    first = np.flatnonzero(edge)
    return at[first], begin[first], np.diff(np.append(first, len(begin)))


def long_windows(lines: list[bytes], size: int, words: int) -> np.ndarray:
    """Where windows of ``size`` lines with over ``words`` words begin."""
    n_words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    return np.flatnonzero(np.convolve(n_words, np.ones(size, np.int64), "valid") > words)


POSITIONS = "mark long, around long, lines array<bigint>, n_lines int, begin long, doc_id long, content long"


def _positions(least: int, words: int | None) -> Callable:
    """A row for each selected position: its mark (line hash), and the lines of the windows
    that select it, from ``begin`` on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in small(batches):
            who, mark, around, around_size, begin, n_lines = [], [], [], [], [], []
            for k, raw in enumerate(as_bytes(batch.column("text"))):
                lines = raw.split(b"\n")
                sizes = [] if words is None else range(1, min(least - 1, len(lines)) + 1)
                windows = [(size, long_windows(lines, size, words)) for size in sizes]
                if len(lines) >= least:
                    windows.append((least, np.arange(len(lines) - least + 1)))
                windows = [w for w in windows if len(w[1])]
                if not windows:
                    continue
                hashes = np.fromiter(map(digest, lines), np.uint64, len(lines))
                for size, starts in windows:
                    at, first, n = selected(hashes, size, starts)
                    mark.append(hashes[at] ^ np.uint64(size * APART % (1 << 64)))
                    who.append(np.full(len(at), k))
                    begin.append(first)
                    n_lines.append(np.full(len(at), size, np.int32))
                    wide = n + size - 1
                    around_size.append(wide)
                    around.append(hashes[np.repeat(first - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())])
            if who:
                chosen = pa.array(np.concatenate(who))
                offsets = np.concatenate(([0], np.cumsum(np.concatenate(around_size)))).astype(np.int32)
                flat = np.concatenate(around)
                view = memoryview(flat).cast("B")
                key = np.array([digest(view[8 * a : 8 * b]) for a, b in pairwise(offsets.tolist())], np.uint64)
                arrays = [pa.array(np.concatenate(mark).view(np.int64)), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))]
                arrays += [pa.array(np.concatenate(n_lines)), pa.array(np.concatenate(begin).astype(np.int64)), *(batch.column(c).take(chosen) for c in ("doc_id", "content"))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in POSITIONS.split(", ")])

    return run


def repeated_windows(texts: DataFrame, least: int = LEAST, words: int | None = None) -> DataFrame:
    """``doc_id, content, windows``: of texts (doc_id, content, text) those windows of lines
    that occur before, each with the place of its first occurrence.

    Only selected positions leave their text, about 2 / (``least`` + 1) of the lines; equal
    windows select equal positions, so no match is missed. Positions whose mark occurs twice
    are joined. A position isn't paired with all others of its mark: its match is extended to
    the left and right over the hashes of the lines around it, to each window that selects
    it, and meets the first place with those lines. So a line that is everywhere makes no
    more rows than it has places. Counts and first places are reduced before rows are shuffled.
    """
    found = staged(texts.select("doc_id", "content", "text").mapInArrow(_positions(least, words), POSITIONS), "positions")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content", "begin")
    kinds = staged(found.groupBy("mark", "around", "n_lines").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("lines").alias("lines")), "kinds")
    shared = staged(kinds.groupBy(F.col("mark").alias("shared")).agg(F.sum("n").alias("n")).where("n > 1").drop("n"), "shared")
    step = F.explode(F.sequence(F.lit(0), F.size("lines") - F.col("n_lines")))
    met = kinds.join(shared, F.col("mark") == F.col("shared"), "left_semi").select("*", step.alias("step"))
    shifted = F.struct(*(F.col(f"first.{c}").alias(c) for c in ("unnamed", "doc_id", "content")), (F.col("first.begin") + F.col("step")).alias("begin"))
    # by a hash of the mark: else its hot values would have to stay together
    met = met.select("mark", "around", "step", "n", F.xxhash64("mark").alias("mixed"), F.xxhash64(F.slice("lines", F.col("step") + 1, F.col("n_lines"))).alias("window"), shifted.alias("place"))
    met = staged(met, "met")
    firsts = staged(met.groupBy(F.col("mixed").alias("own"), F.col("window").alias("first_window")).agg(F.sum("n").alias("total"), F.min("place").alias("source")).where("total > 1").drop("total"), "firsts")
    extended_to = met.join(firsts, (F.col("mixed") == F.col("own")) & (F.col("window") == F.col("first_window")))
    matches = staged(
        extended_to.where((F.col("n") > 1) | (F.col("place") > F.col("source")))
        .groupBy(F.xxhash64("mark").alias("of"), F.col("around").alias("known"))
        .agg(F.collect_list(F.struct("step", "source")).alias("matches")),
        "matches",
    )
    each = found.join(matches, (F.xxhash64("mark") == F.col("of")) & (F.col("around") == F.col("known"))).select("doc_id", "content", "begin", "n_lines", F.explode("matches").alias("match"))
    each = each.select("doc_id", "content", (F.col("begin") + F.col("match.step")).alias("begin"), F.col("n_lines").cast("long").alias("n_lines"), F.col("match.source").alias("source")).where(place > F.col("source"))
    window = F.struct("begin", "n_lines", F.col("source.doc_id").alias("source_id"), F.col("source.content").alias("source_content"), F.col("source.begin").alias("source_begin"))
    out = staged(each.groupBy("doc_id", "content").agg(F.collect_set(window).alias("windows")), "later")
    dropped(found, kinds, shared, met, firsts, matches)
    return out


def extended(windows: list[dict]) -> list[dict]:
    """Runs: windows one line apart that match one source at one distance, joined both ways."""
    runs: list[dict] = []
    for w in sorted(windows, key=lambda w: (w["begin"], -w["n_lines"])):
        r = runs[-1] if runs else None
        if r and (w["source_id"], w["source_content"], w["source_begin"] - w["begin"]) == (r["source_id"], r["source_content"], r["source_begin"] - r["begin"]):
            beyond = w["begin"] + w["n_lines"] - r["begin"] - r["n_lines"]
            if beyond <= 0:
                continue
            if beyond == 1:
                r["n_lines"] += 1
                continue
        runs.append(dict(w))
    return runs


RUNS = "array<struct<begin:bigint,n_lines:bigint,source_id:bigint,source_begin:bigint>>"


def _kept(names: list[str]) -> Callable:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("begin", "n_lines", "source_id", "source_begin")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, sizes, all_runs = batch.column("text").to_pylist(), [], []
            for k, windows in enumerate(batch.column("windows").to_pylist()):
                lines = (texts[k] or "").split("\n")
                runs = extended(windows or [])
                if runs:
                    gone = bytearray(len(lines))
                    for r in runs:
                        gone[r["begin"] : r["begin"] + r["n_lines"]] = b"\1" * r["n_lines"]
                    texts[k] = "\n".join([x for x, g in zip(lines, gone, strict=True) if not g])
                sizes.append(len(lines))
                all_runs.append([{c: r[c] for c in ("begin", "n_lines", "source_id", "source_begin")} for r in runs])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(all_runs, kind)],
                names=[*names, "text", "n_lines", "runs"],
            )

    return run


def find(documents: DataFrame, least: int = LEAST, words: int | None = None) -> DataFrame:
    """``others, text, n_lines, runs`` for each row: the other columns as a struct, the text
    that is kept, the lines it had and the runs that went.

    A line goes if it lies in a run of ``least`` or more lines that occurs before: in a
    document with a smaller doc_id, or further up in its own. The first occurrence stays.
    With ``words``, shorter runs that have more words than that go by the same rule.
    Lines are compared as they are; all of a text's lines count, blank ones too. A run has
    its first line (from 0), its number of lines and where it was seen first; runs with
    different sources may overlap.

    Defined cases: an empty table gives no rows; null text stays null and has one empty line; a text that loses all lines
    becomes empty; texts with fewer lines than ``least`` stay as they are, but for runs of over ``words`` words; a document that
    repeats itself keeps its first copy, so a line that is repeated over and over stays once;
    rows without doc_id come after all others, by a hash of their text; rows with one
    doc_id and text are one document and are treated alike.
    """
    others = F.struct(*[F.col(c) for c in documents.columns if c != "text"]).alias("others")
    texts = documents.select("doc_id", "text", others).withColumn("content", F.xxhash64(F.coalesce("text", F.lit(""))))
    later = repeated_windows(texts, least, words).withColumnsRenamed({"doc_id": "later_id", "content": "later_content"})
    own = F.col("doc_id").eqNullSafe(F.col("later_id")) & (F.col("content") == F.col("later_content"))
    joined = texts.join(later, own, "left").select("others", "text", "windows")
    kind = joined.schema["others"].dataType.simpleString()
    return joined.mapInArrow(_kept(["others"]), f"others {kind}, text string, n_lines long, runs {RUNS}")


def remove(documents: DataFrame, least: int = LEAST, words: int | None = None) -> DataFrame:
    """``documents`` without repeated runs of lines, with the same rows and columns."""
    kept = find(documents, least, words)
    return kept.select(*(F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in documents.columns))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS g
  FROM (SELECT *, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)
), f AS (
  SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM w WINDOW o AS (PARTITION BY g ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f WHERE doc_id <> fd OR i <> fi)
), k AS (
  SELECT a.doc_id, a.p, a.ln, gone.p IS NOT NULL AS cut
  FROM (SELECT doc_id, unnest(l) AS ln, unnest(range(1, len(l) + 1)) AS p FROM d) a
  LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.p = gone.p
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed,
  sha256(coalesce(string_agg(ln, chr(10) ORDER BY p) FILTER (NOT cut), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
