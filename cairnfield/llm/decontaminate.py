"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import as_bytes, dropped, small, staged

WINDOW = 10
#: Words of items in one automaton. A larger benchmark is cut into blocks of this size,
#: each with an automaton of its own, so that what is broadcast stays bounded.
BLOCK_WORDS = 200_000
#: Automata that are broadcast at once; then the hits so far are written, without texts.
BLOCKS_AT_ONCE = 4
SPANS, ITEMS = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())
BIGRAM_BITS = 22
PIECE = 1 << 22

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes to bytes: A-Z to a-z, word bytes to themselves, all others to a space.
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def word_pieces(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``piece`` bytes, so that a very long text isn't
    held as words all at once."""
    text, at = raw.translate(NORMAL), 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        yield text[at : end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)


def build_automaton(items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> dict:
    """The suffix automaton of all items, with the windows that end in each state.

    ``link``, ``length``, ``step``: the automaton. ``ends``: state -> items with a window
    there. ``top``: state -> the state of its suffix of ``window`` words. ``short``: state
    -> (words, item) of items below the window size. ``up``: state -> the next shorter
    suffix state that has short items. ``bigrams``: a bit set of hashed neighbouring words.
    """
    vocabulary: dict[bytes, int] = {}
    link, length, step = [-1], [0], [{}]

    def extend(last: int, w: int) -> int:
        if (q := step[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else split(last, w, q)
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        while last >= 0 and w not in step[last]:
            step[last][w] = new
            last = link[last]
        if last >= 0:
            q = step[last][w]
            link[new] = q if length[q] == length[last] + 1 else split(last, w, q)
        return new

    def split(p: int, w: int, q: int) -> int:
        clone = len(link)
        link.append(link[q])
        length.append(length[p] + 1)
        step.append(dict(step[q]))
        link[q] = clone
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = clone
            p = link[p]
        return clone

    coded = []
    for item, words in items:
        if words:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            coded.append((item, ids))
            last = 0
            for w in ids:
                last = extend(last, w)
    # a state's suffix link is shorter, so in order of length it has been looked at before
    by_length = np.argsort(np.array(length), kind="stable")[1:].tolist()
    top: dict[int, int] = {}
    for s in by_length:
        if length[s] >= window:
            top[s] = top.get(link[s], s)
    ends: dict[int, set[str]] = {}
    short: dict[int, list[tuple[int, str]]] = {}
    bigrams = np.zeros(1 << BIGRAM_BITS, bool)
    least = window
    for item, ids in coded:
        bigrams[_bigram(np.array(ids, np.int64))] = True
        state = 0
        for i, w in enumerate(ids):
            state = step[state][w]
            if i + 1 >= window:
                ends.setdefault(top[state], set()).add(item)
        if len(ids) < window:
            short.setdefault(state, []).append((len(ids), item))
            least = min(least, len(ids))
    up: dict[int, int] = {}
    for s in by_length if short else ():
        if at := link[s] if link[s] in short else up.get(link[s], 0):
            up[s] = at
    return {"vocabulary": vocabulary, "link": link, "length": length, "step": step, "ends": ends, "short": short, "top": top, "up": up, "bigrams": bigrams, "least": least, "window": window}


def _bigram(ids: np.ndarray) -> np.ndarray:
    return ((ids[:-1] * 0x9E3779B1 + ids[1:] * 0x85EBCA77) >> 5) & ((1 << BIGRAM_BITS) - 1)


def _stretches(a: dict, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words outside which no window can lie: all their neighbours are items'."""
    if a["least"] == 1:
        good = ids >= 0
        need = 1
    else:
        good = (ids[:-1] >= 0) & (ids[1:] >= 0) & a["bigrams"][_bigram(ids)]
        need = a["least"] - 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if hi - lo >= need:
            yield lo, hi if a["least"] == 1 else hi + 1


def scan(a: dict, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges inside occurrences of windows, merged, and the items they belong to."""
    if len(words) < a["least"] or not a["vocabulary"]:
        return [], set()
    get = a["vocabulary"].get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    link, length, step, window = a["link"], a["length"], a["step"], a["window"]
    spans, items, seen = [], set(), set()
    for lo, hi in _stretches(a, ids):
        state = matched = 0
        for i, w in enumerate(ids[lo:hi].tolist(), lo):
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            if w not in step[state]:
                continue
            state = step[state][w]
            matched += 1
            if matched >= window:
                spans.append((i + 1 - window, i + 1))
                if (at := a["top"][state]) not in seen:
                    seen.add(at)
                    items |= a["ends"][at]
            at = state if state in a["short"] else a["up"].get(state, 0)
            while at:
                for n, item in a["short"][at]:
                    if n <= matched:
                        spans.append((i + 1 - n, i + 1))
                        items.add(item)
                at = a["up"].get(at, 0)
    return _merged(spans), items


def scan_text(a: dict, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """``scan`` of a whole text, piece by piece; and its number of words."""
    n, spans, items, tail = 0, [], set(), []
    for words in word_pieces(raw):
        block = tail + words
        found, belong = scan(a, block)
        spans += [(lo + n - len(tail), hi + n - len(tail)) for lo, hi in found]
        items |= belong
        n += len(words)
        tail = block[len(block) - min(len(block), a["window"] - 1) :]
    return n, _merged(spans), items


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _found(automata: list, raw: bytes, spans: Iterable[list[int]] = (), items: Iterable[str] = ()) -> tuple[int, list[list[int]], list[str]]:
    """A text's number of words, and its spans and items by all ``automata`` and those given."""
    n, all_spans, all_items = 0, [tuple(x) for x in spans], {*items}
    for automaton in automata:
        n, more, belong = scan_text(automaton.value, raw)
        all_spans += more
        all_items |= belong
    return n, [list(x) for x in _merged(all_spans)], sorted(all_items)


def _hits(automata: list) -> Callable:
    """Of the texts with a hit their hash, spans and items; no text leaves the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            rows = []
            for raw in as_bytes(batch.column("text")):
                _, spans, items = _found(automata, raw)
                if spans:
                    rows.append((hashlib.sha256(raw).hexdigest(), spans, items))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), SPANS, ITEMS), strict=True)], names=["content", "hit_spans", "hit_items"])

    return run


def _scanner(automata: list, column: str, names: list[str], most_coverage: float | None = None) -> Callable:
    """Adds the automata's spans and items to those that the rows already carry. With a limit
    of coverage, cuts the spans from the texts instead and keeps the rows within the limit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, column):
            before = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            found = [_found(automata, raw, spans, items) for raw, spans, items in zip(as_bytes(batch.column(column)), *before, strict=True)]
            if most_coverage is not None:
                texts, stay = batch.column(column).to_pylist(), []
                for k, (n, spans, _) in enumerate(found):
                    if sum(hi - lo for lo, hi in spans) <= most_coverage * n:
                        stay.append(k)
                        if spans:
                            texts[k] = cut(texts[k].encode(), spans).decode()
                chosen = pa.array(stay, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in stay], pa.string()) if c == column else batch.column(c).take(chosen) for c in names], names=names)
                continue
            n_words, spans, items = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(list(n_words), pa.int64()), pa.array(list(spans), SPANS), pa.array(list(items), ITEMS)],
                names=[*names, "n_words", "hit_spans", "hit_items"],
            )

    return run


def _blocks(benchmark: DataFrame, block_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``block_words`` words. An item of more is cut into parts
    that overlap by a word less than a window, so that each window lies in one."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of((row[1] or "").encode())
        for i in range(0, max(1, len(words) - window + 1), block_words):
            part = words[i : i + block_words + window - 1]
            if block and n + len(part) > block_words:
                yield block
                block, n = [], 0
            block.append((row[0] or "", part))
            n += len(part)
    yield block


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, column: str = "text") -> DataFrame:
    """Adds ``n_words long, hit_spans array<array<long>>, hit_items array<string>``.

    Words are runs of ASCII letters and digits (lower-cased) and non-ASCII characters. A
    window is ``window`` consecutive words of an item, or a shorter item as a whole.
    ``hit_spans`` are the merged word ranges [from, to) that lie inside occurrences of
    windows; ``hit_items`` the sorted identifiers of the items those windows belong to.

    Every word of every document streams through an automaton per block of the benchmark.
    Blocks are read, built and broadcast in turn, BLOCKS_AT_ONCE of them at a time, so neither the
    driver nor what is broadcast grows with the benchmark. A benchmark of more blocks costs a
    scan of the texts for each further BLOCKS_AT_ONCE; those scans write hits by the texts' hashes, and the
    last one joins them: texts are never written, and shuffled once at most (not at all while the hits
    are small enough to be broadcast). Words between which no item has a transition
    are passed over, as no window can cross them.

    Defined cases: null text has no words; null item_id counts as the empty text; repeated
    documents are judged alike; items that share an identifier count as one; an empty
    benchmark hits nothing; no documents give no rows; very long texts are scanned in pieces and
    count whole. All columns of ``documents`` are kept but for those named here.
    """
    return _scanned(documents, benchmark, window, block_words, column)


def _scanned(documents: DataFrame, benchmark: DataFrame, window: int, block_words: int, column: str, most_coverage: float | None = None) -> DataFrame:
    spark = documents.sparkSession
    names = [c for c in documents.columns if c not in ("n_words", "hit_spans", "hit_items")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*names).schema)
    hits = "hit_spans array<array<bigint>>, hit_items array<string>"
    none = F.array().cast("array<array<bigint>>"), F.array().cast("array<string>")
    groups, earlier = batched(_blocks(benchmark, block_words, window), BLOCKS_AT_ONCE), []
    group, following = next(groups), next(groups, None)
    while following is not None:
        automata = [spark.sparkContext.broadcast(build_automaton(block, window)) for block in group]
        found = documents.select(F.col(column).alias("text")).mapInArrow(_hits(automata), f"content string, {hits}")
        earlier.append(staged(found.dropDuplicates(["content"]), "hits"))
        for automaton in automata:
            automaton.destroy()
        group, following = following, next(groups, None)
    if earlier:
        # a text has one row of each scan, so a group is no larger than what its text can hold
        joined = reduce(DataFrame.union, earlier).groupBy("content")
        known = staged(joined.agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("hit_items")), "all-hits")
        dropped(*earlier)
        same = F.sha2(F.coalesce(documents[column], F.lit("")), 256) == known["content"]
        before = (F.coalesce(known[c], empty).alias(c) for c, empty in zip(("hit_spans", "hit_items"), none, strict=True))
        out = documents.join(known, same, "left").select(*(documents[c] for c in names), *before)
    else:
        out = documents.select(*names, none[0].alias("hit_spans"), none[1].alias("hit_items"))
    last = [spark.sparkContext.broadcast(build_automaton(block, window)) for block in group]
    if most_coverage is not None:
        return out.mapInArrow(_scanner(last, column, names, most_coverage), fields)
    return out.mapInArrow(_scanner(last, column, names), f"{fields}, n_words long, {hits}")


def cut(raw: bytes, spans: list[list[int]]) -> bytes:
    """``raw`` without the words of each span and what lies between them."""
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : begin[lo]])
        at = int(end[hi - 1])
    return b"".join([*out, raw[at:]])


def remove(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, column: str = "text") -> DataFrame:
    """``documents`` without contaminated passages, with the same columns.

    Every span of words inside windows is cut from its text. A document of which more than
    ``most_coverage`` of the words are hit goes as a whole. All others stay, null and empty
    texts too.
    """
    others = F.struct(*[F.col(c) for c in documents.columns if c != column]).alias("others")
    kept = _scanned(documents.select(others, F.col(column).alias("passage")), benchmark, window, BLOCK_WORDS, "passage", most_coverage)
    return kept.select(*(F.col("passage").alias(c) if c == column else F.col("others")[c].alias(c) for c in documents.columns))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
