"""Near-duplicates by the exact Jaccard similarity of word shingles, met through linked SimHash fingerprints and, for what
four bits don't reach, through MinHash bands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm import simhash
from cairnfield.llm._common import as_bytes, dropped, small, staged
from cairnfield.llm.components import components
from cairnfield.llm.simhash import LOWER, PIECE, SPACE, own_row

WORDS = 5
#: Texts are near-duplicates from a Jaccard similarity of SIMILAR[0] / SIMILAR[1] on.
SIMILAR = (4, 5)
#: Two texts of similarity s share no band with a chance of (1 - s^DEPTH)^BANDS: 5e-8 at 0.8.
BANDS, DEPTH = 32, 4
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS, SHIFTS = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * DEPTH, 1), np.uint32) | np.uint32(1)
CHUNK = 1 << 12
#: Members of a bucket that are compared with all others in its first round, and how many
#: times as many in each later one.
HEADS, MORE = 1, 8
#: Columns of a set's sketch.
SKETCH = [f"sketch_{k}" for k in range(8)]


def _joined(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of the shingles of word hashes in order."""
    n = max(1, len(words) - WORDS + 1)
    out = words[:n].copy()
    for k in range(1, min(WORDS, len(words))):
        out = (out ^ (out >> np.uint64(31))) * MIX + words[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def shingles(raw: bytes, piece: int = PIECE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a very long text is read in pieces."""
    parts, at, tail = [], 0, np.zeros(0, np.uint64)
    while at < len(raw):
        found = SPACE.search(raw, at + piece) if at + piece < len(raw) else None
        end = found.start() if found else len(raw)
        words = raw[at:end].translate(LOWER).split()
        tail = np.concatenate((tail, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))))
        at = end
        if len(tail) >= WORDS:
            parts.append(_joined(tail))
            tail = tail[1 - WORDS :]
    if not parts:
        return _joined(tail) if len(tail) else tail
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: the smallest of the shingles in DEPTH orders."""
    least = np.full(BANDS * DEPTH, (1 << 32) - 1, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), CHUNK):
        np.minimum(least, (short[k : k + CHUNK] * FACTORS + SHIFTS).min(axis=1), out=least)
    rows = least.reshape(BANDS, DEPTH).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for k in range(DEPTH):
        key = ((key ^ (key >> np.uint64(29))) + rows[:, k]) * MIX
    return key ^ (key >> np.uint64(32))


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = as_bytes(batch.column("text"))
        sets = [shingles(raw) for raw in texts]
        prints = np.array([simhash.fingerprint(raw) for raw in texts], np.uint64)
        node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
        keys = [bands(s).view(np.int64) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("own"), pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints.view(np.int64))],
            names=["own", "node", "n", "bands", "print"],
        )


def sketched(found: np.ndarray) -> np.ndarray:
    """For each of 512 classes of shingles, whether an odd number of the set's are in it. Two sets differ
    by at least as many shingles as their sketches differ by bits."""
    counts = np.bincount((found * MIX >> np.uint64(55)).astype(np.int64), minlength=64 * len(SKETCH))
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        sets = [shingles(raw) for raw in as_bytes(batch.column("text"))]
        parts = np.array([sketched(s) for s in sets], np.int64).reshape(-1, len(SKETCH))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, parts.T.copy())], names=["node", "shingles", *SKETCH])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small([batch], "left"):
            left, right = (part.column(c) for c in ("left", "right"))
            keep = [similar(*(np.frombuffer(x[k].as_buffer(), np.uint64) for x in (left, right))) for k in range(len(part))]
            yield part.select(["a", "b", "root_a", "root_b"]).filter(pa.array(keep, pa.bool_()))


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small([batch], "shingles"):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
            nodes = np.repeat(part.column("node").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["node", "token"])


def _rare(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, root, key, own`` and the set's sketch: a bucket for each of a node's rarest shingles that another of ``nodes`` has
    among its rarest.

    Shingles are ordered by the number of these nodes that have them. Sets of a similarity of SIMILAR or more
    share one of the n - ceil(0.8 n) + 1 that come first in each, so no link is lost, and pages that share
    a template, which is frequent, but not enough of the rest don't meet. ``own`` counts the shingles that
    no other node has: of near copies, the one they come from has fewest.
    """
    tokens = sets.join(nodes.select(F.col("node").alias("one")), F.col("node") == F.col("one"), "left_semi").mapInArrow(_tokens, "node long, token long")
    tokens = staged(tokens, "tokens")
    often = staged(tokens.groupBy(F.col("token").alias("counted")).agg(F.count("*").alias("times")).where("times > 1"), "often")
    # a shingle of one node comes before all others and meets nothing: its number is enough
    shared = tokens.join(often, F.col("token") == F.col("counted")).select("node", "token", "times")
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "token"))
    n_shared = shared.groupBy(F.col("node").alias("of")).agg(F.count("*").alias("n_shared"))
    sized = nodes.join(n_shared, F.col("node") == F.col("of")).withColumnRenamed("node", "member")
    sized = sized.join(sets.select(F.col("node").alias("sketched"), *SKETCH), F.col("member") == F.col("sketched"))
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]) + 1 - (F.col("n") - F.col("n_shared"))
    first = shared.withColumn("place", place).join(sized, F.col("node") == F.col("member")).where(F.col("place") <= prefix)
    first = staged(first.select("node", "n", "root", F.col("token").alias("key"), (F.col("n") - F.col("n_shared")).alias("own"), *SKETCH), "rare")
    met = first.groupBy(F.col("key").alias("shared")).agg(F.count("*").alias("times")).where("times > 1")
    out = staged(first.join(met, F.col("key") == F.col("shared"), "left_semi"), "buckets")
    dropped(tokens, often, first)
    return out


def _split(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that aren't one component yet."""
    apart = buckets.groupBy(F.col("key").alias("apart")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return buckets.join(apart, F.col("key") == F.col("apart"), "left_semi")


def alike(found: DataFrame) -> DataFrame:
    """``member, alike``: the component of linked fingerprints that each node of ``found`` (node, print) is in, by
    ``simhash.links``; a node whose texts have several may be in several."""
    prints = staged(found.select("print").distinct(), "distinct-prints")
    edges = simhash.links(prints)
    groups = components(edges).withColumnRenamed("node", "linked")
    joined = found.join(groups, F.col("print") == F.col("linked"), "left")
    out = staged(joined.select(F.col("node").alias("member"), F.coalesce("root", "print").alias("alike")).distinct(), "alike")
    dropped(prints, edges, groups)
    return out


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges ``a long, b long`` between nodes of a similarity of SIMILAR or more: enough to
    connect all such pairs that share a key.

    ``nodes`` (node, n, keys, first) has the distinct sets of shingles, ``texts`` (own,
    text) the text of each first row. A bucket holds the nodes with one key. In a round a
    few of its members, its heads, are compared with all its others that aren't connected
    with them yet, by their whole sets; then they leave it. A bucket is done when its
    members are one component. So a large group of near copies needs rows in proportion to
    its size.

    The first round's buckets are the components of linked fingerprints and the bands. What one head doesn't settle is dealt anew by its
    rarest shingles (``_rare``) and goes on with more heads, first those with the fewest shingles of their own. From then on rows have a
    sketch of their set, from which the join sees a lower bound of what two sets don't share, so that sets which
    differ too much aren't paired. No pair is compared twice, and
    each round unites only the components that its new edges join.
    """
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = staged(keyed.groupBy(F.col("key").alias("shared")).agg(F.count("*").alias("times")).where("times > 1").drop("times"), "shared")
    buckets = staged(keyed.join(shared, F.col("key") == F.col("shared"), "left_semi").select("node", "n", F.col("node").alias("root"), "key", F.lit(0).cast("long").alias("own")), "buckets")
    met = staged(buckets.select(F.col("node").alias("candidate")).distinct(), "candidates")
    # written first: while it is small, Spark broadcasts it by its size and texts aren't shuffled
    firsts = staged(nodes.join(met, F.col("node") == F.col("candidate"), "left_semi").select("node", "first"), "set-firsts")
    same = (F.col("own.content") == F.col("first.content")) & F.col("own.doc_id").eqNullSafe(F.col("first.doc_id"))
    sets = staged(texts.join(firsts, same).select("node", "text").mapInArrow(_sets, f"node long, shingles binary, {', '.join(f'{c} long' for c in SKETCH)}").dropDuplicates(["node"]), "sets")
    edges = staged(buckets.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0), "edges")
    tried = staged(edges, "tried")
    heads, by_bands, sketch = HEADS, True, []
    while not buckets.isEmpty():
        slot = F.pmod(F.xxhash64("node"), F.lit(heads))
        first = staged(buckets.groupBy(F.col("key").alias("bucket"), slot.alias("slot")).agg(F.min(F.struct("own", "node", "n", "root", *sketch)).alias("head")), "heads")
        # what two sets share is neither over the smaller one nor among shingles that only one has
        both = F.least(F.col("n") - F.col("own"), F.col("head.n") - F.col("head.own"))
        enough = (sum(SIMILAR) * both >= SIMILAR[0] * (F.col("n") + F.col("head.n"))) & (SIMILAR[1] * F.least("n", "head.n") >= SIMILAR[0] * F.greatest("n", "head.n"))
        if sketch:
            apart = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"head.{c}"))) for c in sketch))
            enough = enough & (sum(SIMILAR) * apart <= (SIMILAR[1] - SIMILAR[0]) * (F.col("n") + F.col("head.n")))
        ends = F.struct("node", "root"), F.struct(F.col("head.node").alias("node"), F.col("head.root").alias("root"))
        pairs = buckets.join(first, (F.col("key") == F.col("bucket")) & (F.col("root") != F.col("head.root")) & enough).select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
        pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.root").alias("root_a"), F.col("b.root").alias("root_b")).distinct()
        known = tried.select(F.col("a").alias("tried_a"), F.col("b").alias("tried_b"))
        pairs = staged(pairs.join(known, (F.col("a") == F.col("tried_a")) & (F.col("b") == F.col("tried_b")), "left_anti"), "pairs")
        left, right = (sets.select(F.col("node").alias(f"{x}_node"), F.col("shingles").alias(x)) for x in ("left", "right"))
        right = right.join(pairs.select(F.col("b").alias("met")).distinct(), F.col("right_node") == F.col("met"), "left_semi")
        held = pairs.join(left, F.col("a") == F.col("left_node")).join(right, F.col("b") == F.col("right_node"))
        more = staged(held.select("a", "b", "root_a", "root_b", "left", "right").mapInArrow(_verified, "a long, b long, root_a long, root_b long"), "more")
        old = [edges, tried, buckets, first, pairs, more]
        edges, tried = staged(edges.union(more.select("a", "b")), "edges"), staged(tried.union(pairs.select("a", "b")), "tried")
        groups = components(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("was"), F.col("root").alias("joined"))
        gone = first.select("bucket", F.col("head.node").alias("gone"))
        rest = buckets.join(gone, (F.col("key") == F.col("bucket")) & (F.col("node") == F.col("gone")), "left_anti")
        rest = staged(rest.join(groups, F.col("root") == F.col("was"), "left").select("node", "n", F.coalesce("joined", "root").alias("root"), "key", "own", *sketch), "rest")
        buckets = staged(_split(rest), "buckets")
        if by_bands:
            old.append(buckets)
            buckets, by_bands, sketch = _rare(sets, buckets.select("node", "n", "root").distinct()), False, SKETCH
        else:
            heads *= MORE
        dropped(*old, rest, groups)
    dropped(shared, met, firsts, sets, tried, buckets)
    return edges


def grouped(documents: DataFrame) -> DataFrame:
    """``own, first``: own stands for the row, first for its component's first row.

    Words are those of simhash; shingles are five words in order (fewer: all of them), told
    apart by 64-bit hashes. Texts are linked if the sets of their shingles have a Jaccard
    similarity of 0.8 or more, which is computed from the whole sets. Texts without a
    word are alike, and like no other. Texts whose fingerprints ``simhash.links`` connects meet
    first; bands add those that four bits don't reach.

    Defined cases: null text has no words; very long texts are read in pieces and count whole; an
    empty table gives no rows; repeated rows have the same name and group; other columns are ignored.
    """
    texts = documents.select(own_row(), "text")
    kind = texts.schema["own"].dataType.simpleString()
    found = staged(texts.mapInArrow(_signed, f"own {kind}, node long, n long, bands array<bigint>, print long"), "signed")
    distinct = staged(found.groupBy("node", "n").agg(F.min("own").alias("first"), F.first("bands").alias("bands")), "distinct")
    prints = alike(found)
    # a key of its own kind, so that it equals no band's
    linked = prints.groupBy("member").agg(F.collect_set(F.xxhash64(F.lit("prints"), "alike")).alias("linked"))
    keys = F.when(F.col("n") > 0, F.concat("bands", F.coalesce("linked", F.array().cast("array<bigint>")))).alias("keys")
    nodes = staged(distinct.join(linked, F.col("node") == F.col("member"), "left").select("node", "n", "first", keys), "nodes")
    edges = links(nodes, texts)
    groups = components(edges).withColumnRenamed("node", "member")
    rooted = staged(nodes.join(groups, F.col("node") == F.col("member"), "left").select(F.col("node").alias("one"), "first", F.coalesce("root", "node").alias("root")), "rooted")
    firsts = staged(rooted.groupBy(F.col("root").alias("group")).agg(F.min("first").alias("first")), "firsts")
    by_node = staged(rooted.drop("first").join(firsts, F.col("root") == F.col("group")).select("one", "first"), "by-node")
    dropped(distinct, prints, nodes, edges, groups, rooted, firsts)
    return found.join(by_node, F.col("node") == F.col("one"), "left").select("own", "first")
