"""A compressed prefix tree of conversations: what a cache of shared beginnings would save."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm._common import dropped, staged

#: Conversation c begins with the first turns of c - c % FAMILY, fewer than HEADS of them.
FAMILY, HEADS = 100, 6
#: Consecutive turns whose digests are chained by one task.
TURNS = 4096
#: Consecutive depths of a path that are summed up together.
DEPTHS = 1024
#: Characters of role and text by which the rows of one turn number are dealt to tasks.
DEALT = 128
#: Bytes of a list of conversations that are a row.
PIECE = 1 << 16
ROOT = bytes(16)
NODE = ["id_hi", "id_lo"]


class Rebuilt(NamedTuple):
    """Turns as ``conv_id, pos (from 1), digest, chars, len`` and conversations as ``conv_id, len``."""

    turns: DataFrame
    conversations: DataFrame
    held: tuple[DataFrame, ...]


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among its conversation's rows in this partition."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        start = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
        sizes = np.diff(np.append(start, len(conv)))
        nth = np.arange(1, len(conv) + 1) - np.repeat(start, sizes)
        if conv[0] == last:
            nth[: sizes[0]] += n
        last, n = conv[-1], int(nth[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part)), pa.array(nth), batch.column("digest"), batch.column("chars")],
            names=["conv_id", "part", "nth", "digest", "chars"],
        )


def _ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, rank, digest, chars``: turns by (turn, role, text), nulls first, ranked
    from 1. Rows are dealt out in that order, so a long conversation is in many tasks; those
    that go on from one partition into the next are at most as many as there are partitions."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    turns = turns.withColumn("digest", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)).withColumn("chars", F.length("text").cast("long"))
    dealt = turns.repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.left("role", F.lit(DEALT)), F.left("text", F.lit(DEALT)))
    order = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    numbered = staged(order.select("conv_id", "digest", "chars").mapInArrow(_numbered, "conv_id long, part long, nth long, digest binary, chars long"), "numbered")
    runs = numbered.groupBy("conv_id", "part").agg(F.max("nth").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = runs.select(F.col("conv_id").alias("run_conv"), F.col("part").alias("run_part"), F.sum("n").over(before).alias("offset")).where("offset > 0")
    # one row for each partition that begins within a conversation
    joined = numbered.join(F.broadcast(later), (F.col("conv_id") == F.col("run_conv")) & (F.col("part") == F.col("run_part")), "left")
    out = staged(joined.select("conv_id", (F.col("nth") + F.coalesce("offset", F.lit(0))).alias("rank"), "digest", "chars"), "ranked")
    dropped(numbered)
    return out


def rebuild(conversations: DataFrame) -> Rebuilt:
    """Every conversation c with its first h turns replaced by those of c - c % FAMILY, where h
    is crc32 of c's decimal text modulo HEADS. ``chars`` are the code points of a turn's text."""
    ranked = _ordered(conversations)
    sizes = staged(ranked.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    plan = sizes.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEADS - 1)).alias("head"))
    taken = F.least("h", F.coalesce("head", F.lit(0)))
    plan = staged(
        plan.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")),
        "plan",
    )
    heads = ranked.where(F.col("rank") < HEADS).select(F.col("conv_id").alias("base"), F.col("rank").alias("pos"), "digest", "chars")
    first = plan.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "digest", "chars", "len")
    own = ranked.join(plan, "conv_id").where(F.col("rank") > F.col("h"))
    own = own.select("conv_id", (F.col("taken") + F.col("rank") - F.col("h")).alias("pos"), "digest", "chars", "len")
    return Rebuilt(first.union(own), plan.select("conv_id", "len"), (ranked, sizes, plan))


def _halves(digests: bytes | bytearray) -> list[pa.Array]:
    both = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each beginning of a block of turns, and that of one turn less."""
    key, state = None, ROOT
    for batch in batches:
        here, less = bytearray(), bytearray()
        for c, b, d in zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if (c, b) != key:
                key, state = (c, b), ROOT
            less += state
            state = sha256(state + d).digest()[:16]
            here += state
        kept = [batch.column(c) for c in ("conv_id", "block", "pos", "chars", "len")]
        yield pa.RecordBatch.from_arrays([*kept, *_halves(here), *_halves(less)], names=["conv_id", "block", "pos", "chars", "len", "c_hi", "c_lo", "p_hi", "p_lo"])


def _bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block but a conversation's first: the digest of all blocks before it, and
    (up_, end_) from which its predecessor's last beginning is mixed."""
    conv, state = None, ROOT
    for batch in batches:
        out, up, ends = bytearray(), bytearray(), bytearray()
        for c, hi, lo in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "c_hi", "c_lo")), strict=True):
            if c != conv:
                conv, state = c, ROOT
            end = np.array([hi, lo], np.int64).tobytes()
            up += state
            ends += end
            state = sha256(state + end).digest()[:16]
            out += state
        blocks = pc.add(batch.column("block"), 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), blocks, *_halves(out), *_halves(up), *_halves(ends)],
            names=["b_conv", "b_block", "b_hi", "b_lo", "up_hi", "up_lo", "end_hi", "end_lo"],
        )


def _mixed(*parts: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]


def _beginnings(rebuilt: Rebuilt) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, id_hi, id_lo, up_hi, up_lo, chars, ends``: a row for each beginning of a
    rebuilt conversation, the empty one too, with digests of 128 bits of it and of that with
    one turn less; and the table behind it. Turns are chained in blocks, blocks by their ends."""
    blocks = rebuilt.turns.withColumn("block", F.floor((F.col("pos") - 1) / TURNS))
    laid = blocks.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    names = "conv_id long, block long, pos long, chars long, len long, c_hi long, c_lo long, p_hi long, p_lo long"
    chained = staged(laid.select("conv_id", "block", "pos", "digest", "chars", "len").mapInArrow(_chained, names), "chained")
    ends = chained.where(F.col("pos") % TURNS == 0).select("conv_id", "block", "c_hi", "c_lo").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    bounds = ends.mapInArrow(_bounded, "b_conv long, b_block long, b_hi long, b_lo long, up_hi long, up_lo long, end_hi long, end_lo long")
    is_end = (F.col("pos") == F.col("len")).cast("long").alias("ends")
    named = lambda a, b: [x.alias(n) for x, n in zip([*a, *b], ["id_hi", "id_lo", "up_hi", "up_lo"], strict=True)]
    first = chained.where("block = 0").select("conv_id", F.col("pos").alias("depth"), *named([F.col("c_hi"), F.col("c_lo")], [F.col("p_hi"), F.col("p_lo")]), "chars", is_end)
    later = chained.where("block > 0").join(bounds, (F.col("conv_id") == F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    inside = _mixed("b_hi", "b_lo", "p_hi", "p_lo")
    across = [F.when(F.col("b_block") == 1, F.col(e)).otherwise(m) for e, m in zip(("end_hi", "end_lo"), _mixed("up_hi", "up_lo", "end_hi", "end_lo"), strict=True)]
    up = [F.when(F.col("pos") % TURNS == 1 % TURNS, a).otherwise(i) for a, i in zip(across, inside, strict=True)]
    later = later.select("conv_id", F.col("pos").alias("depth"), *named(_mixed("b_hi", "b_lo", "c_hi", "c_lo"), up), "chars", is_end)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = rebuilt.conversations.select("conv_id", zero.alias("depth"), *named([zero, zero], [none, none]), zero.alias("chars"), (F.col("len") == 0).cast("long").alias("ends"))
    return roots.union(first).union(later), chained


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, conversation) as pieces of comma-joined lists, in order."""
    part, nth, key, held, size = TaskContext.get().partitionId(), 0, None, [], 0
    for batch in batches:
        out = []
        for hi, lo, c in zip(*(batch.column(x).to_pylist() for x in (*NODE, "conv_id")), strict=True):
            if held and ((hi, lo) != key or size > PIECE):
                out.append((*key, part, nth, ",".join(held)))
                nth, held, size = nth + 1, [], 0
            key = hi, lo
            held.append(str(c))
            size += len(held[-1]) + 1
        yield _pieces(out)
    if held:
        yield _pieces([(*key, part, nth, ",".join(held))])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [*NODE, "part", "nth", "piece"]
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, read as a stream."""
    key, state = None, None
    row = lambda found: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["l_hi", "l_lo", "ends_sha256"])
    for batch in batches:
        out = []
        for hi, lo, piece in zip(*(batch.column(x).to_pylist() for x in (*NODE, "piece")), strict=True):
            if (hi, lo) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (hi, lo), sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield row(out)
    if key is not None:
        yield row([(*key, state.hexdigest())])


def _end_lists(ends: DataFrame) -> DataFrame:
    """``l_hi, l_lo, ends_sha256``: of the conversations that end at a node. They are joined in
    pieces by tasks that hold a stretch of the sorted rows each; only pieces meet by node."""
    dealt = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = dealt.select(*NODE, "conv_id").mapInArrow(_listed, "id_hi long, id_lo long, part long, nth long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "nth").select(*NODE, "piece").mapInArrow(_hashed, "l_hi long, l_lo long, ends_sha256 string")


def _along_paths(nodes: DataFrame) -> DataFrame:
    """Adds, along each owner's nodes sorted by depth: ``cum``, the sum of weights down to
    the node; ``bottom``, the depth of the next point, itself included, which ends its edge; and
    ``above``, the last point before it as (depth, cum). Paths are taken in blocks of
    DEPTHS and put together by what is known of whole blocks."""
    cut = nodes.withColumn("stretch", F.floor(F.col("depth") / DEPTHS))
    inside = Window.partitionBy("owner", "stretch").orderBy("depth")
    sofar, before = (inside.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    point_depth = F.when(F.col("is_point"), F.col("depth"))
    rows = cut.withColumn("cum", F.sum("weight").over(sofar)).withColumn("bottom", F.min(point_depth).over(onward))
    rows = rows.withColumn("above", F.max(F.when(F.col("is_point"), F.struct("depth", "cum"))).over(before))
    whole = rows.groupBy("owner", "stretch").agg(
        F.sum("weight").alias("sum"), F.min(point_depth).alias("next"), F.max(F.when(F.col("is_point"), F.struct("depth", "cum"))).alias("last")
    )
    along = Window.partitionBy("owner").orderBy("stretch")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    whole = whole.withColumn("offset", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    shifted = F.when(F.col("last").isNotNull(), F.struct(F.col("last.depth").alias("depth"), (F.col("last.cum") + F.col("offset")).alias("cum")))
    whole = whole.withColumn("last", shifted).select(
        F.col("owner").alias("w_owner"), F.col("stretch").alias("w_stretch"), "offset", F.min("next").over(later).alias("next"), F.max("last").over(earlier).alias("prior")
    )
    both = rows.join(whole, (F.col("owner") == F.col("w_owner")) & (F.col("stretch") == F.col("w_stretch")))
    own = F.when(F.col("above").isNotNull(), F.struct(F.col("above.depth").alias("depth"), (F.col("above.cum") + F.col("offset")).alias("cum")))
    return both.select(*nodes.columns, (F.col("cum") + F.col("offset")).alias("cum"), F.coalesce("bottom", "next").alias("bottom"), F.coalesce(own, "prior").alias("above"))


def _summed_up(points: DataFrame) -> DataFrame:
    """``owner, depth, total, leaves``: sums of ``edge`` and ``leaf`` over each point's subtree.

    ``points`` (owner, depth, up_owner, up_depth, edge, leaf). After k rounds each point has the
    sums of its descendants less than 2^k points below and knows its 2^k-th ancestor, to
    which it adds them next: as many rounds as the logarithm of the compressed tree's height.
    The root adds to nothing, so it is never joined with all that hangs on it.
    """
    held = staged(points.select("owner", "depth", "up_owner", "up_depth", F.col("edge").alias("total"), F.col("leaf").alias("leaves")), "sums")
    while not held.where(F.col("up_depth").isNotNull()).isEmpty():
        below = held.where(F.col("up_depth").isNotNull()).groupBy(F.col("up_owner").alias("to_owner"), F.col("up_depth").alias("to_depth"))
        below = below.agg(F.sum("total").alias("more"), F.sum("leaves").alias("more_leaves"))
        onward = held.where(F.col("depth") > 0).select(F.col("owner").alias("via_owner"), F.col("depth").alias("via_depth"), F.col("up_owner").alias("far_owner"), F.col("up_depth").alias("far_depth"))
        none = F.lit(None).cast("long")
        done = held.where("up_depth IS NULL OR up_depth = 0").select("owner", "depth", none.alias("up_owner"), none.alias("up_depth"), "total", "leaves")
        far = held.where("up_depth > 0").join(onward, (F.col("up_owner") == F.col("via_owner")) & (F.col("up_depth") == F.col("via_depth")))
        moved = done.union(far.select("owner", "depth", "far_owner", "far_depth", "total", "leaves"))
        joined = moved.join(below, (F.col("owner") == F.col("to_owner")) & (F.col("depth") == F.col("to_depth")), "left")
        summed = joined.select(
            "owner", "depth", "up_owner", "up_depth", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")
        )
        old, held = held, staged(summed, "sums")
        dropped(old)
    return held


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct beginning of rebuilt conversations (``rebuild``): ``conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node's owner, ``conv_id``, is the smallest conversation that begins with it. Sorted by
    (owner, depth), the nodes lie path by path, and an edge of the compressed (Patricia) tree is a run
    of them: it ends at a point, which is where conversations branch or end. Only points
    go through the sums over subtrees (``_summed_up``); every other node has one child and
    gets its figures from the point that ends its edge and the edge's sum from it on.

    ``saved_tokens`` are the code points that a cache of beginnings would not process again.
    Beginnings are told apart by digests of 128 bits. No conversation, path or list is held in a
    task: they are cut into blocks or read as streams. A branch with many children is an
    equi-join with one row, which Spark splits.

    Defined cases: rows with a null conv_id are in no conversation; null role or text is empty; turns
    come by turn (null first), then role, text; repeated rows are repeated turns; a conversation
    without rebuilt turns ends at the root; an empty table gives no rows, not even a root;
    texts are taken whole; other columns are ignored. Turns of one conversation that agree in
    turn and in the first DEALT characters of role and text are sorted by one task, which spills.
    """
    rebuilt = rebuild(conversations)
    rows, chained = _beginnings(rebuilt)
    nodes = staged(
        rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("depth", "up_hi", "up_lo", "chars")), F.sum("ends").alias("ends")),
        "nodes",
    )
    lists = staged(_end_lists(rows.where("ends = 1")), "end-lists")
    children = nodes.where("depth > 0").groupBy(F.col("up_hi").alias("of_hi"), F.col("up_lo").alias("of_lo")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, (F.col("id_hi") == F.col("of_hi")) & (F.col("id_lo") == F.col("of_lo")), "left")
    known = known.select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"))
    known = known.withColumn("is_point", (F.col("n_children") != 1) | (F.col("ends") > 0) | (F.col("depth") == 0))
    laid = staged(_along_paths(known), "laid")

    tops = laid.groupBy(F.col("owner").alias("top_owner")).agg(F.min(F.struct("depth", "up_hi", "up_lo")).alias("top"))
    tops = tops.select("top_owner", F.col("top.depth").alias("top_depth"), F.col("top.up_hi").alias("top_hi"), F.col("top.up_lo").alias("top_lo")).where("top_depth > 0")
    root = nodes.where("depth = 0").select(F.col("owner").alias("from_owner"), (F.col("depth") + 1).alias("at"))
    parents = nodes.where("depth > 0").select(F.col("owner").alias("from_owner"), "id_hi", "id_lo")
    # the root is one row
    high = tops.where("top_depth = 1").join(F.broadcast(root), F.col("top_depth") == F.col("at")).select("top_owner", "top_depth", "from_owner")
    low = tops.where("top_depth > 1").join(parents, (F.col("top_hi") == F.col("id_hi")) & (F.col("top_lo") == F.col("id_lo"))).select("top_owner", "top_depth", "from_owner")
    tops = staged(high.union(low), "tops")

    points = laid.where("is_point").join(tops.withColumnRenamed("top_depth", "first_depth"), F.col("owner") == F.col("top_owner"), "left")
    inside = F.col("above").isNotNull()
    points = staged(
        points.select(
            "owner", "depth", "cum",
            F.when(inside, F.col("owner")).otherwise(F.col("from_owner")).alias("up_owner"),
            F.when(inside, F.col("above.depth")).otherwise(F.col("first_depth") - 1).alias("up_depth"),
            (F.col("cum") - F.coalesce("above.cum", F.lit(0))).alias("edge"),
            (F.col("n_children") == 0).cast("long").alias("leaf"),
        ),
        "points",
    )
    sums = _summed_up(points)
    ended = points.join(sums.select("owner", "depth", "total", "leaves"), ["owner", "depth"])
    ended = ended.select(F.col("owner").alias("q_owner"), F.col("depth").alias("q_depth"), F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("edge") + F.col("cum")).alias("q_sum"))
    full = laid.join(ended, (F.col("owner") == F.col("q_owner")) & (F.col("bottom") == F.col("q_depth")))
    full = full.join(tops, (F.col("owner") == F.col("top_owner")) & (F.col("depth") == F.col("top_depth")), "left")
    full = full.join(lists, (F.col("id_hi") == F.col("l_hi")) & (F.col("id_lo") == F.col("l_lo")), "left")
    out = full.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("from_owner", "owner")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("q_sum") - F.col("cum") + F.col("weight")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    done = staged(out, "trie")
    dropped(*rebuilt.held, chained, nodes, lists, laid, tops, points, sums)
    return done


SQL = """
WITH RECURSIVE t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, max(r) AS n, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
crc(conv_id, s, k, v) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, CAST(k // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE v END AS x FROM crc WHERE k < 8 * length(s))
), heads AS (
  SELECT conv_id, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = 8 * length(s)
), plan AS (
  SELECT i.conv_id, i.base, h, least(h, coalesce(b.n, 0)) AS taken FROM ids i JOIN heads USING (conv_id) LEFT JOIN ids b ON b.conv_id = i.base
), built AS (
  SELECT p.conv_id, t.r AS pos, role, text FROM plan p JOIN t ON t.conv_id = p.base AND t.r <= h
  UNION ALL
  SELECT p.conv_id, taken + t.r - h, role, text FROM plan p JOIN t ON t.conv_id = p.conv_id AND t.r > h
), p AS (
  SELECT conv_id, 0 AS depth, [] :: VARCHAR[] AS path, 0 AS chars FROM ids
  UNION ALL
  SELECT conv_id, pos, list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY pos), length(text) FROM built
), w AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM w GROUP BY path, depth
), kids AS (
  SELECT n.*, coalesce(c.k, 0) AS k
  FROM nodes n LEFT JOIN (SELECT path[: depth - 1] AS up, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY up) c ON c.up = n.path
), above AS (
  SELECT k.path, unnest(range(0, depth + 1)) AS d, k.k, k.n, k.chars FROM kids k
), sums AS (
  SELECT path[: d] AS top, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * chars) AS saved FROM above GROUP BY top
)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(k.n AS BIGINT) AS n_convs, CAST(k.k AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM kids k JOIN sums s ON s.top = k.path LEFT JOIN nodes u ON k.depth > 0 AND u.path = k.path[: k.depth - 1]
"""
