import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from cairnfield.llm import prefix_trie as P

TALK = "conv_id long, turn long, role string, text string, n_convs string, owner int"


def plain(rows):
    """The trie by dictionaries of whole beginnings."""
    talks = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            talks[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [y[2:] for y in sorted(v)] for c, v in talks.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        sign = -1 if c < 0 else 1
        whole = tuple(turns.get(c - sign * (abs(c) % 100), [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].add(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    out = []
    for path in members:
        below = [q for q in members if q[: len(path)] == path]
        out.append((
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]),
            sum(not children[q] for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
            sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def built(spark, rows, parts=3):
    got = P.trie(spark.createDataFrame(rows, TALK).repartition(parts)).collect()
    assert got == [] or got[0].asDict().keys() == {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"}
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in got), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_whole_beginnings(spark, monkeypatch, seed):
    monkeypatch.setattr(P, "TURNS", 3)
    monkeypatch.setattr(P, "DEPTHS", 2)
    monkeypatch.setattr(P, "PIECE", 4)
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-120, 420), 45), 0, 100, 300]:
        for t in range(rng.choice((0, 1, 2, 4, 9, 14))):
            rows.append((c, rng.choice((t, t, t, None)), rng.choice("ab"), rng.choice(("x", "yy", "ü€")) if t > 5 or rng.random() < 0.3 else "s", "n", 1))
    rows += [rows[0]] * 3 + [(None, 1, "a", "lost", None, None)]
    assert built(spark, rows) == plain(rows)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "TURNS", 16)
    monkeypatch.setattr(P, "DEPTHS", 8)
    monkeypatch.setattr(P, "PIECE", 16)
    rows = [(100, t, "a", f"t{t % 7}", None, 1) for t in range(150)]
    rows += [(c, t, "a", f"t{t % 7}", None, 1) for c in range(101, 160) for t in range(12)]
    rows += [(c, t, "a", f"t{t % 7}", None, 1) for c in range(200, 240) for t in range(c - 198)]
    assert built(spark, rows, 7) == plain(rows)


def test_edges(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "a", "x", None, 1)]) == []
    odd = [(7, None, None, None, None, None), (7, None, None, None, None, None), (8, 1, "a", "w " * 200000, None, 1), (8, 2, "", None, None, 1), (9, 1, "ab", "c", None, 1), (9, 1, "a", "bc", None, 1)]
    assert built(spark, odd) == plain(odd)
    turnless = [(c, 1, "a", "x", None, 1) for c in (1, 2, 3, 4, 205, 207)]
    got = built(spark, turnless)
    assert got == plain(turnless) and any(r[1] == 0 and r[7] != sha256(b"").hexdigest() for r in got)
