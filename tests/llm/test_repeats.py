import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairnfield.llm import queries
from cairnfield.llm import repeats as R


def brute(rows, length):
    count = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        count.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc_id, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out.append((doc_id, len(raw), [list(x) for x in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out, key=repr)


def check(spark, rows, length):
    df = spark.createDataFrame([(i, t, "x", b"k") for i, t in rows], "doc_id long, text string, content string, kept binary").repartition(3)
    got = R.remove_repeats(df, length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.spans, bytes(r.kept)) for r in got), key=repr) == brute(rows, length)


def texts(seed, n):
    r = random.Random(seed)
    noise = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    shared = [noise(r.randint(60, 400)) for _ in range(8)]
    rows = []
    for k in range(n):
        t = "".join(r.choice(shared)[r.randint(0, 40) :] if r.random() < 0.5 else noise(r.randint(0, 150)) for _ in range(r.randint(0, 6)))
        rows.append((k, t))
    return rows


def test_interval_expansion_equals_brute_force():
    r = np.random.default_rng(3)
    for n, s, length in ((300, 2, 5), (500, 3, 7), (400, 5, 3), (200, 1, 50), (7, 2, 9)):
        codes = np.concatenate((r.integers(1, s + 1, n), r.integers(1, s + 1, 40), [0]))
        codes[-60:-1] = codes[10:69][: len(codes[-60:-1])] if n > 100 else codes[-60:-1]
        grams = [tuple(codes[i : i + length]) for i in range(len(codes))]
        count = Counter(g for g in grams if len(g) == length and 0 not in g)
        got = R.repeated(codes, s + 1, length)
        assert got.tolist() == [count[g] > 1 for g in grams]


@pytest.mark.parametrize("crowd", [256, 2])
def test_equals_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(R, "CROWD", crowd)
    monkeypatch.setattr(R, "BLOCK", 3000)
    check(spark, texts(1, 60), 100)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 500)
    long = "".join(random.Random(9).choice("xyz") for _ in range(3000))
    rows = [(1, None), (None, ""), (2, "short"), (2, "short"), (3, long), (None, long[200:900] + "é" * 300), (4, "a" * 700), (5, "q" + long + "q"), (6, "same" * 60), (6, "same" * 60)]
    check(spark, rows, 100)
    check(spark, rows[:3], 100)
    check(spark, [], 100)


def test_places_of_very_long_texts(spark):
    """Parts that together have more bytes than a place has bits for, at the real PIECE."""
    r = random.Random(5)
    noise = lambda n: "".join(map(chr, r.choices(range(97, 123), k=n)))
    long = noise((1 << 20) + 399)
    rows = [(0, noise((1 << 20) - 50)), (1, long), (2, long[-700:])]
    got = {x.doc_id: x.spans for x in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {0: [], 1: [[len(long) - 700, len(long)]], 2: [[0, 700]]}


def test_short_periods(spark):
    """At the real length: stretches with a period, their ends, and parts of them elsewhere."""
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("uvwxyz") for _ in range(n))
    rows = [(0, "a" * 3000), (1, noise(300) + "abc" * 500 + noise(500)), (2, "ab" * 190 + noise(50) + "ab" * 205), (3, "a" * 400), (4, "b" * 401), (5, noise(20) + "abcab" * 79)]
    word = noise(350)
    rows += [(6, word * 3 + word[:100]), (7, word + word[:49]), (8, "k" * 399), (9, noise(90) + "ka" * 700 + "k" + "ka" * 300 + noise(90)), (9, "ka" * 200)]
    check(spark, rows, R.LENGTH)


def test_a_period_is_one_row():
    unit = R.Unit(R.LENGTH, R.GRAM, np.uint8)
    for text in ("a" * (3 << 20), "abc" * (1 << 20)):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "content": [2], "text": [text]})
        rows = pa.Table.from_batches(R._anchored([unit])([batch])).to_pylist()
        assert len(rows) < 20 and sum(r["strings"] * r["repeat"] for r in rows) == len(text) - R.LENGTH + 1


def test_passages_equal_brute_force(spark, monkeypatch):
    r = random.Random(8)
    words = lambda n: [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(n)]
    shared = [words(r.randint(8, 40)) for _ in range(6)]
    rows = []
    for k in range(50):
        parts = [r.choice(shared)[r.randint(0, 4) :] if r.random() < 0.5 else words(r.randint(0, 12)) for _ in range(r.randint(0, 5))]
        rows.append((k, " \n".join(" ".join(p) for p in parts)))
    rows += [(60, " ".join(words(30) * 2)), (61, None), (62, rows[3][1]), (63, rows[3][1])]
    for crowd in (256, 2):
        monkeypatch.setattr(R, "CROWD", crowd)
        monkeypatch.setattr(R, "BLOCK", 200)
        owners = {}
        for i, t in rows:
            w = (t or "").split()
            for j in range(len(w) - 9):
                owners.setdefault(tuple(w[j : j + 10]), set()).add(i)
        want = {}
        for i, t in rows:
            w = (t or "").split()
            hit = {p for j in range(len(w) - 9) if len(owners[tuple(w[j : j + 10])]) > 1 for p in range(j, j + 10)}
            want[i] = sorted(hit)
        got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4000, 10).collect()
        assert {x.doc_id: [p for a, b in x.passages for p in range(a, b)] for x in got} == want and any(want.values())


def test_query_shows_passages_of_fewer_bytes(spark, tmp_path):
    """A passage of 51 words in two documents, in fewer than 400 bytes; 50 words and repeats
    within one document are none. What goes is what the bytes say."""
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    passage, short, long = words(51), words(50), words(90)
    rows = [(0, f"{words(30)}\n{passage}\n{words(20)}"), (1, f"{passage} {words(40)}"), (2, f"{words(9)} {short}"), (3, f"{short} {words(70)}")]
    rows += [(4, f"{passage[::-1]} {words(3)} {passage[::-1]}"), (5, words(200)), (6, long), (7, f"{words(5)} {long}"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op3_repeats"](spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = {x.doc_id: (x.n_removed, x.n_passage_words) for x in got.collect()}
    assert len(passage) < 400 < len(long)
    assert found == {0: (0, 51), 1: (0, 51), 6: (len(long), 90), 7: (len(long), 90)} | {k: (0, 0) for k in (2, 3, 4, 5, 8)}
