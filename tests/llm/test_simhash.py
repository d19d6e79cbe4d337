import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cairnfield.llm import simhash as S
from cairnfield.llm.components import components


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    ids = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[i][0], prints[i], ids[group[i]]) for i in range(len(rows))), key=repr)


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for k in range(n):
        if k % 3 and out:
            base = r.choice(out)[1].split()
            for _ in range(r.randint(0, 3)):
                if base:
                    base[r.randrange(len(base))] = r.choice(words)
            out.append((k, " ".join(base)))
        else:
            out.append((k, " ".join(r.choice(words) for _ in range(r.choice([0, 2, 4, 80, 200])))))
    return out


def test_golay_table_is_perfect():
    table = S.golay_table()
    assert np.all(np.bincount(table) == 2048)


def test_prints_within_four_bits_share_a_key():
    table, r = S.golay_table(), np.random.default_rng(4)
    x = r.integers(0, 1 << 64, 400, dtype=np.uint64)
    y = x.copy()
    for k in range(400):
        for b in r.choice(64, k % 5, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    kx, rx = S.keys(x, table)
    ky, ry = S.keys(y, table)
    for k in range(400):
        assert set(kx[rx == k]) & set(ky[ry == k]), (hex(x[k]), hex(y[k]))


def got(df):
    return sorted(((r.doc_id, r.print % (1 << 64), r.component_id) for r in S.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize(("crowd", "counted"), [(2048, 64), (3, 64), (3, 1), (0, 1)])
def test_equals_brute_force(spark, crowd, counted, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "COUNTED", counted)
    rows = [*texts(1, 160), (900, None), (None, "a B c d e"), (None, "A b c d e"), (901, "a b c d e"), (901, "a b c d e"), (902, "x " * 70000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_dense_prints_are_linked(monkeypatch):
    r = np.random.default_rng(1)
    prints = np.unique(np.array([sum(1 << int(b) for b in r.choice(64, 3)) for _ in range(400)], np.uint64))
    left, right = S.linked(np.zeros(len(prints), np.int64), prints)
    edges = sum(map(len, left))
    assert edges == len(prints) - 1 or edges < len(prints)
    monkeypatch.setattr(S, "CROWD", 20)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.sort(np.repeat([1, 2, 3], [5, 300, 4]))[k : k + 30]), pa.array(np.arange(309)[k : k + 30])], names=["key", "print"]) for k in range(0, 309, 30)]
    crowd = {int(x) for key, p, hot in S._runs(batches) for x in (p if hot or len(p) > 250 else [])}
    assert crowd >= set(range(5, 305))


def test_rows_of_crowded_keys_are_not_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 100)
    monkeypatch.setattr(S, "COUNTED", 4)
    r = np.random.default_rng(2)
    # all share most bits of their segments, and with them keys
    prints = np.unique((r.integers(0, 1 << 6, 3000) << 22 | r.integers(0, 1 << 10, 3000)).astype(np.uint64))
    table = S.golay_table()
    key, row = S.keys(prints, table)
    most = np.bincount(np.unique(key, return_inverse=True)[1])
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    hot = {x.hot for x in S._crowded(frame).collect()}
    names = np.unique(key)
    assert (most > 1000).any() and (most <= 100).any()
    assert {int(k) for k, n in zip(names, most, strict=True) if n > 1000} <= hot <= {int(k) for k, n in zip(names, most, strict=True) if n > 100}


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


def test_one_of_each_and_empty(spark):
    rows = [(5, "a b c d", "x"), (3, "A b c d", "y"), (3, "A b c d", "y"), (None, "other text here it is", "z"), (None, "other text here it is", "z"), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string")
    out = S.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(3, "A b c d", "y"), (None, "other text here it is", "z"), (9, None, None)], key=repr)
    assert S.one_of_each(df.limit(0)).count() == 0


def test_pieces_of_a_long_text_give_its_print():
    r = random.Random(8)
    for n in (0, 1, 3, 4, 5, 9, 200):
        text = "".join(f"W{r.randrange(50)}" + r.choice([" ", "  ", "\t\n"]) for _ in range(n))
        assert {S.fingerprint(text.encode(), piece) for piece in (1, 7, 30, 1 << 20)} == {brute_print(text)}


def test_one_doc_id_with_different_texts(spark):
    rows = [(1, "one two three four five six"), (1, "quite another text with other words"), (1, "one two three four five six"), (0, "first of a pair here"), (1, "First of a pair here")]
    out = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, out.collect())) == [(0, "first of a pair here"), (1, "one two three four five six"), (1, "quite another text with other words")]
