import random

import numpy as np
import pytest

from cairnfield.llm import lines as L


def brute(rows, least):
    """Rows (doc_id, text) with distinct doc_ids: the text kept, by definition."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        ls = (text or "").split("\n")
        gone = set()
        for i in range(len(ls) - least + 1):
            g = tuple(ls[i : i + least])
            if g in first:
                gone |= set(range(i, i + least))
            else:
                first[g] = doc_id, i
        out[doc_id] = ("\n".join(x for i, x in enumerate(ls) if i not in gone) if text is not None else None, len(gone))
    return out


@pytest.mark.parametrize("least", [2, 3, 5])
def test_equals_brute_force(spark, least):
    r = random.Random(least)
    rows = [(k, "\n".join(r.choice("abc") for _ in range(r.randint(1, 14)))) for k in range(60)]
    got = L.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least).collect()
    want = brute(rows, least)
    for row in got:
        covered = {i for x in row.runs for i in range(x.begin, x.begin + x.n_lines)}
        assert (row.text, len(covered)) == want[row.others.doc_id]
        assert all(x.n_lines >= least and x.source_id <= row.others.doc_id for x in row.runs)


def test_selection_is_winnowing():
    r = np.random.default_rng(3)
    for size in (2, 3, 7):
        hashes = r.integers(0, 9, 200).astype(np.uint64)
        at, first, n = L.selected(hashes, size, np.arange(len(hashes) - size + 1))
        want = [i + max(k for k in range(size) if hashes[i + k] == hashes[i : i + size].min()) for i in range(len(hashes) - size + 1)]
        assert np.repeat(at, n).tolist() == want and first.tolist() == np.flatnonzero(np.diff([-1, *want])).tolist()


def test_fewer_positions_than_windows_leave_the_texts(spark):
    r = random.Random(4)
    rows = [(k, "\n".join(str(r.random()) for _ in range(60)), k) for k in range(20)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, content long")
    n = texts.mapInArrow(L._positions(3, None), L.POSITIONS).count()
    assert n < 0.6 * 20 * 58


def test_runs_extend_both_ways(spark):
    shared = [f"line {k}" for k in range(9)]
    rows = [(1, "\n".join(["top", *shared, "end"])), (2, "\n".join(["other", *shared, "tail"]))]
    got = {r.others.doc_id: r for r in L.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].runs == [] and got[2].text == "other\ntail"
    assert [(x.begin, x.n_lines, x.source_id, x.source_begin) for x in got[2].runs] == [(1, 9, 1, 1)]


def test_edges_and_columns(spark):
    rows = [(3, "a\nb\nc", "x", 1), (1, "a\nb\nc", None, 2), (None, "a\nb\nc\nd", "y", 3), (5, None, "z", None), (6, "", "z", 1), (6, "", "z", 1), (7, "\n" * 50, "z", 1), (8, "q\n" * 30000, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string, windows int")
    out = L.remove(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.content): r.text for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, None] == "a\nb\nc" and got[3, "x"] == "" and got[None, "y"] == "d" and got[5, "z"] is None
    assert got[7, "z"] == "" or set(got[7, "z"]) <= {"\n"}
    assert len(got[8, "z"]) < 10
    assert L.remove(df.limit(0)).count() == 0


def brute_long(rows, least, words):
    """As brute, with shorter runs of over ``words`` words too."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        ls, gone = text.split("\n"), set()
        for size in range(1, least + 1):
            for i in range(len(ls) - size + 1):
                g = tuple(ls[i : i + size])
                if size < least and len(" ".join(g).split()) <= words:
                    continue
                if g in first:
                    gone |= set(range(i, i + size))
                else:
                    first[g] = doc_id, i
        out[doc_id] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def test_long_runs_of_few_lines(spark):
    r = random.Random(6)
    lines = [" ".join(f"{c}{k}" for k in range(r.choice([1, 20, 30, 50, 51, 60]))) for c in "abcdefghijklmnopqrstuvwx"] + ["", ""]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 6)))) for k in range(60)]
    passage = " ".join(f"p{k}" for k in range(51))
    rows += [(100, passage), (101, f"top\n{passage}\nend"), (102, passage)]
    got = {x.doc_id: x.text for x in L.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=50).collect()}
    assert got == brute_long(rows, 3, 50)
    assert (got[100], got[101], got[102]) == (passage, "top\nend", "")
    plain = {x.doc_id: x.text for x in L.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert plain[102] == passage
