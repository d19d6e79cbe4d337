import random

import numpy as np
import pytest

import corpus_pipeline
from cairnfield.llm import near as N
from cairnfield.llm import simhash

SCHEMA = "doc_id long, text string"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for k in range(n):
        if k % 3 and out:
            base = r.choice(out)[1].split()
            for _ in range(r.randint(0, 4)):
                if base:
                    base[r.randrange(len(base))] = r.choice(words)
            out.append((k, " ".join(base)))
        else:
            out.append((k, " ".join(r.choice(words) for _ in range(r.choice([0, 2, 5, 80, 200])))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_equals_brute_jaccard(spark, seed):
    rows = [*texts(seed, 160), (900, None), (901, "A b c d e"), (902, "a B c d e")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_pieces_of_a_long_text_give_its_shingles():
    r = random.Random(8)
    for n in (0, 1, 4, 5, 6, 200):
        text = "".join(f"W{r.randrange(50)}" + r.choice([" ", "  ", "\t\n"]) for _ in range(n))
        assert len({N.shingles(text.encode(), piece).tobytes() for piece in (1, 7, 30, 1 << 20)}) == 1
        assert len(N.shingles(text.encode())) == len(plain(text))


def test_pages_of_a_template_do_not_meet(spark, monkeypatch):
    r = random.Random(4)
    # 75 words are common, so no pair is similar; nine more are copies of one page but for a word
    common = [f"t{k}" for k in range(75)]
    rows = [(k, " ".join(common[:40] + [f"p{k}x{j}" for j in range(25)] + common[40:])) for k in range(300)]
    for k in range(300, 309):
        words = rows[7][1].split()
        words[r.randrange(60)] = "other"
        rows.append((k, " ".join(words)))
    pairs = []
    keep = N.staged
    monkeypatch.setattr(N, "staged", lambda df, name: pairs.append(t.count()) or t if (t := keep(df, name)) and name == "pairs" else t)
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(x.doc_id for x in out.collect()) == brute_kept(rows)
    assert sum(pairs) < 4485


def test_edges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("cairnfield.storage.LOCAL_SHARED_DIR", str(tmp_path))
    table = "doc_id long, text string, node long, n string, key int"
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], table), "").collect() == []
    same = "a b c d e f g h " * 30
    rows = [(None, None, 1, "", 1), (None, "", 2, "", 2), (3, same, 3, "", 3), (3, same, 3, "", 3), (4, same + "i", 4, None, None), (5, "x " * 200000, 5, "", 5)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, table), "")
    assert out.columns == ["doc_id", "text", "node", "n", "key"]
    assert sorted(str(x.doc_id) for x in out.collect()) == ["3", "5", "None"]
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left <= {"signed", "by-node", "kept"}


def test_linked_fingerprints_meet_without_bands(spark, monkeypatch):
    r = random.Random(3)
    # a long text and copies of it with one word changed have fingerprints within four bits
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for k in range(4):
        words = list(base)
        words[700 * k + 9] = "other"
        rows.append((k, " ".join(words)))
    rows.append((9, " ".join(f"o{j}" for j in range(40))))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {x.component_id for x in simhash.near_duplicates(df).collect()} == {0, 9}
    linked = N.simhash.links
    met = []
    monkeypatch.setattr(N.simhash, "links", lambda prints: met.append(1) or linked(prints))
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()) == brute_kept(rows) == [0, 9] and met


def test_sketches_bound_what_sets_do_not_share():
    r = np.random.default_rng(5)
    for n in (0, 3, 60, 2000):
        both, a, b = (np.unique(r.integers(0, 1 << 63, k, np.int64).astype(np.uint64)) for k in (n, 9, 14))
        x, y = N.sketched(np.concatenate((both, a))), N.sketched(np.concatenate((both, b)))
        assert 15 <= int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= 23 and len(x) == len(N.SKETCH)
