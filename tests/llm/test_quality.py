import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from cairnfield.llm import quality as Q


M = 1 << 64


def plain_features(text):
    """Buckets of a text by definition, one by one."""

    def bucket(h, kind):
        mixed = h ^ ((kind + 1) * 0xD6E8FEB86659FD93 % M)
        return (mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 % M >> 47

    rolled = lambda t, base: sum((ord(c) + 1) * pow(base, i, M) for i, c in enumerate(t)) % M
    words = re.findall(Q.SOLID + "+", text)
    hashes, out = [rolled(w, Q.INVERSE) for w in words], []
    for w, h in zip(words, hashes, strict=True):
        out.append(bucket(h, 0))
        out += [bucket(rolled(f" {w} "[i : i + n], Q.BASE), n) for n in Q.GRAMS for i in range(len(w) + 3 - n)]
    return Counter(out + [bucket((b - a) % M, 1) for a, b in pairwise(hashes)])


def plain_model(texts, labels, weights):
    """Training by definition, a bucket at a time; without the weights' and rates' shortcuts."""
    random = np.random.default_rng(1)
    vectors = random.uniform(-1 / Q.DIMENSIONS, 1 / Q.DIMENSIONS, (Q.BUCKETS, Q.DIMENSIONS))
    layer, bias = random.uniform(-0.5, 0.5, (2, Q.DIMENSIONS)), np.zeros(2)
    bags = [plain_features(t) for t in texts]
    step = 0
    for _ in range(Q.EPOCHS):
        for k in random.permutation(len(bags)):
            rate = Q.RATE * (1 - step / (Q.EPOCHS * len(bags))) * weights[k]
            step += 1
            n = sum(bags[k].values())
            hidden = sum(vectors[i] * c / n for i, c in bags[k].items())
            e = np.exp(layer @ hidden + bias)
            error = e / e.sum() - np.eye(2)[labels[k]]
            back = error @ layer
            layer, bias = layer - rate * np.outer(error, hidden), bias - rate * error
            for i, c in bags[k].items():
                vectors[i] -= rate * min(1, 100 * c / n) * back
    return vectors, layer, bias


def plain_score(model, text):
    vectors, layer, bias = model
    bag = plain_features(text)
    e = np.exp(layer @ (sum((vectors[i] * c for i, c in bag.items()), np.zeros(Q.DIMENSIONS)) / max(1, sum(bag.values()))) + bias)
    return e[1] / e.sum()


ODD = ["ab abc", "", "abcab  xx\txx", "é naïve ô", "  a ", "x" * 40 + " end", "日本 語\n\nq"]


@pytest.mark.parametrize("piece", [1 << 19, 1, 7])
def test_features_equal_the_definition(monkeypatch, piece):
    monkeypatch.setattr(Q, "PIECE", piece)
    got = [Counter() for _ in ODD]
    for buckets, whose in Q._packed(ODD):
        for b, k in zip(buckets.tolist(), whose.tolist(), strict=True):
            got[k][b] += 1
    assert got == [plain_features(t) for t in ODD]


def test_fit_and_scores_equal_plain_training(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice("aa bb cc dd ee ff".split()[i % 2 :: 2] + ["zz"], 9))) for i in range(40)]
    labels = [(i, int(i % 4 > 0)) for i in range(40)]
    model = Q.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    plain = plain_model([t for _, t in docs], [q for _, q in labels], [1.0] * 40)
    texts = [t for _, t in docs[:6]] + ODD
    assert np.allclose(Q.scores(model, texts), [plain_score(plain, t) for t in texts], atol=2e-4)


def test_very_long_words_are_several(monkeypatch):
    long = "y" * (3 * Q.MOST_WORD + 5)
    cut = " ".join(["y" * Q.MOST_WORD] * 3 + ["y" * 5])
    assert [np.sort(b).tolist() for b, _ in Q._packed([long])] == [np.sort(b).tolist() for b, _ in Q._packed([cut])]


def test_learns_and_scores_edges(spark):
    rng = np.random.default_rng(1)
    good, bad = "the cat sat on a mat with one hat".split(), "BUY!! now | click $$ | win".split()
    docs = [(i, " ".join(rng.choice(good if i % 3 else bad, 20)), 9) for i in range(300)]
    labels = [(i, 1 if i % 3 else 0) for i in range(150)] + [(7, 1), (None, 1), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = Q.predict(df.where("doc_id >= 150"), model).collect()
    assert len(rows) == 150 and all((r.score >= 0.7) == bool(r.doc_id % 3) for r in rows)
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x"), (3, "the cat " * 200000)], "doc_id long, text string")
    got = Q.predict(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score and got[2].score == got[3].score
    assert Q.predict(odd.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.predict(docs, model).collect()[0].score == 0.5
