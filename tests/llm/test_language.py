import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import language as L
from cairnfield.llm._common import held_out

WORDS = {"xa": "bada gudu bidi noru dana", "yo": "strelk pritch volk zhern mork", "zu": "ééra ôti naïve çela"}


def corpus(n=60):
    rng = np.random.default_rng(2)
    return [(k * 3 + j, " ".join(rng.choice(w.split(), 12)), lang) for k in range(n) for j, (lang, w) in enumerate(WORDS.items())]


def brute_model(texts, order):
    """Interpolated Kneser-Ney by definition, over tuples."""
    full = [Counter() for _ in range(order)]
    for t in texts:
        code = [" "] + list(t)
        for k in range(order):
            full[k].update(tuple(code[i - k : i + 1]) for i in range(k, len(code)))
    used = []
    for k in range(order):
        if k == order - 1:
            used.append(dict(full[k]))
        else:
            left = defaultdict(int)
            for g in full[k + 1]:
                left[g[1:]] += 1
            used.append({g: left.get(g, 1) for g in full[k]})
    total, kinds = defaultdict(float), Counter()
    for k in range(order):
        for g, n in used[k].items():
            total[k, g[:-1]] += n
            kinds[k, g[:-1]] += 1

    def p(g, alphabet):
        k = len(g) - 1
        below = p(g[1:], alphabet) if k else 1 / alphabet
        off = L.discount(np.array(list(used[k].values())))
        t = total.get((k, g[:-1]), 0)
        if not t:
            return below
        return max(0, used[k].get(g, 0) - off) / t + min(1, off * kinds[k, g[:-1]] / t) * below

    return p, {g[0] for g in full[0]}


def test_tables_equal_the_definition(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")


    counted = df.mapInArrow(L._counted(3), "lang string, k int, gram long, suffix long, context long, n long").toPandas()
    counted = counted.groupby(["lang", "k", "gram"]).agg(suffix=("suffix", "min"), context=("context", "min"), n=("n", "sum")).reset_index()
    languages = sorted(WORDS)
    model = L.estimate(counted, languages, 3)
    brute = {x: brute_model([t for _, t, y in rows if y == x], 3) for x in languages}
    alphabet = len(set().union(*(b[1] for b in brute.values()))) + 1
    tests = ["bada pritch", "naïve qqq", "zz", rows[5][1]]
    got, n = L.cross_entropies(model, tests, L.letters())
    for t, row in zip(tests, got, strict=True):
        code = [" "] + list(t)
        for j, lang in enumerate(languages):
            logs = [math.log(brute[lang][0](tuple(code[max(0, i - 2) : i + 1]), alphabet)) for i in range(1, len(code))]
            assert row[j] == pytest.approx(-sum(logs) / len(logs), rel=1e-4)


def test_held_out_accuracy_and_edges(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").withColumn("score", held_out(F.col("doc_id")))
    model = L.fit(df.where("not score"))
    rows = L.predict(df, model, ("doc_id", "lang", "text")).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in rows)
    odd = [(1, None), (None, ""), (2, "123 !!"), (2, "123 !!"), (3, "BADA, gudu!" * 60000), (4, "x")]
    got = L.predict(spark.createDataFrame(odd, "doc_id long, text string"), model, ("doc_id",)).collect()
    assert [r.lang_pred for r in got[:4]] == ["und"] * 4 and all(r.rejected and r.score == 0 for r in got[:4])
    assert got[4].lang_pred == "xa" and not got[4].rejected




def test_nothing_to_learn_and_clashing_names(spark):
    empty = spark.createDataFrame([(1, "abc", None, "k")], "doc_id long, text string, lang string, others string")
    model = L.fit(empty)
    assert L.predict(empty, model).collect()[0].lang_pred == "und"
    good = L.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    kept = L.accepted(empty.union(spark.createDataFrame([(2, "bada gudu", None, "k"), (3, None, "xa", None)], empty.schema)), good)
    assert kept.columns == empty.columns
    assert {r.doc_id for r in kept.collect()} <= {1, 2}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_without_ids_of_their_own_are_sampled(spark, doc_id):
    rows = [(doc_id, t, lang) for _, t, lang in corpus()]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=20)
    assert model["languages"] == sorted(WORDS)
    judged = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, ("lang", "text")).collect()
    assert all(r.lang_pred == r.lang for r in judged)


def test_nothing_counted_gives_the_empty_model(spark):
    df = spark.createDataFrame([(1, "", "xa")], "doc_id long, text string, lang string")
    assert L.predict(df, L.fit(df.limit(0))).collect()[0].rejected
    for text in ("", "12"):
        L.fit(df.select("doc_id", F.lit(text).alias("text"), "lang"))


def test_rare_languages_have_limits(spark):
    df = spark.createDataFrame(corpus(15), "doc_id long, text string, lang string")
    model = L.fit(df)
    assert np.all(np.isfinite(model["limits"]))
    rows = [*((k, t) for k, t, _ in corpus(15)), (999, "qxjw vvkq zzxh wqpf hhjx kcwv " * 5)]
    got = {r.doc_id: r.rejected for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [k for k, x in got.items() if x] == [999]


@pytest.mark.parametrize("piece", [1, 5, 17])
def test_pieces_of_a_text_count_like_the_whole(spark, monkeypatch, piece):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string, lang string")
    key = ["lang", "k", "gram"]
    whole = L.counts(df, 3).sort_values(key).reset_index(drop=True)
    model, texts = L.estimate(whole, sorted(WORDS), 3), ["bada  gudu, zz9 pritch naïve. ", "", "x", "ΑΣ ΣΑΣ"]
    want = L.cross_entropies(model, texts, L.letters())
    monkeypatch.setattr(L, "PIECE", piece)
    parts = pd.concat([b.to_pandas() for b in L._counted(3)(b for b in df.select("doc_id", "text", "lang").toArrow().to_batches())])
    parts = parts.groupby(key).agg(suffix=("suffix", "min"), context=("context", "min"), n=("n", "sum")).reset_index()
    assert parts.sort_values(key).reset_index(drop=True).astype({"k": "int32"}).equals(whole[parts.columns])
    got = L.cross_entropies(model, texts, L.letters())
    assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1].tolist()


def test_a_worker_holds_one_block_at_once(monkeypatch):
    counted = pd.concat([b.to_pandas() for b in L._counted(3)([pa.RecordBatch.from_pylist([{"lang": x, "text": w} for x, w in WORDS.items()])])])
    model, letters = L.estimate(counted, sorted(WORDS), 3), L.letters()
    texts = ["bada gudu " * (90 + k % 20) for k in range(700)]
    sizes = [int(s.sum()) for _, _, s, _ in L.normalised(texts, letters, 3)]
    assert sum(sizes) == sum(len(t) + 1 for t in texts) and max(sizes) < 150_000
    want = L.cross_entropies(model, texts, letters)
    monkeypatch.setattr(L, "BLOCK", L.PIECE * 2)
    got = L.cross_entropies(model, texts, letters)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_clashing_kept_columns_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "doc_id long, text string, score double")
    with pytest.raises(ValueError):
        L.predict(df, {"languages": []}, ("doc_id", "score"))
