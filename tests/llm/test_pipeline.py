"""The pipeline's stages against plain versions on a small table with planted cases."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_decontaminate import plain_words
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = {"xa": "bada gudu bidi noru dana moli pexu rati", "yo": "strelk pritch volk zhern mork drev plosk chten"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    path = tmp_path_factory.mktemp("sf")
    sentence = lambda lang, n: " ".join(r.choice(WORDS[lang].split()) + r.choice(["", "", "a", "o"]) for _ in range(n))
    rows = []
    for k in range(120):
        lang = r.choice(list(WORDS))
        rows.append([k, "\n".join(sentence(lang, r.randint(12, 30)) for _ in range(r.randint(1, 6))), lang, "s"])
    item = "the quick brown fox jumps over one lazy dog near that old river bank"
    block = "\n".join(sentence("xa", 14) for _ in range(4))
    for k in (10, 40, 70):
        rows[k][1] += "\n" + block
    rows[20][1] += " " + item.upper() + "! " + sentence("yo", 20)
    rows[21][1] = item
    rows += [[200, rows[5][1], "xa", "s"], [201, rows[6][1] + " bada", "xa", "s"], [202, "12 34 !!", "xa", "s"], [203, None, None, None], [204, "", "yo", "s"]]
    docs = spark.createDataFrame([(*x, len(x[1]) if x[1] is not None else None) for x in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_planted_cases(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, tables)
    before = {r.doc_id: r for r in kept.collect()}
    assert not {202, 203, 204} & set(before) and len(before) >= 121 and kept.columns == docs.columns

    lined = corpus_pipeline.line_dedup(spark, kept, tables)
    after = {r.doc_id: r for r in lined.collect()}
    want = brute_lines([(i, r.text) for i, r in before.items()], 3)
    assert {i: r.text for i, r in after.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.values()) and lined.columns == docs.columns

    single = corpus_pipeline.near_dedup(spark, lined, tables)
    stay = {r.doc_id: r for r in single.collect()}
    assert set(stay) == {c for *_, c in brute_components([(i, r.text) for i, r in after.items()])}

    clean = corpus_pipeline.benchmark_decontamination(spark, single, tables)
    left = {r.doc_id: r for r in clean.collect()}
    assert set(left) == set(stay) - {21}
    assert "QUICK" not in left[20].text and all(left[i].text == stay[i].text for i in left if i != 20)
    assert plain_words(left[20].text) == [w for w in plain_words(stay[20].text) if w not in "the quick brown fox jumps over one lazy dog near that old river bank".split()]

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    for r in corpus_pipeline.encoding(spark, clean, tables).collect():
        assert r.ids == library.encode(left[r.doc_id].text, add_eos=True) and r.n_tokens == len(r.ids) and r.round_trip


def test_run_equals_the_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    key = lambda r: (r.doc_id, r.n_tokens, np.array(r.ids).tobytes())
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, tables).collect()))


@pytest.mark.parametrize("stage", [corpus_pipeline.language_id, corpus_pipeline.encoding])
def test_python_gets_batches_of_bounded_bytes(spark, tables, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    spark.conf.unset(corpus_pipeline.BATCH_BYTES)
    stage(spark, docs, tables)
    wide = spark.range(5000, numPartitions=1).selectExpr("repeat('x', 4000) text")
    held = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    spark.conf.unset(corpus_pipeline.BATCH_BYTES)
    assert sum(r.n for r in held) == 5000 and max(r.size for r in held) < 1.2 * corpus_pipeline.SOME_BYTES
