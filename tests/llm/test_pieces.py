import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cairnfield.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "  ", "   x", "\n", " \n ", "a\n\nb ", "▁", "▁a", "a" * 300, " " * 77 + "x", "▁" * 40, "\x00a", "<s>", "<0x0A>", "�", "é漢\U0001f600"]


@pytest.fixture(scope="module")
def both():
    return pieces.Encoder(pieces.load(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(both):
    encoder, library = both
    r = random.Random(3)
    letters = "aAbe et\n  ▁é漢\U0001f6000x<>\t\x00thingandñ"
    for text in EDGES + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(2000)]:
        ids, decoded = encoder.encode(text)
        want = library.encode(text, add_eos=True)
        assert np.frombuffer(ids, np.int32).tolist() == want
        assert decoded == library.decode(want)


def test_operator_on_edges(spark, both):
    texts = [*EDGES, None, "same", "same", "long words " * 20000]
    df = spark.createDataFrame([(i if i else None, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, ids array<int>")
    rows = sorted(pieces.encode(df, PATH).collect(), key=lambda r: r.doc_id or 0)
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        assert row.ids == both[1].encode(text or "", add_eos=True)
        assert row.decoded == both[1].decode(row.ids)
    assert pieces.encode(df.where("doc_id < 0"), PATH).count() == 0
