import time
import random
import re

from cairnfield.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, n_words string"
ITEMS = "item_id long, text string, doc_id long"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, window):
    out = {}
    for doc_id, text, *_ in docs:
        words, hit, found = plain_words(text), set(), set()
        for item_id, item, *_ in items:
            iw = plain_words(item)
            w = min(window, len(iw))
            grams = {tuple(iw[i : i + w]) for i in range(len(iw) - w + 1)} if w else set()
            for i in range(len(words) - w + 1):
                if w and tuple(words[i : i + w]) in grams:
                    hit |= set(range(i, i + w))
                    found.add(str(item_id) if item_id is not None else "")
        out.setdefault(doc_id, []).append((len(words), len(hit), sorted(found)))
    return out


def check(spark, docs, items, window, **more):
    rows = D.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window, **more).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_words, sum(b - a for a, b in r.hit_spans), r.hit_items))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(docs, items, window).items()}


def test_random_texts_equal_brute_force(spark):
    r = random.Random(5)
    for window, letters in ((4, "ab"), (3, "abc"), (10, "a"), (5, "abé")):
        text = lambda n: "".join(r.choice(letters) + r.choice([" ", "-", "\n"]) for _ in range(r.randint(0, n)))  # noqa: E731, B023
        docs = [(i, text(60), "x", None) for i in range(40)]
        items = [(i, text(14), 7) for i in range(12)]
        check(spark, docs, items, window)
        check(spark, docs, items, window, block_words=9)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(1, None, None, None), (None, "One TWO three", "x", "y"), (None, "One TWO three", "x", "y"), (3, "", "", ""), (4, "z " * 30000 + "one two three" + " z" * 9, "x", "y"), (5, "É one!two-THREE é", "", "")]
    items = [(2, "one two three", 1), (2, "three é", 1), (None, "é ONE", None), (4, None, 1), (5, "--", 1)]
    check(spark, docs, items, 10)
    check(spark, docs, [], 10)
    check(spark, [], items, 10)


def test_remove_cuts_spans_and_drops_covered_documents(spark):
    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11"
    docs = [(1, "Keep this, please: (" + item.upper() + ") and this is kept as well, all the way to the end.", "x", "1"), (2, item, "x", "1"), (3, None, "x", None), (4, "clean", None, "2")]
    df = spark.createDataFrame(docs, DOCS)
    out = D.remove(df, spark.createDataFrame([(1, item, 1)], ITEMS))
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == "Keep this, please: () and this is kept as well, all the way to the end."
    assert got[3].text is None and got[4].text == "clean" and got[4].n_words == "2"


def test_pieces_of_a_long_text_equal_the_whole(monkeypatch):
    r = random.Random(6)
    items = [(str(k), D.words_of(" ".join(r.choice("abc") for _ in range(r.randint(1, 9))).encode())) for k in range(5)]
    a = D.build_automaton(items, 5)
    text = (" ".join(r.choice("abcd") for _ in range(300))).encode()
    whole = D.scan_text(a, text)
    for piece in (1, 6, 40):
        monkeypatch.setattr(D.word_pieces, "__defaults__", (piece,))
        assert D.scan_text(a, text) == whole


def test_very_long_repetitive_items_take_linear_time():
    line = [b"w%d" % k for k in range(12)]
    began = time.process_time()
    a = D.build_automaton([("x", line * 50_000)])
    assert time.process_time() - began < 60
    assert D.scan(a, [b"q", *line, *line, b"q"]) == ([(1, 25)], {"x"})


def test_many_blocks_and_items_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCKS_AT_ONCE", 2)
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(words[40 * k : 40 * k + r.choice([4, 25, 40])])) for k in range(10)]
    docs = [(k, " ".join(words[i : i + 60])) for k, i in enumerate(range(0, 340, 17))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted((x.doc_id, x.n_words, x.hit_spans, x.hit_items) for x in D.find(*frames, block_words=n).collect()) for n in (15, 10_000)]
    assert found[0] == found[1]


def test_scans_of_many_blocks_write_hits_and_no_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCKS_AT_ONCE", 2)
    written, gone = [], []
    monkeypatch.setattr(D, "staged", lambda df, name, real=D.staged: written.append((name, real(df, name))) or written[-1][1])
    monkeypatch.setattr(D, "dropped", lambda *tables, real=D.dropped: gone.extend(tables) or real(*tables))
    item = lambda k: " ".join(f"i{k}w{j}" for j in range(12))
    items = spark.createDataFrame([(k, item(k)) for k in range(7)], "item_id long, text string")
    secret = "unwritten"
    rows = [(1, f"{secret} {item(0)} x {item(6)} {secret}", "c", "s"), (1, f"{secret} {item(0)} x {item(6)} {secret}", "c", "s"), (2, None, "c", "s"), (3, secret, "c", "s"), (4, f"{secret} {item(3)} " + "y " * 90, "c", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string, hit_spans string")
    got = sorted((r.doc_id, r.content, r.n_words, r.hit_spans, r.hit_items) for r in D.find(docs, items, block_words=12).collect())
    assert got == [(1, "c", 27, [[1, 13], [14, 26]], ["0", "6"])] * 2 + [(2, "c", 0, [], []), (3, "c", 1, [], []), (4, "c", 103, [[1, 13]], ["3"])]
    assert [name for name, _ in written] == ["hits"] * 3 + ["all-hits"] and gone == [t for n, t in written if n == "hits"]
    known = written[-1][1]
    assert known.columns == ["content", "hit_spans", "hit_items"] and known.count() == 2
    cleaned = D._scanned(docs.drop("hit_spans"), items, 10, 12, "text", 0.5).collect()
    assert sorted((r.doc_id, r.content) for r in cleaned) == [(2, "c"), (3, "c"), (4, "c")]
