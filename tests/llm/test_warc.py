import base64
import hashlib

from pyspark.sql import functions as F

from cairnfield.llm import warc as W

PAGES = "page_id long, url string, html string, payload string, digest int"


def brute(rows, least=0):
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    out = []
    for page_id, _, html, *_ in rows:
        size = len((html or "").encode())
        same = [i for i, _, h, *_ in rows if (h or "") == (html or "") and i is not None]
        first = max(same, default=None) if size >= least else page_id
        refers = first if first is not None and first != page_id else None
        out.append((page_id, size, digest(html), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def check(spark, rows, least=0):
    df = spark.createDataFrame(rows, PAGES)
    got = W.round_trip(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, least)


def test_round_trip_of_odd_payloads(spark):
    mark = W.MARK
    rows = [
        (1, "http://a", "same", None, None), (5, "http://b", "same", "x", 1), (3, None, "same", None, None),
        (None, "http://c d\r\nX: y", "same", None, None), (7, "", None, None, None), (8, "u", "", None, None),
        (9, "u", f"a{mark}b{mark}{mark}", None, None), (10, "u", "\r\n\r\n", None, None), (11, "u", "é\U0001f600" * 90000, None, None),
        (12, "u", "é\U0001f600" * 90000, None, None), (13, "u", "WARC/1.1", None, None), (14, "http://x/WARC/1.1", "\nWARC/1.1\r", None, None), (5, "http://b", "same", "x", 1),
    ]
    check(spark, rows)
    check(spark, rows, least=6)
    check(spark, [])


def test_large_payloads_are_chunks(spark):
    path = W.new_path(spark, "warc-test")
    text = "0123456789" * 50000
    W.write_archives(spark.createDataFrame([(1, "u", text, None, None)], PAGES), path)
    chunks = W.read_chunks(spark, path).orderBy("chunk").collect()
    assert len(chunks) > 5 and "".join(c.data for c in chunks) == text
    assert all(len(c.data.encode()) <= W.CHUNK_BYTES for c in chunks)
    assert len({c.record_id for c in chunks}) == 1 and [c.chunk for c in chunks] == list(range(1, len(chunks) + 1))
    row = W.read_archives(spark, path).first()
    assert row.payload_bytes == len(text)


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_archives(spark.createDataFrame([(1, "u", "hello", None, None)], PAGES), path)
    lines = spark.read.option("lineSep", W.MARK).text(path).where(F.length("value") > 4).select(F.regexp_replace("value", "hello", "hullo").alias("value"))
    lines.select(F.concat(F.lit(W.MARK), F.expr("left(value, length(value) - 2)")).alias("value")).write.option("lineSep", W.EOL).text(str(tmp_path / "bad"))
    try:
        W.read_archives(spark, str(tmp_path / "bad")).collect()
    except Exception as e:
        assert "digest" in str(e)
    else:
        raise AssertionError("a changed payload was read")


def test_chunks_end_between_characters():
    for text in ("", "é" * 40000, W.MARK * 3, "x" * 16384 + W.MARK):
        parts = list(W.chunks(text))
        assert "".join(parts) == text and len(parts) >= 1
        assert not any(W.VERSION in p for p in parts)


def test_records_have_what_the_format_asks_for(spark):
    path = W.new_path(spark, "warc-test")
    rows = [(k, f"http://h/{k}", h, None, None) for k, h in enumerate(["same", "other", "same", "x" * 100_000, "twice", "twice"])] + [(5, "http://h/5b", "twice", None, None)]
    W.write_archives(spark.createDataFrame(rows, PAGES), path, date="2024-05-06T07:08:09Z")
    records = [r[0] for r in spark.read.option("lineSep", W.MARK).text(path).collect() if r[0].strip()]
    heads = [dict(line.split(": ", 1) for line in r.partition(W.EOL * 2)[0].split(W.EOL)) for r in records]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(ids) and all(h["WARC-Date"] == "2024-05-06T07:08:09Z" and "WARC-Type" in h and "Content-Length" in h for h in heads)
    by_page = {}
    for h in heads:
        by_page.setdefault(h.get("X-Page-ID"), []).append(h)
    assert by_page["0"][0]["WARC-Refers-To"] == by_page["2"][0]["WARC-Record-ID"]
    assert "WARC-Refers-To" not in by_page["4"][0] and by_page["4"][0]["X-Refers-To-Page-ID"] == "5"
    body = next(r for r in records if "X-Page-ID: 1\r" in r).partition(W.EOL * 2)[2]
    assert body == "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 5\r\n\r\nother\r\n\r\n"
