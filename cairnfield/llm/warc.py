"""WARC archives as a chunked record table, written and read through Spark's text files.

An archive is a sequence of records, each ``WARC/1.1``, headers, an empty line, the block
and two line ends. A payload larger than ``chunk_bytes`` is written as WARC segments: the
first record and ``continuation`` records that carry the origin's identifier and their
number. So every row, of the writer and of the reader, is one bounded chunk. Files are
compressed as a whole, as Spark's writer does it, not record by record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm._common import dropped, new_path, small, staged

#: Fixed by the WARC format.
VERSION, EOL = "WARC/1.1", "\r\n"
MARK = VERSION + EOL

CHUNK_BYTES = 1 << 16
OUT_BYTES = 1 << 22


def _b32(digest: hashlib._Hash) -> str:
    return base64.b32encode(digest.digest()).decode()


def chunks(payload: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[str]:
    """Pieces of at most ``chunk_bytes`` UTF-8 bytes, cut between characters.

    A piece never holds the version that starts a record, so a reader may split at it: the
    payload is also cut inside each occurrence.
    """
    step = max(1, chunk_bytes // 4)
    at = 0
    while True:
        end = min(len(payload), at + step)
        if (found := payload.find(VERSION, at, end)) >= 0:
            end = found + 1
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, "payload"):
        size, digest = [], []
        for text in batch.column("payload").to_pylist():
            state, n = hashlib.sha1(), 0
            for piece in chunks(text):
                raw = piece.encode()
                state.update(raw)
                n += len(raw)
            size.append(n)
            digest.append(_b32(state))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("payload"), pa.array(size, pa.int64()), pa.array(digest, pa.string())],
            names=["page_id", "url", "payload", "payload_bytes", "digest"],
        )


#: Names of records that others refer to are made from their page and digest, below this.
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:cairnfield:warc")
#: What stands before a response's payload in its block.
HTTP = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: %d{EOL}{EOL}"


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {digest}')}>"


def record_rows(page_id: int | None, url: str | None, payload: str, size: int, digest: str, refers_to: int | None, referred: bool = False, named: bool = True, date: str = "1970-01-01T00:00:00Z") -> Iterator[str]:
    """The rows of one record: text up to its last line end, which the writer adds. A record
    that is ``referred`` to has a name made from its page and digest; a revisit states the
    name of the one it refers to if that is ``named``."""
    own = record_id(page_id, digest) if referred else f"<urn:uuid:{uuid.uuid4()}>"
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).replace(VERSION, VERSION.replace("/", "%2F")))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        if named:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        payload = ""
    number, pieces, before = 0, chunks(payload), HTTP % size
    total = size + len(before) if refers_to is None else len(before)
    piece = next(pieces)
    while piece is not None:
        number += 1
        following = next(pieces, None)
        lines = list(head) if number == 1 else ["WARC-Type: continuation", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Segment-Origin-ID: {own}"]
        if number > 1 or following is not None:
            lines.append(f"WARC-Segment-Number: {number}")
        if number > 1 and following is None:
            lines.append(f"WARC-Segment-Total-Length: {total}")
        if number == 1:
            piece = before + piece
        lines.append(f"Content-Length: {len(piece.encode())}")
        yield f"{MARK}{EOL.join(lines)}{EOL}{EOL}{piece}{EOL}"
        piece = following


def _records(date: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in small(batches, "payload"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to", "referred", "named")), strict=True):
                for text in record_rows(*row, date):
                    rows.append(text)
                    held += len(text)
                    if held >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str | None = None) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``path``.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the
    largest page_id is a response and the others are revisits of it; smaller payloads are
    all responses. Digests are updated chunk by chunk; they are worked out again where
    records are written, as that is cheaper than a copy of all payloads. The groups of equal
    payloads are reduced to counts and maxima before they are shuffled; only groups of two or
    more are staged and joined, by a join whose hot keys Spark splits. ``date`` is the
    records' WARC-Date (UTC, to the second), by default the time of the call.

    Defined cases: null html is an empty payload; a null page_id is written without a page
    header and, in a group with any page_id, refers to the largest; rows that repeat the
    largest page_id are responses too, and revisits then state its page, but no record's name; url is percent-encoded where it holds control
    characters or the version mark, and left out if null; further columns are ignored; an empty table gives
    archives without records.
    """
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    known = source.mapInArrow(_digests, "page_id long, url string, payload string, payload_bytes long, digest string")
    alike = known.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("digest").alias("same"), "page_id").agg(F.count("*").alias("n"))
    kept = staged(
        alike.groupBy("same")
        .agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))).alias("kept"), F.sum("n").alias("n"))
        .where((F.col("n") > 1) & F.col("kept").isNotNull())
        .select("same", F.col("kept.page_id").alias("kept_id"), (F.col("kept.n") == 1).alias("named")),
        "warc-groups",
    )
    large = F.col("payload_bytes") >= least_bytes
    is_kept = F.coalesce(F.col("page_id") == F.col("kept_id"), F.lit(False))
    refers = F.when(~is_kept & large, F.col("kept_id"))
    named = F.coalesce("named", F.lit(False))
    joined = known.join(kept, F.col("digest") == F.col("same"), "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("payload")).otherwise("").alias("payload"), "payload_bytes", "digest", refers.alias("refers_to"), (is_kept & large & named).alias("referred"), named.alias("named")
    )
    at = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    joined.mapInArrow(_records(at), "value string").write.option("lineSep", EOL).option("compression", "gzip").text(path)
    dropped(kept)


CHUNK_SCHEMA = "record_id string, chunk long, last boolean, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, data string"


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            if not text or not text.strip():
                continue
            head, _, rest = text.partition(EOL + EOL)
            fields = dict(line.split(": ", 1) for line in head.split(EOL))
            data = rest[: -2 * len(EOL)]
            if not rest.endswith(EOL + EOL) or len(data.encode()) != int(fields["Content-Length"]):
                raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged: its block is not {fields['Content-Length']} bytes long")
            kind, number = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1))
            first = kind != "continuation"
            if first:
                data = data.partition(EOL + EOL)[2]
            page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
            out.append((
                fields["WARC-Record-ID" if first else "WARC-Segment-Origin-ID"],
                number,
                "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields,
                int(page) if page is not None else None,
                fields.get("WARC-Target-URI"),
                kind,
                int(refers) if refers else None,
                int(fields["X-Payload-Length"]) if first else None,
                fields["WARC-Payload-Digest"].removeprefix("sha1:") if first else None,
                data,
            ))
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below ``path``: a row for each record or segment.

    Files are split at the text that starts a record. A block whose length isn't the one
    its header states raises ValueError.
    """
    return spark.read.option("lineSep", MARK).text(path).mapInArrow(_parsed, CHUNK_SCHEMA)


PAGE_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks in, a row for each record out; of a record only its digest is held."""
    head = state = None
    n = number = 0
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["chunk"] == 1:
                head, state, n, number = row, hashlib.sha1(), 0, 0
            number += 1
            if head is None or row["record_id"] != head["record_id"] or row["chunk"] != number:
                raise ValueError(f"record {row['record_id']}: chunk {row['chunk']} has no predecessor")
            raw = row["data"].encode()
            state.update(raw)
            n += len(raw)
            if row["last"]:
                if head["record_type"] != "revisit" and (n, _b32(state)) != (head["payload_bytes"], head["payload_digest"]):
                    raise ValueError(f"record {row['record_id']}: its payload doesn't have the stated length and digest")
                out.append((head["page_id"], head["url"], head["payload_bytes"], head["payload_digest"], head["record_type"], head["refers_to"]))
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, its payload checked against the stated length and digest.

    Records of one chunk are checked where they are read. Only chunks of larger records
    are dealt by record and sorted by number, and pass one at a time.
    """
    found = read_chunks(spark, path)
    whole = (F.col("chunk") == 1) & F.col("last")
    many = found.where(~whole).repartition("record_id").sortWithinPartitions("record_id", "chunk")
    return found.where(whole).mapInArrow(_verified, PAGE_SCHEMA).unionByName(many.mapInArrow(_verified, PAGE_SCHEMA))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read those back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda j: ['0000','0001','0010','0011','0100','0101','0110','0111',
      '1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(h, j, 1))]), '') AS bits,
    max(page_id) OVER (PARTITION BY h) AS kept_id
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * (substr(bits, 5 * i + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * i + 2, 1) = '1')::INT
    + 4 * (substr(bits, 5 * i + 3, 1) = '1')::INT + 2 * (substr(bits, 5 * i + 4, 1) = '1')::INT
    + (substr(bits, 5 * i + 5, 1) = '1')::INT AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept_id THEN NULL ELSE kept_id END AS refers_to
FROM b
"""
