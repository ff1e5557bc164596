"""WARC archives as a table of chunks: written, read back and checked piece by piece.

A record is a run of rows (record, chunk_no, chunk, digest so far). A payload above ``CHUNK`` bytes
becomes several WARC segments (``WARC-Segment-Number``, type ``continuation``), one per row, and the
SHA-1 state is carried from row to row, so neither writer nor reader ever builds a whole record.
Archives are gzip files made by Spark's text writer, one line per segment: they lie wherever the
given path lies, local or not, and are read by Spark's text reader, cut at the record mark. A payload
that holds the record mark itself is cut there too; the reader joins such parts again by
``Content-Length``. An archive is one gzip member (Spark's codec writes no other), so it is read as a
stream from its beginning; a record cannot be opened by its offset.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 18
MARK = "WARC/1.1\r\n"
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))
CHUNK_SCHEMA = "page_id long, chunk_no int, chunk binary, payload_bytes long, payload_digest string, is_last boolean, record_type string, refers_to long"


def payload(column: Column | str) -> Column:
    """UTF-8 bytes of a text; null as empty."""
    return F.encode(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "UTF-8")


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits are four digits of base 32."""
    hexadecimal = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_decisions(pages: DataFrame) -> DataFrame:
    """Per page ``page_id``, ``url`` (null without such a column), ``payload``, its digest, and whether it is a response or a revisit.

    Of equal payloads (length and SHA-1) the smallest page_id is the response; rows that share that
    page_id and payload are responses too. The digest groups are counted from digests alone; the
    payload then moves at most once, to the decision about its own page.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.cast("string").alias("url"), payload("html").alias("payload"))
    rows = rows.withColumns({"payload_digest": sha1_base32(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = ["payload_digest", "payload_bytes"]
    ids = rows.select("page_id", *keys)
    first = ids.groupBy(*keys).agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # Only copies need a decision: a page that is in no such group is a response by itself.
    revisits = ids.join(first, keys).where(~F.col("page_id").eqNullSafe(F.col("response"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "response")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    kind = F.when(F.col("response").isNull(), "response").otherwise("revisit")
    return rows.join(revisits, same, "left").select(*rows.columns, kind.alias("record_type"), F.col("response").alias("refers_to"))


def _base32(state) -> str:
    return base64.b32encode(state.digest()).decode()


def chunk_rows(record: int, data: memoryview, chunk: int) -> Iterator[tuple[int, bytes, str, bool]]:
    """Chunk number, bytes, digest up to here and whether it is the last, for one payload."""
    state, n, at = hashlib.sha1(), 0, 0
    while True:
        part = bytes(data[at : at + chunk])
        state.update(part)
        at, n = at + len(part), n + 1
        yield n, part, _base32(state), at >= len(data)
        if at >= len(data):
            return


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _target(url: str | None, page_id: int | None) -> str:
    """The url in visible ASCII, so that it stays one header line; a page without one is named by its id."""
    return quote(url, safe=_VISIBLE) if url else f"urn:page:{'' if page_id is None else page_id}"


def _segments(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of (page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to) as WARC segments."""
    for batch in batches:
        out, size = [], 0
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            page_id, url, data, digest, total, kind, refers = (c[i] for c in columns)
            page_id, digest, total, kind, refers = page_id.as_py(), digest.as_py(), total.as_py(), kind.as_py(), refers.as_py()
            common = f"WARC-Target-URI: {_target(url.as_py(), page_id)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Bytes: {total}\r\n"
            name = _urn(page_id, digest)
            if kind == "revisit":
                parts = [(1, b"", digest, True)]
                common += f"WARC-Refers-To: {_urn(refers, digest)}\r\nX-Refers-To-Page: {refers}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
            else:
                parts = chunk_rows(i, memoryview(data.as_buffer()), chunk)
            for n, part, so_far, last in parts:
                head = f"WARC-Type: {kind if n == 1 else 'continuation'}\r\nWARC-Record-ID: {name if n == 1 else _urn(page_id, f'{digest}:{n}')}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n{common}"
                if n == 1 and kind != "revisit":
                    head += "Content-Type: text/html; charset=utf-8\r\n"
                if n > 1 or not last:
                    head += f"WARC-Segment-Number: {n}\r\n"
                if n > 1:
                    head += f"WARC-Segment-Origin-ID: {name}\r\n"
                    if last:
                        head += f"WARC-Segment-Total-Length: {total}\r\n"
                head += f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(part).digest()).decode()}\r\nX-Digest-So-Far: {so_far}\r\nContent-Length: {len(part)}\r\n\r\n"
                out.append(MARK.encode() + head.encode() + part + b"\r\n")
                size += len(out[-1])
                if size > 8 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["segment"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["segment"])


def write(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write the archives of ``pages`` (page_id, html and, where there is one, url) to ``path`` as ``*.txt.gz`` WARC files.

    A null html is an empty payload, a null id an empty ``X-Page-Id``, a null or empty url the name ``urn:page:`` and the id.
    A repeated row is a record each time. Other columns are ignored; an empty table gives archives without records.
    """
    lines = with_decisions(pages).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to").mapInArrow(lambda b: _segments(b, chunk), "segment binary")
    # The writer ends every line by the separator: it is the last of the record's two line ends.
    lines.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows from the parts between record marks, in file order.

    Ends with an error where an archive is cut short or a digest does not fit.
    """
    fields, body, need, state = {}, bytearray(), -1, None

    def close() -> tuple:
        nonlocal need, state
        if fields["WARC-Type"] != "continuation":
            state = hashlib.sha1()
        part = bytes(body[:need])
        if body[need:] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        revisit = fields["WARC-Type"] == "revisit"
        state.update(part)
        digest, total = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Bytes"])
        number = int(fields.get("WARC-Segment-Number", 1))
        last = revisit or "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields
        so_far = digest if revisit else _base32(state)
        if so_far != fields["X-Digest-So-Far"] or last and so_far != digest:
            raise ValueError(f"digest of page {fields['X-Page-Id']} does not fit")
        need = -1
        refers, page = fields.get("X-Refers-To-Page"), fields["X-Page-Id"]
        return int(page) if page else None, number, part, total, so_far, last, "revisit" if revisit else "response", int(refers) if refers else None

    for batch in batches:
        rows, size = [], 0
        for value in batch.column(0):
            piece = value.as_buffer().to_pybytes()
            if need < 0:
                if not piece:
                    continue  # before the first mark of a file
                head, _, rest = piece.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
                body, need = bytearray(rest), int(fields["Content-Length"])
            else:
                body += MARK.encode() + piece  # the payload itself held the mark
            if len(body) >= need + 4:
                rows.append(close())
                size += len(rows[-1][2])
                if size > 8 * CHUNK:
                    yield _chunk_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _chunk_batch(rows)
    if need >= 0:
        raise ValueError("the archive ends inside a record")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64())
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives (``CHUNK_SCHEMA``); ``payload_digest`` is the digest so far.

    gzip files are not split, so the segments of a record arrive in order in one task.
    """
    parts = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("value"))
    return parts.mapInArrow(_parsed, CHUNK_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: the last chunk holds the digest and the length of the whole payload."""
    return read_chunks(spark, path).where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
