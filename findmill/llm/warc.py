"""WARC archives from and to a chunked record table.

A payload becomes rows ``(record, chunk_no, data)`` of at most ``chunk_bytes``; each row is
one WARC record: the first chunk is the response, the further ones are its continuation
segments.  So neither writing nor reading allocates more than a chunk of an oversized
record.  Equal payloads are stored once: the record with the largest id is the response,
the others are revisits of it and carry no payload.

Archives are written by Spark's text writer (each row ends in the CRLF that closes a WARC
record) and read by its binary reader, so any store that Spark reaches will do; a file is as
large as one task's share of the shuffle.  Reading digests each chunk where it is and passes
on small rows.  Only the chunks of segmented records move: they are sorted by (record, chunk)
and one running SHA-1 is carried from chunk to chunk.

Defined results: a NULL payload is an empty one.  A NULL id is below all others and comes
back as NULL.  Rows that repeat id and payload are one response and revisits of it.  Line
ends inside a url become spaces, a NULL url has no target header.  Only the three named
columns are read, so further columns never clash.  An empty table writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findmill.session import shared_folder

#: The base 32 alphabet and the WARC version line.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "record string, chunk_no long, record_type string, refers_to string, digest string, "
    "total long, chunk_sha1 binary, chunk_bytes long, data binary"
)
RECORD_SCHEMA = (
    "record string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"
)
READ_BYTES = 1 << 16


def base32(hex_digest: Column) -> Column:
    """Base 32 of a digest in hexadecimal whose length is a multiple of five digits: four letters each."""
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def chunk_table(
    pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = 0, chunk_bytes: int = 1 << 16,
) -> DataFrame:
    """``(record, refers_to, url, digest, bytes, chunks, chunk_no, data)``: the records to write, chunk by chunk."""
    rows = pages.select(
        F.col(record_id).alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("body")
    ).withColumns({"sha": F.sha1("body"), "bytes": F.octet_length("body").cast("long")})
    large = F.col("bytes") >= min_bytes
    # a payload moves once: its copies inside a task are combined before
    last = F.max_by(F.struct("id", "url", "bytes", "body"), F.struct("id", "url"))
    responses = rows.where(large).groupBy("sha").agg(last.alias("r")).select("sha", "r.*", F.lit(1).cast("long").alias("copy"))
    copies = rows.where(large).groupBy("sha", "id", "url", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    leaders = copies.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("leader"))
    revisits = copies.join(leaders, "sha")
    first = F.when(F.struct("id", "url").eqNullSafe(F.col("leader")), 2).otherwise(1)
    revisits = revisits.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(1), F.col("copies").cast("int")), lambda k: k >= first)))
    small = rows.where(~large).groupBy("sha", "id", "url", "bytes", "body").agg(F.count(F.lit(1)).alias("copies"))
    small = small.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    columns = [F.col("url"), base32(F.col("sha")).alias("digest"), F.col("bytes")]
    nothing = F.lit(None).cast("string")
    own = [
        df.select(_name("id", "url", "copy"), nothing.alias("refers_to"), *columns, "body")
        for df in ([responses, small] if min_bytes > 0 else [responses])
    ]
    rows = revisits.select(
        _name("id", "url", "copy"), _name("leader.id", "leader.url").alias("refers_to"), *columns, F.lit(b"").alias("body")
    )
    for df in own:
        rows = rows.unionByName(df)
    rows = rows.withColumn("chunks", F.greatest(F.ceil(F.octet_length("body") / chunk_bytes), F.lit(1)).cast("int"))
    return rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.col("chunks")))).withColumn(
        "data", F.substring("body", (F.col("chunk_no") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    ).drop("body")


def _name(record_id: str, url: str, copy: str | None = None) -> Column:
    """A record's name, the same on every run: its id, its payload, its url and the number of the copy."""
    number = F.lit("1") if copy is None else F.col(copy).cast("string")
    name = F.concat_ws(":", F.coalesce(F.col(record_id).cast("string"), F.lit("")), F.col("sha"), F.hex(F.xxhash64(F.col(url))), number)
    return name.alias("record")


def write_archives(chunks: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write a chunk table as gzipped WARC files below ``path``."""
    segmented, first = F.col("chunks") > 1, F.col("chunk_no") == 1
    urn = lambda c: F.concat(F.lit("<urn:record:"), c, F.lit(">"))

    def header(name: str, value: Column, only: Column | None = None) -> Column:
        line = F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))
        return line if only is None else F.when(only, line).otherwise("")

    head = F.concat(
        F.lit(VERSION),
        header("WARC-Type", F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")),
        header("WARC-Record-ID", urn(F.when(first, F.col("record")).otherwise(F.concat("record", F.lit(":"), "chunk_no")))),
        header("WARC-Date", F.lit(date)),
        F.coalesce(header("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")), F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), first),
        F.coalesce(header("WARC-Refers-To", urn(F.col("refers_to"))), F.lit("")),
        header("WARC-Profile", F.lit(REVISIT_PROFILE), F.col("refers_to").isNotNull()),
        header("WARC-Segment-Number", F.col("chunk_no"), segmented),
        header("WARC-Segment-Origin-ID", urn(F.col("record")), ~first),
        header("WARC-Segment-Total-Length", F.col("bytes"), segmented & (F.col("chunk_no") == F.col("chunks"))),
        header("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("data"))), segmented),
        header("X-Payload-Length", F.col("bytes"), first),
        header("Content-Type", F.lit("text/html; charset=utf-8"), F.col("refers_to").isNull()),
        header("Content-Length", F.octet_length("data")),
        F.lit("\r\n\r\n"),
    )
    row = F.concat(F.encode(head, "utf-8"), F.col("data"), F.encode(F.lit("\r\n"), "utf-8")).cast("string")
    chunks.select(row.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _bare(value: str | None, prefix: str) -> str | None:
    return value.removeprefix(prefix).removesuffix(">") if value else None


def _blocks(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and content, in pieces, of each record of an open archive."""
    while line := archive.readline():
        if line == b"\r\n":
            continue
        if line.rstrip() != VERSION.encode():
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.lower()] = value.strip()
        left = int(headers["content-length"])

        def pieces():
            nonlocal left
            while left:
                piece = archive.read(min(left, READ_BYTES))
                if not piece:
                    raise ValueError("archive ends inside a record")
                left -= len(piece)
                yield piece

        content = pieces()
        yield headers, content
        for _ in content:
            pass


def _chunk(headers: dict[str, str], content: Iterator[bytes]) -> tuple:
    origin = _bare(headers.get("warc-segment-origin-id") or headers["warc-record-id"], "<urn:record:")
    number = headers.get("warc-segment-number")
    total = headers.get("warc-segment-total-length") if number else headers.get("x-payload-length")
    digest, size, kept = hashlib.sha1(), 0, []
    for piece in content:
        size += len(piece)
        digest.update(piece)
        if number:
            kept.append(piece)
    return (
        origin, int(number or 1), headers["warc-type"], _bare(headers.get("warc-refers-to"), "<urn:record:"),
        _bare(headers.get("warc-payload-digest"), "sha1:"), int(total) if total else None,
        None if number else digest.digest(), size, b"".join(kept) if number else None,
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("record", pa.string()), ("chunk_no", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("digest", pa.string()), ("total", pa.int64()), ("chunk_sha1", pa.binary()), ("chunk_bytes", pa.int64()),
        ("data", pa.binary()),
    ])
    for batch in batches:
        for content in batch.column("content"):
            raw = io.BytesIO(content.as_buffer())
            packed = raw.getbuffer()[:2] == b"\x1f\x8b"
            archive = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if packed else raw
            rows, held = [], 0
            for headers, pieces in _blocks(archive):
                rows.append(_chunk(headers, pieces))
                held += len(rows[-1][-1] or b"") + 200
                if held >= 1 << 22:
                    yield pa.record_batch([list(c) for c in zip(*rows)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of all archives below ``path``; data only of segmented records."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(
        _parse, CHUNK_SCHEMA
    )


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows sorted by (record, chunk) to records, with one running digest."""
    names = ["record", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, types)))
    current = None

    def closed():
        record, kind, refers, digest, running, size, total, whole = current
        own = base64.b32encode(running).decode()
        if kind == "revisit":
            return record, kind, refers, total, digest, True
        return record, kind, refers, size, own, whole and size == total and own == digest

    for batch in batches:
        out = []
        for record, number, kind, refers, digest, total, sha1, size, data in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or current[0] != record:
                if current is not None:
                    current[4] = current[4] if isinstance(current[4], bytes) else current[4].digest()
                    out.append(closed())
                current = [record, kind, refers, digest, sha1 if data is None else hashlib.sha1(), 0, total, number == 1]
                expected = 1
            current[7] = current[7] and number == expected
            expected += 1
            current[5] += size
            current[6] = total if total is not None else current[6]
            if data is not None:
                current[4].update(data)
        if out:
            yield pa.record_batch([list(c) for c in zip(*out)], schema=schema)
    if current is not None:
        current[4] = current[4] if isinstance(current[4], bytes) else current[4].digest()
        yield pa.record_batch([[v] for v in closed()], schema=schema)


def read_records(chunks: DataFrame) -> DataFrame:
    """``(record, record_type, refers_to, payload_bytes, payload_digest, intact)``, a row a record.

    ``intact`` is false where a segment is missing or the content does not have the digest
    or the length that its header promises.
    """
    return chunks.repartition("record").sortWithinPartitions("record", "chunk_no").mapInArrow(_carry, RECORD_SCHEMA)


def record_key(record: Column) -> Column:
    """The id in a record's name; NULL if it has none."""
    return F.nullif(F.regexp_extract(record, "^(.*):[0-9a-f]{40}:[0-9A-F]+:[0-9]+$", 1), F.lit(""))


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives (below ``path``, else in the shared folder) and read them back as records."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(chunk_table(pages, **options), path)
    return read_records(read_chunks(spark, path))
