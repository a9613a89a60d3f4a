"""Legacy archive converter (operator 5): ARC files in, WARC files out, and a WARC reader.

Archives are written by Spark's text sink (one record per row, bytes kept as they are) and read
back by its binaryFile source, so any store that Spark reads will do. Parsing runs in tasks, one
archive file after the other, decompressing as it goes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dramaturg.llm._shared import cut, shared_dir, table

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOURCE_HEADER = "X-Source-Id"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ARC_SCHEMA = (
    "source_id bigint, version int, uri string, ip string, date string, mime string, record_type string, "
    "record_id string, payload_digest string, payload_bytes bigint, block binary, head_bytes int"
)
WARC_SCHEMA = (
    "source_id bigint, record_id string, record_type string, uri string, date string, payload_digest string, "
    "payload_bytes bigint, refers_to_record string, valid boolean"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Stream:
    """Bytes of an archive, plain or in gzip members, read a piece at a time."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self._data, self._at, self._piece, self._have, self._pos = memoryview(data), 0, piece, b"", 0
        self._gzip = bytes(self._data[:2]) == b"\x1f\x8b"
        self._member = zlib.decompressobj(31) if self._gzip else None

    def _more(self) -> bool:
        if self._at >= len(self._data):
            return False
        raw = self._data[self._at: self._at + self._piece]
        self._at += len(raw)
        if self._gzip:
            out = []
            raw = bytes(raw)
            while raw:
                if self._member.eof:
                    self._member = zlib.decompressobj(31)
                out.append(self._member.decompress(raw))
                raw = self._member.unused_data
            got = b"".join(out)
        else:
            got = bytes(raw)
        self._have, self._pos = self._have[self._pos:] + got, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        start = 0
        while (end := self._have.find(b"\n", self._pos + start)) < 0:
            start = len(self._have) - self._pos
            if not self._more():
                rest, self._pos = self._have[self._pos:], len(self._have)
                return rest or None
        out, self._pos = self._have[self._pos: end], end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self._have) - self._pos < n and self._more():
            pass
        out = self._have[self._pos: self._pos + n]
        self._pos += len(out)
        return out


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, the file's own description first.

    Its version line (``1`` or ``2``) says how many fields header lines have. Fields are taken from
    the right, so that stray spaces in a URL stay in the URL. A block is exactly as long as declared.
    """
    stream, version = _Stream(data), 1
    while (line := stream.line()) is not None:
        line = line.rstrip(b"\r")
        if not line:
            continue
        described = line.startswith(b"filedesc:")
        if described:
            # the version is known only from the block, so the length is the last field either way
            length = int(line.rsplit(b" ", 1)[1])
            block = stream.take(length)
            version = int(block.split(b" ", 1)[0])
        names = ARC_FIELDS[version]
        values = line.rsplit(b" ", len(names) - 1)
        record = {n: v.decode("utf-8", "replace") for n, v in zip(names, values, strict=True)}
        if not described:
            block = stream.take(int(record["Archive-length"]))
        yield record | {"version": version, "block": block, "described": described}


def head_length(block: bytes) -> int:
    """Bytes of the HTTP head at the start of a block, its blank line included; 0 if it has none."""
    if not block.startswith(b"HTTP/"):
        return 0
    end = re.search(rb"\r?\n\r?\n", block)
    return end.end() if end else len(block)


def _header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def iso_date(date: str) -> str:
    """14 (or 12) digits as an ISO 8601 time in UTC."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def synthesised(record: dict, place: str) -> dict:
    """What WARC needs and ARC doesn't say: type, id, time and digests.

    The id is a name-based UUID of the file, URL and time, so that a task that runs again gives it
    again.
    """
    block = record["block"]
    head = head_length(block)
    uri = record["URL"]
    kind = "warcinfo" if record["described"] else "response" if head else "resource"
    number = _header_value(block[:head], SOURCE_HEADER)
    return {
        "source_id": int(number) if number and re.fullmatch(r"-?\d+", number) else None,
        "version": record["version"],
        "uri": uri,
        "ip": record["IP-address"],
        "date": iso_date(record["Archive-date"]),
        "mime": record["Content-type"],
        "record_type": kind,
        "record_id": f"urn:uuid:{uuid.uuid5(_SPACE, f'{place} {uri} {record["Archive-date"]}')}",
        "payload_digest": sha1_base32(block[head:]),
        "payload_bytes": len(block) - head,
        "block": block,
        "head_bytes": head,
    }


def warc_record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without its closing blank lines, which the sink writes."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        line = line.rstrip(b"\r")
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while line := stream.line().rstrip(b"\r"):
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        yield fields, stream.take(int(fields["content-length"]))


def write_arc(records: DataFrame, path: str, date: str = "20000101000000") -> None:
    """Write ``source_id, uri, payload`` (binary) as ARC files, versions 1 and 2 by turns of files.

    Each partition becomes one gzip file that begins with its description. A null payload is
    empty; a null URI becomes ``unknown:``; spaces in URIs are escaped.
    """

    def arc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"part-{part:05d}.arc"
        block = f"{version} 0 dramaturg\n{' '.join(ARC_FIELDS[version])}\n".encode()

        def line(uri: str, ip: str, mime: str, length: int) -> bytes:
            middle = "" if version == 1 else f" 200 - - 0 {name}"
            return f"{uri} {ip} {date} {mime}{middle} {length}\n".encode()

        first = line(f"filedesc://{name}", "0.0.0.0", "text/plain", len(block)) + block
        for batch in batches:
            out = [first] if first else []
            first = b""
            for source, uri, payload in zip(batch["source_id"], batch["uri"], batch["payload"], strict=True):
                payload = payload or b""
                number = "" if pd.isna(source) else str(int(source))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{SOURCE_HEADER}: {number}\r\n\r\n".encode()
                uri = re.sub(r"\s", "%20", uri or "unknown:")
                out.append(line(uri, "0.0.0.0", "text/html", len(head) + len(payload)) + head + payload)
            yield pd.DataFrame({"value": out})

    rows = records.select(F.col("source_id").cast("string").alias("source_id"), "uri", "payload").mapInPandas(arc, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ARC files under ``path``, with what WARC needs beside."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for n, record in enumerate(parse_arc(content)):
                    rows.append(synthesised(record, f"{name.rsplit('/', 1)[-1]} {n}"))
                    size += len(record["block"])
                    if size > 8 << 20:
                        yield _frame(rows, "source_id")
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, "source_id")

    return _files(spark, path).mapInPandas(read, ARC_SCHEMA)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _frame(rows: list[dict], *whole: str) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for name in whole:
        out[name] = out[name].astype("Int64")
    return out


def first_of_equals(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``target``: of equal payloads, the record with the largest source id; null for itself.

    Rows are combined on the map side by digest; records of one hot payload meet as one row a task.
    Payloads smaller than ``least_bytes`` and records that are no response have no target.
    """
    able = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)
    best = F.max(F.struct("source_id", "record_id", "uri", "date")).alias("target")
    # only digests are grouped; a payload's length is part of the key
    tops = records.filter(able).groupBy("payload_digest", "payload_bytes").agg(best, F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    out = records.join(tops.drop("copies"), ["payload_digest", "payload_bytes"], "left")
    return out.withColumn("target", F.when(able & (F.col("target.record_id") != F.col("record_id")), F.col("target")))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (of :func:`read_arc`, with ``target``) as gzip WARC files, a warcinfo first in each."""

    def warc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        about = b"software: dramaturg\r\nformat: WARC File Format 1.1\r\n"
        own = f"urn:uuid:{uuid.uuid5(_SPACE, f'warcinfo {part}')}"
        first = warc_record("warcinfo", [("WARC-Record-ID", f"<{own}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], about)
        for batch in batches:
            out = [first] if first else []
            first = b""
            for r in batch.itertuples(index=False):
                block, kind, more = r.block, r.record_type, []
                if isinstance(r.target_record, str):
                    block, kind = block[: r.head_bytes], "revisit"
                    more = [
                        ("WARC-Profile", REVISIT_PROFILE),
                        ("WARC-Refers-To", f"<{r.target_record}>"),
                        ("WARC-Refers-To-Target-URI", r.target_uri),
                        ("WARC-Refers-To-Date", r.target_date),
                    ]
                fields = [
                    ("WARC-Record-ID", f"<{r.record_id}>"),
                    ("WARC-Date", r.date),
                    ("WARC-Target-URI", r.uri),
                    ("WARC-IP-Address", r.ip),
                    ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
                    ("WARC-Payload-Digest", f"sha1:{r.payload_digest}"),
                    *more,
                    ("Content-Type", "application/http; msgtype=response" if r.head_bytes else r.mime),
                ]
                out.append(warc_record(kind, fields, block))
            yield pd.DataFrame({"value": out})

    flat = records.filter("record_type != 'warcinfo'").select(
        "uri", "ip", "date", "mime", "record_type", "record_id", "payload_digest", "block", "head_bytes",
        F.col("target.record_id").alias("target_record"), F.col("target.uri").alias("target_uri"), F.col("target.date").alias("target_date"),
    )
    rows = flat.mapInPandas(warc, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files under ``path`` but the files' own descriptions.

    ``valid`` says whether the block and, in a response, the payload have the declared digests.
    Of a revisit, ``payload_bytes`` is what the kept HTTP head declares.
    """

    def bare(value: str | None) -> str | None:
        return value.strip("<>") if value else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for fields, block in parse_warc(content):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head = head_length(block)
                    number = _header_value(block[:head], SOURCE_HEADER)
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    revisit = kind == "revisit"
                    rows.append({
                        "source_id": int(number) if number else None,
                        "record_id": bare(fields["warc-record-id"]),
                        "record_type": kind,
                        "uri": fields.get("warc-target-uri"),
                        "date": fields.get("warc-date"),
                        "payload_digest": digest,
                        "payload_bytes": int(_header_value(block[:head], "Content-Length") or 0) if revisit else len(block) - head,
                        "refers_to_record": bare(fields.get("warc-refers-to")),
                        "valid": fields.get("warc-block-digest") == f"sha1:{sha1_base32(block)}" and (revisit or sha1_base32(block[head:]) == digest),
                    })
                if rows:
                    yield _frame(rows, "source_id")

    return _files(spark, path).mapInPandas(read, WARC_SCHEMA)


def convert(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload: Column | None = None) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the WARC files read back.

    Defined results: null payloads are empty; equal empty payloads revisit each other as others
    do; pages with a null URL get the URI ``unknown:``; of rows that repeat id and payload one is the response. An empty table gives an
    empty result. Records are in no order.
    """
    spark = pages.sparkSession
    place = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    payload = F.col("html").cast("binary") if payload is None else payload
    write_arc(pages.select(F.col(id_col).alias("source_id"), F.col(url_col).alias("uri"), payload.alias("payload")), f"{place}/arc")
    write_warc(first_of_equals(read_arc(spark, f"{place}/arc")), f"{place}/warc")
    return read_warc(spark, f"{place}/warc")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut(convert(table(spark, sf_dir, "pages")))
    targets = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("source_id").alias("refers_to"))
    return records.join(targets, "refers_to_record", "left").select(
        F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"
    )


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex,
    max(page_id) OVER (PARTITION BY body) AS top FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(0, 40), lambda i: format('{:04b}', instr('0123456789abcdef', hex[i + 1]) - 1)), '') AS bits FROM h
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j: CAST(bits[i * 5 + j + 1] AS INT) * CAST(power(2, 4 - j) AS INT)))::INT]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
  true AS valid
FROM b
"""
