"""WARC archives: written with one gzip member per record, read back sequentially.

Of records with equal payloads of at least LEAST bytes, that with the smallest id is the response;
the others are revisits without payload that refer to it. Smaller payloads are all responses. Rows
that repeat the smallest id are responses too. Null html is an empty payload. The payload's digest
and length stand in each record's header; a response is verified against both as it is read.

Archives are rows (name, content) of a table in the shared folder, each at most ARCHIVE_BYTES and
one record, so neither writer nor reader holds more than that. A hot payload is joined as a plain
equi-join, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import map_rows, only, written

LEAST = 100
ARCHIVE_BYTES = 4 << 20
#: The date of all records: contents depend on the input alone.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, n_bytes and refers_to (null: a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = only(pages, page_id="long", url="string", html="string").withColumn("digest", F.sha2(payload, 256)).withColumn("n_bytes", F.octet_length(payload).cast("long"))
    twice = rows.filter(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    refers = F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first"))
    return rows.join(twice, "digest", "left").withColumn("refers_to", refers).drop("first")


def record(page_id: int | None, url: str | None, html: str | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    block = HTTP + ((html or "").encode("utf-8") if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n") + packer.flush()


def write_archives(rows: DataFrame) -> DataFrame:
    """marked() rows as archives (name, content)."""

    def make() -> Callable:
        part = TaskContext.get().partitionId()
        number = 0

        def pack(columns) -> Iterator[tuple[str, bytes]]:
            nonlocal number
            held, size = [], 0
            for row in zip(*columns):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield f"part-{part:06d}-{number:06d}.warc.gz", b"".join(held)
                    number, held, size = number + 1, [], 0
            if held:
                yield f"part-{part:06d}-{number:06d}.warc.gz", b"".join(held)
                number += 1

        return pack

    return map_rows(rows.select("page_id", "url", "html", "digest", "n_bytes", "refers_to"), "name string, content binary", make)


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, decompressed incrementally one after the other."""
    at, machine, held = 0, zlib.decompressobj(31), []
    while at < len(content):
        held.append(machine.decompress(content[at : at + step]))
        at = min(at + step, len(content))
        if machine.eof:
            at -= len(machine.unused_data)
            yield b"".join(held)
            machine, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the archive ends within a member")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header and payload of a record; raises where framing or a digest is wrong."""
    cut = member.index(b"\r\n\r\n")
    first, *lines = member[:cut].decode("utf-8").split("\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = member[cut + 4 : cut + 4 + int(head["Content-Length"])]
    if not first.startswith("WARC/1.") or len(block) != int(head["Content-Length"]) or member[cut + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError(f"bad framing of {head.get('WARC-Record-ID')}")
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"bad block of {head['WARC-Record-ID']}")
    if head["WARC-Type"] == "response" and (head["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}" or len(payload) != int(head["X-Payload-Length"])):
        raise ValueError(f"bad payload of {head['WARC-Record-ID']}")
    return head, payload


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to."""
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x[10:-1])

    def read(columns):
        for (content,) in zip(*columns):
            for member in members(content):
                head, payload = parsed(member)
                kind = head["WARC-Type"]
                yield number(head["WARC-Record-ID"]), head["WARC-Target-URI"], payload if kind == "response" else None, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][7:], kind, number(head.get("WARC-Refers-To"))

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_rows(archives.select("content"), schema, lambda: read)


def warc_report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back."""
    return read_archives(written(write_archives(marked(pages)), "warc")).drop("url", "payload")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, d, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM q
"""
