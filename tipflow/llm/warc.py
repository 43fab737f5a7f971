"""Operator 5: WARC archives, written and read by tasks.

* Writer: one gzip member for each record; response records hold an HTTP header and the payload,
  revisit records (equal payload, by SHA-1 digest) only the HTTP header.  A task writes archives of about
  ``ARCHIVE_BYTES`` under names of its own attempt and returns their paths: a lost or repeated
  attempt leaves files that no manifest names.
* Reader: sequential and incremental.  It inflates one member after the other from chunks of the
  file, splits the header off, takes as many bytes as Content-Length says, and verifies the
  digests of block and payload while they pass, so memory stays bounded however long a record is.

Archives live in the shared folder and are opened through ``pyarrow.fs``, which takes a local
path or the URI of any store that it supports.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.llm.common import shared_path, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
_ID = "urn:x-page:"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``, as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    fields += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block))]
    return _member(fields, "application/http; msgtype=response", block)


def _member(fields, content_type: str, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Type", content_type), ("Content-Length", len(block))])
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _info(name: str) -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                    ("WARC-Filename", name)], "application/warc-fields", b"format: WARC File Format 1.1\r\n")


class _Bytes:
    """Inflated bytes of consecutive gzip members; ``members`` counts those begun."""

    def __init__(self, stream):
        self.stream, self.raw, self.held, self.unpack, self.members = stream, b"", b"", None, 0

    def begin(self) -> bool:
        """Open the next member; False at the end of the file."""
        self.raw = self.raw or self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.unpack, self.held, self.members = zlib.decompressobj(31), b"", self.members + 1
        return True

    def more(self) -> bytes:
        """The next inflated bytes of this member; empty at its end."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.unpack.eof:
            data = self.unpack.unconsumed_tail or self.raw or self.stream.read(CHUNK)
            if not data:
                raise ValueError(f"member {self.members}: the file ends inside it")
            if not self.unpack.unconsumed_tail:
                self.raw = b""
            out = self.unpack.decompress(data, CHUNK)
            if self.unpack.eof:
                self.raw = self.unpack.unused_data
            if out:
                return out
        return b""

    def head(self, what: str) -> bytes:
        """Up to the first blank line; a header is as long as its URL makes it."""
        got, seen = bytearray(), 0
        while (end := got.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(got)
            part = self.more()
            if not part:
                raise ValueError(f"member {self.members}: {what} without end")
            got += part
        self.held = bytes(got[end + 4:])
        return bytes(got[:end])

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes."""
        while n:
            part = self.more()
            if not part:
                raise ValueError(f"member {self.members}: shorter than its Content-Length")
            part, self.held = part[:n], part[n:] + self.held
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _hex(digest: str) -> str:
    name, _, value = digest.partition(":")
    if name.lower() != "sha1":
        raise ValueError(f"unknown digest {name}")
    return base64.b32decode(value).hex()


def records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """Records of an archive in order: fields, payload digest, size, and whether the digests hold.

    Damaged framing (cut members, wrong Content-Length, missing headers) raises ValueError.
    """
    data = _Bytes(stream)
    while data.begin():
        head = data.head("header")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"member {data.members}: no WARC record")
        fields = _fields(head)
        length = int(fields["content-length"])
        block, payload, size, parts = hashlib.sha1(), hashlib.sha1(), 0, []
        http, pending = None, b""
        for part in data.take(length):
            block.update(part)
            if http is None:
                pending += part
                if b"\r\n\r\n" not in pending[max(0, len(pending) - len(part) - 3):]:
                    continue
                first, _, part = pending.partition(b"\r\n\r\n")
                http = _fields(first)
            payload.update(part)
            size += len(part)
            if keep_payload:
                parts.append(part)
        if b"".join(data.take(4)) != b"\r\n\r\n" or data.more():
            raise ValueError(f"member {data.members}: it does not end after its block")
        kind = fields["warc-type"]
        valid = "warc-block-digest" not in fields or _hex(fields["warc-block-digest"]) == block.hexdigest()
        digest = _hex(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
        if kind == "response":
            valid = valid and digest == payload.hexdigest() and int((http or {}).get("content-length", -1)) == size
        yield {"type": kind, "fields": fields, "http": http or {}, "digest": digest, "size": size, "valid": valid,
               "payload": b"".join(parts) if keep_payload else None}


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(_ID)
    return int(text) if text else None


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``pages (page_id, url, html, refers_to)``: (path, records, bytes), one row an archive."""
    folder = shared_path(pages.sparkSession, "warc")

    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, name, number, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, ref in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    number, size = 0, out.write(_info(name))
                html = html.as_py()
                size += out.write(record(page_id.as_py(), url.as_py(), (html or "").encode(), ref.as_py()))
                number += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", number, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", number, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "bytes"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def read(archives: DataFrame, keep_payload: bool = False, strict: bool = False) -> DataFrame:
    """Page records of ``archives (path)``: (page_id, record_type, refers_to, url, payload_digest, payload_bytes,
    valid, payload).  A revisit's size is the Content-Length of its HTTP header.  One task reads an archive.  ``strict`` fails on a record
    that is not valid."""
    names = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "valid", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in records(stream, keep_payload):
                        if strict and not r["valid"]:
                            raise ValueError(f"{path}: record {r['fields'].get('warc-record-id')}: digest or length do not hold")
                        if r["type"] in ("response", "revisit"):
                            f = r["fields"]
                            rows.append((_page(f["warc-record-id"]), r["type"], _page(f.get("warc-refers-to")),
                                         f.get("warc-target-uri"), r["digest"],
                                         int(r["http"]["content-length"]) if r["type"] == "revisit" else r["size"],
                                         r["valid"], r["payload"]))
                            size += len(r["payload"] or b"")
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    each = archives.select("path").repartition(max(1, archives.count()), "path")
    return each.mapInArrow(run, "page_id long, record_type string, refers_to long, url string, payload_digest string, "
                                "payload_bytes long, valid boolean, payload binary")


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): pages with equal payloads of ``least`` bytes or more refer to the
    largest page_id among them; that one, smaller payloads and groups of null page_ids alone do not."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                        F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    # only digests that come more than once travel; the pages meet them in a join that Spark may split
    copies = (rows.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("_digest"))
              .agg(F.max("page_id").alias("_last"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(copies, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"))


def archive(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages (page_id, url, html)`` and read the archives back: the columns of ``read``.

    Fails on a record whose digest or length does not hold.

    A null html is an empty payload, a null url is left out of the record, a null page_id stays null
    (and revisits its group's largest page_id).  Rows that repeat the largest page_id of their group
    are responses all.  Each row gives a record.  Other columns are not read.  An empty table gives
    no archive and an empty result.
    """
    return read(written(write(with_revisits(pages, least)), "archives"), strict=True)


def oracle_sql(least: int = REVISIT_BYTES) -> str:
    return f"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body))::bigint as payload_bytes, sha1(body) as payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest) as latest from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {least} and page_id <> latest then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {least} and page_id <> latest then latest end as refers_to
from g
"""
