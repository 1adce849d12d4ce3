"""WARC archives: deduplicating writer, monolithic-gzip normaliser, reader by sidecar index.

plan_records() marks each page as response or revisit: of pages with equal payloads of at least
min_bytes, the smallest page_id is the response. write_archives() streams each partition into one
archive compressed as a single gzip stream, as crawls often arrive. normalise() inflates such a
stream once, front to back, and rewrites every record as a gzip member of its own, with a sidecar
index of offsets; read_records() seeks to the members by that index.

Defined results: a null payload is empty; a null page_id is written without a number and counts as
larger than any; equal page_ids with equal payloads are each a response; null and strange URLs are
percent-encoded or replaced; other columns are ignored; an empty table gives no archives. Payloads
are streamed through the normaliser in parts, so a record may be larger than a buffer.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronq.llm import storage
from heronq.llm.common import arrow_map, batch, settle, shared_dir

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
END = b"\r\n\r\n"
RECORD_ID = "<urn:heronq:page:{}>"
CHUNK = 1 << 16
LEVEL = 6


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, payload, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # digests without payloads, written out: few are broadcast by the engine, and of many a hot one can be split in the join
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = settle(firsts.where("n > 1").select("digest", "first"), "firsts")
    same = F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", F.when(~same, F.col("first")).alias("refers_to"))


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed."""
    revisit = refers_to is not None
    block = HTTP_HEAD.format(len(payload)).encode()
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": RECORD_ID.format("" if page_id is None else page_id),
        "WARC-Target-URI": quote(url or "urn:heronq:none", safe=":/?#[]@!$&'()*+,;=%~-._"),
        "WARC-Date": date,
        "WARC-Payload-Digest": "sha1:" + bare_digest(payload),
        "X-Payload-Length": len(payload),
    }
    if revisit:
        head |= {"WARC-Refers-To": RECORD_ID.format(refers_to), "WARC-Profile": PROFILE}
    else:
        block += payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + END


def parse_head(raw: bytes) -> dict[str, str]:
    """Fields of a record's head, names in lower case."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class Inflated:
    """The plain bytes of a gzip stream of one or more members, read once from front to back."""

    def __init__(self, stream):
        self.stream, self.held, self.ended = stream, bytearray(), False
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.ended:
            raw = self.inflate.unconsumed_tail or self.inflate.unused_data or self.stream.read(CHUNK)
            if self.inflate.eof:
                while not (raw := raw.lstrip(b"\0")):  # padding between or after members
                    if not (raw := self.stream.read(CHUNK)):
                        self.ended = True
                        return False
                self.inflate = zlib.decompressobj(31)
            elif not raw:
                raise EOFError("the gzip stream is cut off")
            got = self.inflate.decompress(raw, 4 * CHUNK)
            if got:
                self.held += got
                return True
        return False

    def head(self) -> bytes | None:
        """The bytes up to and with the next blank line, or None at the end."""
        at = 0
        while (end := self.held.find(END, at)) < 0:
            at = max(0, len(self.held) - 3)
            if not self._more():
                if bytes(self.held).strip():
                    raise EOFError("the archive ends inside a record's head")
                return None
        return self._take(end + 4)

    def _take(self, n: int) -> bytes:
        got = bytes(self.held[:n])
        del self.held[:n]
        return got

    def parts(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.held and not self._more():
                raise EOFError("the archive ends inside a block")
            got = self._take(min(n, len(self.held)))
            n -= len(got)
            yield got


def normalise_stream(source, out, level: int = LEVEL) -> list[tuple[int, int, str, str]]:
    """Rewrites a gzip stream of records as one member a record -> (offset, length, record id, type) of each."""
    plain, index, at = Inflated(source), [], 0
    while (raw := plain.head()) is not None:
        raw = raw.lstrip(b"\r\n")
        head = parse_head(raw)
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        size = 0

        def put(b: bytes) -> int:
            if b:
                out.write(b)
            return len(b)

        size += put(pack.compress(raw))
        for part in plain.parts(int(head["content-length"])):
            size += put(pack.compress(part))
        if b"".join(plain.parts(4)) != END:
            raise ValueError(f"no blank lines after record {head.get('warc-record-id')}")
        size += put(pack.compress(END)) + put(pack.flush())
        index.append((at, size, head.get("warc-record-id", ""), head.get("warc-type", "")))
        at += size
    return index


_ARCHIVES = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("index_path", pa.string())])


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL) -> DataFrame:
    """(page_id, url, payload, refers_to) -> manifest (path, n_records); each partition becomes one gzip stream."""

    def run(batches):
        out = None
        for b in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, n, pack = storage.attempt_path(folder, "crawl", ".warc.gz"), 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                    out = storage.open_out(path)
                out.write(pack.compress(record(page, url, payload, refers, date)))
                n += 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield batch(_ARCHIVES, [path], [n], [None])

    return settle(arrow_map(records.select("page_id", "url", "payload", "refers_to"), run, "path string, n_records long, index_path string"), "archives")


def _each_path(manifest: DataFrame) -> DataFrame:
    return manifest.select("path", "n_records", "index_path").repartition(max(1, manifest.count()), "path")


def normalise(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """manifest of archives -> manifest of archives with a member for each record, and their index files."""

    def run(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                path = storage.attempt_path(folder, "records", ".warc.gz")
                with storage.open_in(source) as f, storage.open_out(path) as out:
                    index = normalise_stream(f, out, level)
                with storage.open_out(path + ".idx") as out:
                    for offset, length, name, kind in index:
                        out.write(json.dumps({"offset": offset, "length": length, "id": name, "type": kind}).encode() + b"\n")
                yield batch(_ARCHIVES, [path], [len(index)], [path + ".idx"])

    return settle(arrow_map(_each_path(manifest), run, "path string, n_records long, index_path string"), "normalised")


_RECORDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def read_member(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Head and block of the record in a member."""
    plain = zlib.decompress(raw, 31)
    end = plain.index(END) + 4
    head = parse_head(plain[:end])
    return head, plain[end : end + int(head["content-length"])]


def read_records(manifest: DataFrame) -> DataFrame:
    """Normalised archives -> one row a record; a response's digest and length are taken from its payload and must match its head."""

    def run(batches):
        for b in batches:
            for path, index_path in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                with storage.open_in(index_path) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with storage.open_in(path) as f:
                    for x in index:
                        f.seek(x["offset"])
                        head, block = read_member(f.read(x["length"]))
                        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if head["warc-type"] == "response":
                            payload = block[block.index(END) + 4 :]
                            if (bare_digest(payload), len(payload)) != (digest, size):
                                raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                        rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), head["warc-target-uri"], digest, size, path, x["offset"], x["length"]))
                        if len(rows) >= 2048:
                            yield batch(_RECORDS, *zip(*rows))
                            rows = []
                if rows:
                    yield batch(_RECORDS, *zip(*rows))

    return arrow_map(_each_path(manifest), run, "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes long, path string, offset long, length long")


_NUMBER = re.escape(RECORD_ID).replace(r"\{\}", r"(-?\d+)")


def page_number(column: str):
    """The page_id in a record id of this module."""
    return F.regexp_extract(column, _NUMBER, 1).try_cast("long")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes, normalises and reads back: (page_id, payload_bytes, payload_digest, record_type, refers_to and places)."""
    spark = pages.sparkSession
    whole, single = shared_dir(spark) + "/whole", shared_dir(spark) + "/records"
    manifest = normalise(write_archives(plan_records(pages, min_bytes), whole), single)
    drop_folder(spark, whole)
    got = read_records(manifest)
    return got.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"), "path", "offset", "length")


def drop_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
