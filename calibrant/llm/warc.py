"""WARC archives with an index: write records, index them, read selected records back by coalesced byte ranges.

Every task writes archives of its own, each record as a gzip member, and gives
an index row per record: archive, offset, length, URL and digest. The index is
stored as a table before anything is read. A task that is tried again writes
new archives; the index that Spark commits never names the abandoned ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import BROADCAST_IDS, arrow_map, shared_path, stored

ARCHIVE_BYTES = 64 << 20
#: Ranges closer than GAP are read at once, up to SPAN bytes.
GAP = 64 << 10
SPAN = 8 << 20
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC 1.1 standard

INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
INDEX_SQL = "archive string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint"
READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
READ_SQL = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record. A revisit carries the HTTP head alone, and the payload's length in a field of its own."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What one whole record says; the digest and length of a response are those of the bytes read."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its block")
    _, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if k in fields else None
    out = {"page_id": number("x-page-id"), "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page-id")}
    claimed = fields["warc-payload-digest"].removeprefix("sha1:")
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": number("x-payload-length"), "payload_digest": claimed}
    if base32_sha1(payload) != claimed:
        raise ValueError(f"payload of page {out['page_id']} does not match its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": claimed}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_warc(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write a record per row of pages into archives in the shared folder; returns the stored index of them.

    The payload is the column in UTF-8, null an empty one. Payloads are equal when their SHA-256 digests are; the records
    carry SHA-1, as is usual, of which collisions are known. Of rows with equal payloads of revisit_bytes or more, the
    one with the largest id is the response and the others revisit it; a row with a null id is a response. A
    repeated row gives a record each time; where it has the largest id, each is a response. Blanks and control
    characters of a URL are percent-encoded, a null or empty URL is urn:none (the index has the URL as it was).
    Other columns aren't read.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[payload], F.lit("")).alias("payload"))
    sha1, sha256 = F.unhex(F.sha1(F.encode("payload", "utf-8"))), F.unhex(F.sha2(F.encode("payload", "utf-8"), 256))
    narrow = stored(rows.select("page_id", sha256.alias("sha"), F.octet_length("payload").alias("size")), "warc-digests")
    large = narrow.where(F.col("size") >= revisit_bytes)
    keep = stored(large.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-keep")
    n_keep = keep.count()
    revisits = stored(large.join(F.broadcast(keep) if n_keep <= BROADCAST_IDS // 4 else keep, "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct(), "warc-revisits")
    if revisits.count() <= BROADCAST_IDS // 4:  # 25 MB
        revisits = F.broadcast(revisits)
    marked = rows.withColumn("sha", sha256).withColumn("sha1", sha1).join(revisits, ["page_id", "sha"], "left")
    where = shared_path(spark, "warc-archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(where)
        store.create_dir(base, recursive=True)
        out = name = None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = row["payload"].encode()
                digest = base64.b32encode(row["sha1"]).decode()
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(row["page_id"], row["url"], data, digest, row["refers_to"], date)) + packer.flush()
                made.append({"archive": f"{where}/{name}", "offset": out.tell(), "length": len(member), "page_id": row["page_id"], "url": row["url"], "payload_digest": digest, "payload_bytes": len(data), "record_type": "response" if row["refers_to"] is None else "revisit", "refers_to": row["refers_to"]})
                out.write(member)
                if out.tell() >= archive_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist(made, schema=INDEX)
        if out is not None:
            out.close()

    return stored(arrow_map(marked.select("page_id", "url", "payload", "sha1", "refers_to"), write, INDEX_SQL), "warc-index")


def ranges(records: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """Coalesce (offset, length) sorted by offset: (start, end, first record, record after the last)."""
    out: list[tuple[int, int, int, int]] = []
    for k, (offset, length) in enumerate(records):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= span:
            start, end, first, _ = out[-1]
            out[-1] = (start, max(end, offset + length), first, k + 1)
        else:
            out.append((offset, offset + length, k, k + 1))
    return out


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records that index names: page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    payload (null for revisits, or without payloads). Each archive's records are read in order of offset, near ones
    by one range read; a response whose bytes don't match its digest raises. An empty index gives no rows."""
    spark = index.sparkSession
    wanted = index.select("archive", "offset", "length", "page_id", "url")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = source = None
        for batch in batches:
            rows = batch.to_pylist()
            start = 0
            while start < len(rows):
                stop = next((k for k in range(start, len(rows)) if rows[k]["archive"] != rows[start]["archive"]), len(rows))
                if rows[start]["archive"] != name:
                    name = rows[start]["archive"]
                    store, path = _open(name)
                    source = store.open_input_file(path)
                group = rows[start:stop]
                for begin, end, first, after in ranges([(r["offset"], r["length"]) for r in group]):
                    data = source.read_at(end - begin, begin)
                    made = []
                    for r in group[first:after]:
                        at = r["offset"] - begin
                        got = parse(zlib.decompress(data[at : at + r["length"]], 31))
                        if got["page_id"] != r["page_id"]:
                            raise ValueError(f"{name} at {r['offset']}: page {got['page_id']}, the index says {r['page_id']}")
                        got["payload"] = got["payload"].decode() if payloads and got["payload"] is not None else None
                        made.append(got | {"url": r["url"]})
                    yield pa.RecordBatch.from_pylist(made, schema=READ)
                start = stop

    return arrow_map(wanted.repartition(parts, "archive").sortWithinPartitions("archive", "offset"), read, READ_SQL)
