"""Operator 3, WARC: seekable Zstandard bundles with an index of records.

`write_bundles` groups WARC/1.1 records into independent Zstandard frames of about
`frame_bytes`, closes each bundle with a seek table in a skippable frame (the layout of the
public seekable format: one pair of sizes a frame, then a nine-byte footer), and returns the
index: for every record its bundle, frame, and offset and length within the frame, once
decompressed. `read_records` uses nothing but index and bundles: it finds the frame through
the footer, decompresses that frame alone and cuts the records out.

Payload: the html in UTF-8, a null one empty. Of records with equal payloads of at least
`revisit_from` bytes, those with the smallest id are responses; all others are revisits that
name it and store the HTTP header only. Rows that repeat the smallest id are responses too.
Null ids sort as absent: a group of null ids only has no response to name, so all are
responses. Ties do not arise: equal payloads are told apart by id alone. Empty tables give an
empty index and no bundle. Other columns may have any names; they are not read.

A frame holds whole records and a writer holds one frame, so memory is bounded by the frame
size or the largest record; a very long payload has a frame of its own. Bundles get names of their own for every attempt, under a
temporary name until complete; the index names what the successful attempt wrote. Payloads
with very many copies are spread over tasks by a salt.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, salted_lookup, settle, table

#: Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
INDEX = "page_id long, bundle string, frame int, offset long, length long"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}')}>"


def render(page_id, url, payload: bytes, digest: str, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record. refers_to: the response's id for a revisit, else None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def parse(record: bytes) -> dict:
    """The fields of one record and its payload; raises where lengths or digests do not hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("no WARC record here")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
    if f["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload's digest does not hold")
    number = lambda x: int(x) if x else None
    return {"page_id": number(f["x-page-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": f["warc-type"], "refers_to": number(f.get("x-refers-to-page-id", "")), "url": f.get("warc-target-uri"), "payload": payload}


class Bundle:
    """Writes one bundle."""

    def __init__(self, folder: str, level: int):
        import zstandard

        self.fs, root = _store(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}.warc.zst"
        self.uri = f"{folder}/{self.path.rpartition('/')[2]}"
        self.out, self.zip = self.fs.open_output_stream(f"{self.path}.part"), zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.written = 0

    def add(self, frame: bytes) -> None:
        data = self.zip.compress(frame)
        self.out.write(data)
        self.sizes.append((len(data), len(frame)))
        self.written += len(data)

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of each frame, from the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, at, out = f.read_at(8 * count, size - 9 - 8 * count), 0, []
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes the bundles and returns their index, itself a table in the shared folder."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("html"))
    base = base.withColumn("digest", F.sha1("html"))
    groups = base.where(F.octet_length("html") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    rows = salted_lookup(base, groups, "digest", "n", F.col("page_id"))
    rows = rows.select("page_id", "url", "html", "digest", F.when((F.octet_length("html") >= revisit_from) & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))

    def write(batches):
        import pyarrow as pa

        bundle, frame, held, index = None, [], 0, []

        def flush(last: bool):
            nonlocal bundle, frame, held
            if frame:
                bundle.add(b"".join(frame))
                frame, held = [], 0
            if bundle and (last or bundle.written >= bundle_bytes):
                bundle.close()
                bundle = None
                done, index[:] = pd.DataFrame(index, columns=["page_id", "bundle", "frame", "offset", "length"]).astype({"page_id": "Int64"}), []
                return [pa.RecordBatch.from_pandas(done, preserve_index=False, schema=pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))]
            return []

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, digest, to = (batch.column(c)[k].as_py() for c in range(5))
                record = render(page_id, url, html, base64.b32encode(bytes.fromhex(digest)).decode(), to)
                if held and held + len(record) > frame_bytes:
                    yield from flush(False)
                bundle = bundle or Bundle(folder, level)
                index.append((page_id, bundle.uri, len(bundle.sizes), held, len(record)))
                frame.append(record)
                held += len(record)
        yield from flush(True)

    return settle(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """What the archives say of every record of the index."""
    # The index is small beside the archives: the number of bundles, not its bytes, says how many tasks to use.
    bundles = index.agg(F.count_distinct("bundle")).first()[0]
    frames = index.repartition(max(1, bundles), "bundle").groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length", "page_id")).alias("records"))

    def read(batches):
        import pyarrow as pa
        import zstandard

        known, unzip = ("", None, None), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in batch.to_pylist():
                if known[0] != part["bundle"]:
                    store, path = _store(part["bundle"])
                    f = store.open_input_file(path)
                    known = (part["bundle"], f, seek_table(f, f.size()))
                at, packed, plain = known[2][part["frame"]]
                data = unzip.decompress(known[1].read_at(packed, at), max_output_size=plain)
                found = [parse(data[r["offset"] : r["offset"] + r["length"]]) for r in part["records"]]
                if any(x["page_id"] != r["page_id"] for x, r in zip(found, part["records"])):
                    raise ValueError("the index names another record")
                yield pa.RecordBatch.from_pydict({k: pa.array([x[k] for x in found], t) for k, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))})

    return frames.mapInArrow(read, FOUND)


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_bundles(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc")))


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
q as (select *, min(page_id) over (partition by hex) as first_id from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from q
"""
