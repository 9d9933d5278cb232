"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent frames, each with whole records, and ends in a skippable frame with
the seek table: the compressed and plain size of every frame, as the public seekable format lays it
out. The record map gives, for each record identifier, the bundle, the frame and the place within the
frame's plain bytes, so one record costs one frame. It is kept beside the bundles as Parquet with a
Bloom filter on the identifier. Bundles open with any Zstandard reader.

Payloads that are equal are found by digest: pages travel to their digest as two numbers, combined
before the shuffle; only pages that revisit another come back to theirs.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm import files
from tilth.llm._shared import checkpoint, fresh_dir, join_counted, remove_dir, text_of

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "records.parquet"
MAP = "page_id long, record_id string, path string, frame int, offset long, length long"


def record_id(page_id, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{digest}')}>"


def target(url: str) -> str:
    return quote(url, safe="%/:=&?~#+!$,;@()*[]")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, refers_url: str = "") -> tuple[str, bytes]:
    """The identifier and the bytes of a page's record: a response, or a revisit where refers_to is given."""
    digest = sha1(payload)
    name = record_id(page_id, url, digest)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"Page-Id: {page_id}"] * (page_id is not None)
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"WARC-Refers-To-Target-URI: {target(refers_url)}", f"Refers-To-Page-Id: {refers_to}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower case) of one record, and its payload and the payload's full size as its HTTP header says."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = block[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return out | {"payload": payload, "payload_bytes": next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = np.array(sizes, "<u4").tobytes()
    body = entries + np.array([len(sizes)], "<u4").tobytes() + b"\0" + np.array([SEEKABLE], "<u4").tobytes()
    return np.array([SKIPPABLE, len(body)], "<u4").tobytes() + body


class Bundle:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, uri: str):
        self.system, self.path = files.at(uri)
        size = self.system.get_file_info(self.path).size
        tail = self._read(size - 9, 9)
        n, magic = int(np.frombuffer(tail, "<u4", 1)[0]), int(np.frombuffer(tail, "<u4", 1, 5)[0])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        sizes = np.frombuffer(self._read(size - 9 - 8 * n, 8 * n), "<u4").reshape(-1, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        self.plain = sizes[:, 1]
        self.last = (-1, b"")

    def _read(self, start: int, size: int) -> bytes:
        with self.system.open_input_file(self.path) as f:
            f.seek(start)
            return f.read(size)

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            import zstandard

            raw = self._read(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i]))
            self.last = i, zstandard.ZstdDecompressor().decompress(raw, max_output_size=int(self.plain[i]))
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to and refers_url of the pages whose payload another page with a smaller id has."""
    d = pages.select("page_id", "url", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest"), F.octet_length("html").alias("size")).filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
    first = d.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    met = join_counted(d.select("page_id", "digest"), first, ["digest"], d.count())
    return met.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).filter("page_id > refers_to").distinct()


def write_archives(pages: DataFrame, to: str, min_bytes: int = 0, frame_bytes: int = 512 << 10, bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes a record for each row of (page_id, url, html) into bundles below the URI `to`, and the record map beside them; returns that.

    Of equal payloads of min_bytes or more the smallest page_id is a response, others revisit it.
    Defined cases: null html and url are empty; rows that share the smallest page_id of a payload are
    all responses; a null page_id is a response and no other page refers to it; an empty table
    writes nothing; other columns are not looked at. A frame holds whole records of about frame_bytes
    or one longer record. A task sorts its pages, so a task that is run again writes the same bytes.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"), text_of("html").alias("html"))
    keyed = own.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    again = revisits(own, min_bytes).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to", "refers_url")
    joined = keyed.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level)
        part, seq = TaskContext.get().partitionId(), 0
        frames, sizes, plain, rows, map_rows = [], [], [], [], []

        def close_frame() -> None:
            raw = b"".join(plain)
            if raw:
                frames.append(press.compress(raw))
                sizes.append((len(frames[-1]), len(raw)))
                plain.clear()

        def close_bundle() -> pd.DataFrame:
            close_frame()
            path = f"{to}/part-{part:06d}-{seq:06d}.warc.zst"
            files.write(path, b"".join(frames) + seek_table(sizes))
            out = pd.DataFrame([(p, r, path, f, o, n) for p, r, f, o, n in map_rows], columns=["page_id", "record_id", "path", "frame", "offset", "length"]).astype({"page_id": "Int64"})
            for x in (frames, sizes, map_rows):
                x.clear()
            return out

        at = total = 0
        for b in batches:
            for page, url, html, refers, refers_url in zip(b["page_id"], b["url"], b["html"], b["refers_to"], b["refers_url"], strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                name, data = record(page, url, html.encode("utf-8", "surrogatepass"), refers, refers_url)
                map_rows.append((page, name, len(frames), at, len(data)))
                plain.append(data)
                at, total = at + len(data), total + len(data)
                if at >= frame_bytes:
                    close_frame()
                    at = 0
                if total >= bundle_bytes:
                    yield close_bundle()
                    seq, at, total = seq + 1, 0, 0
        if map_rows:
            yield close_bundle()

    dealt = joined.select("page_id", "url", "html", "refers_to", "refers_url").sortWithinPartitions("page_id", "url", "html")
    dealt.mapInPandas(work, MAP).write.option("parquet.bloom.filter.enabled#record_id", "true").parquet(f"{to}/{RECORDS}")
    return record_map(pages.sparkSession, to)


def record_map(spark: SparkSession, to: str) -> DataFrame:
    """The record map of the archives below `to`."""
    return spark.read.schema(MAP).parquet(f"{to}/{RECORDS}")


def look_up(spark: SparkSession, to: str, record_id: str) -> bytes | None:
    """One record by its identifier, at the cost of one frame; None if there is none."""
    place = record_map(spark, to).filter(F.col("record_id") == record_id).orderBy("path", "frame", "offset").first()
    return place and Bundle(place["path"]).record(place["frame"], place["offset"], place["length"])


def read_archives(record_map: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read at its place.

    A response's payload is read and hashed; a revisit says the size and digest of the one it stands for.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, bundle = None, None
        for b in batches:
            rows = []
            for p, frame, offset, length in zip(b["path"], b["frame"], b["offset"], b["length"], strict=True):
                if p != path:
                    path, bundle = p, Bundle(p)
                r = parse(bundle.record(frame, offset, length))
                kind, said = r["warc-type"], r["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (sha1(r["payload"]) != said or len(r["payload"]) != r["payload_bytes"]):
                    raise ValueError(f"a record in {p} is damaged")
                rows.append((r.get("page-id"), r["payload_bytes"], said, kind, r.get("refers-to-page-id")))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            for c in ("page_id", "refers_to"):
                out[c] = pd.array([None if x is None else int(x) for x in out[c]], "Int64")
            yield out

    places = record_map.select("path", "frame", "offset", "length").repartition(int(record_map.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "frame", "offset")
    return places.mapInPandas(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_digest(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives in the shared folder, reads every record back, and removes them."""
    spark = pages.sparkSession
    to = fresh_dir(spark, "warc")
    out = checkpoint(read_archives(write_archives(pages, to, min_bytes)))
    remove_dir(spark, to)
    return out
