import base64
import hashlib
import io

import zstandard

from tests.llm.helpers import tuples
from tilth.llm import files
from tilth.llm._shared import fresh_dir
from tilth.llm.warc import Bundle, archive_digest, look_up, parse, read_archives, record_map, write_archives

SCHEMA = "page_id long, url string, html string, digest string, path int"
ROWS = [(5, "http://a/x y\r\nz", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", "<p>é</p>"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 3_000_000), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (1, "u", "only"), (2, "a", "twice"), (2, "b", "twice"), (10, "c", "twice"), (None, "u", "only"), (None, "u", "no id"), (11, "u", "same row"), (11, "u", "same row")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def want(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and first[h or ""] < i and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert tuples(archive_digest(pages(spark)), *columns) == want(ROWS)
    assert tuples(archive_digest(pages(spark), min_bytes=9), *columns) == want(ROWS, 9)


def test_bundles_are_plain_zstandard_and_seekable(spark):
    to = fresh_dir(spark, "warc-test")
    made = write_archives(pages(spark), to, frame_bytes=100, bundle_bytes=400)
    assert len(tuples(read_archives(made), "page_id")) == len(ROWS)
    some = made.collect()
    assert len({r["path"] for r in some}) > 1
    for r in some:
        data = Bundle(r["path"]).record(r["frame"], r["offset"], r["length"])
        assert parse(data)["warc-record-id"] == r["record_id"]
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(files.read(r["path"])), read_across_frames=True).read()
        assert data in whole


def test_records_by_identifier(spark):
    to = fresh_dir(spark, "warc-test")
    write_archives(pages(spark), to)
    of = {r["page_id"]: r["record_id"] for r in record_map(spark, to).collect()}
    first, again = (parse(look_up(spark, to, of[i])) for i in (3, 9))
    assert first["payload"].decode() == "<p>é</p>" and again["warc-type"] == "revisit"
    assert again["warc-refers-to"] == of[3] == first["warc-record-id"]
    assert look_up(spark, to, "<urn:uuid:none>") is None


def test_empty(spark):
    assert archive_digest(pages(spark, [])).collect() == []
