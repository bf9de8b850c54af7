import hashlib

import pyarrow.fs as pafs
import zstandard

from gondola.llm import warc
from tests.llm.frames import pages

BIG = "<p>" + "x" * 200
ROWS = [(3, "http://a/1", BIG), (1, "http://a/2", BIG), (1, "http://a/2", BIG), (None, None, None), (5, "u\r\nv", ""), (6, "http://b", "short"), (7, "http://b", "short"), (8, "http://c", "é" * 300_000), (None, "http://a/9", BIG)]


def test_round_trip_and_revisits(spark):
    index, folder = warc.write_warc(pages(spark, ROWS), frame_bytes=100_000)
    rows = warc.read_warc(index, folder).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["page_id"]: r for r in rows if r["page_id"] is not None}
    for page_id, _, html in ROWS:
        if page_id is not None:
            data = (html or "").encode()
            r = by_id[page_id]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == data and r["refers_to"] is None
    assert by_id[3]["record_type"] == "revisit" and by_id[3]["refers_to"] == 1 and by_id[3]["payload"] is None
    assert {by_id[k]["record_type"] for k in (1, 5, 6, 7, 8)} == {"response"}
    assert sorted((r["record_type"], r["refers_to"]) for r in rows if r["page_id"] is None) == [("response", None), ("revisit", 1)]


def test_frames_stand_alone_and_the_seek_table_finds_them(spark):
    index, folder = warc.write_warc(pages(spark, [(k, f"http://h/{k}", f"<p>{k}" * 500) for k in range(60)]).coalesce(1), frame_bytes=20_000)
    store, path = pafs.FileSystem.from_uri(folder)
    found = index.collect()
    assert len({(r["bundle"], r["frame"]) for r in found}) > 3
    r = max(found, key=lambda r: (r["frame"], r["offset"]))
    file = store.open_input_file(f"{path}/{r['bundle']}")
    start, packed, unpacked = warc.read_seek_table(file)[r["frame"]]
    file.seek(start)
    raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=unpacked)
    assert warc.parse_record(raw[r["offset"] : r["offset"] + r["length"]])["page_id"] == r["page_id"]


def test_empty_table(spark):
    index, folder = warc.write_warc(pages(spark, [(1, "u", "h")]).where("false"))
    assert warc.read_warc(index, folder).count() == 0
