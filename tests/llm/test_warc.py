import gzip
import hashlib
import io
import json

from pagemill.llm import warc
from pagemill.llm.common import shared_folder, written

BIG, OTHER = "<p>é</p>" * 200, "<b>" * 5000
PAGES = [
    (1, "http://a/", BIG),
    (2, "http://b/\r\nX: y", BIG),
    (3, None, BIG),
    (4, "http://c/", "small"),
    (5, "http://d/", "small"),
    (6, "http://e/", None),
    (7, "http://f/", ""),
    (8, "http://g/", OTHER + "\r\n\r\nWARC/1.1\r\n\r\n"),
    (9, "http://h/", OTHER),
    (9, "http://h/", OTHER),
    (None, "http://i/", OTHER),
]


def table(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, digest string, payload int")


def test_round_trip(spark):
    got = warc.round_trip(table(spark)).collect()
    assert len(got) == len(PAGES)
    holder = {BIG: 3, OTHER: 9}
    expected = []
    for page, url, html in PAGES:
        data = (html or "").encode()
        refers = holder.get(html) if page is not None and page < holder.get(html, 0) else None
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted(map(repr, expected)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    by_id = {r.page_id: r for r in got}
    assert by_id[3].url is None and bytes(by_id[3].payload).decode() == BIG and by_id[1].payload is None
    assert by_id[2].url == "http://b/%0D%0AX:%20y"


def test_members_and_index(spark):
    folder = shared_folder(spark, "warc-test")
    files = written(warc.write_archives(warc.shared_payloads(table(spark)).coalesce(1), f"{folder}/whole"), "files")
    (whole,) = files.collect()
    assert whole.n_records == len(PAGES)
    (normal,) = written(warc.normalise(files, f"{folder}/members"), "normal").collect()
    plain = gzip.open(whole.path.removeprefix("file:")).read()
    data = open(normal.path.removeprefix("file:"), "rb").read()
    entries = [json.loads(line) for line in open(normal["index"].removeprefix("file:"))]
    assert len(entries) == len(PAGES) and sum(e["length"] for e in entries) == len(data)
    members = [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries]
    assert b"".join(members) == plain == gzip.decompress(data)
    assert all(len(list(warc.parse_records(io.BytesIO(m)))) == 1 for m in members)


def test_empty(spark):
    assert warc.round_trip(table(spark).limit(0)).count() == 0
