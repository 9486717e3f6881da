import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from gridloom.llm import warc

BIG, OTHER = "é" * 600, "x" * 1000
PAGES = [
    (1, "http://a", BIG),
    (2, "http://b\r\nX: y", BIG),
    (3, None, BIG),
    (4, "http://d", OTHER),
    (5, "http://e", "x" * 999),
    (6, "http://f", "x" * 999),
    (7, "http://g", None),
    (8, "http://h", ""),
    (None, "http://i", OTHER),
    (9, "http://j", "line\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 2000),
    (9, "http://j", "line\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 2000),
    (10, "http://k", "z" * 5000),
    (10, "http://k2", OTHER),
]


def test_archives_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2500)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if p is not None and (h or "").encode() == data]
        origin = max(same) if len(data) >= 1000 and same and max(same) != page else None
        want.append((page or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if origin else "response", origin or -1))
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(want)
    files = [list(warc.parsed(gzip.open(p))) for p in (tmp_path / "w").glob("archive=*/*.gz")]
    for file in files:  # a warcinfo record first, and no more records than fit
        assert [h["WARC-Type"] == "warcinfo" for h, _ in file] == [True, *[False] * (len(file) - 1)]
        assert sum(len(b) for _, b in file[1:-1]) < 2500
    assert len(files) > 2
    found = [x for file in files for x in file[1:]]
    ids = {h["WARC-Record-ID"] for h, _ in found if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in ids and b"<" not in b for h, b in found if h["WARC-Type"] == "revisit")


def test_damage_shows():
    with pytest.raises(ValueError):
        list(warc.parsed(io.BytesIO(b"no record\r\n\r\n")))
    head = {"WARC-Type": "revisit", "X-Payload-Length": "2", "WARC-Payload-Digest": "sha1:x", "WARC-Block-Digest": "sha1:y"}
    with pytest.raises(ValueError):
        warc._row(head, b"ab")


def test_clashing_columns_and_a_long_page(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ä" * 3_000_000), (2, "v", "ä" * 3_000_000)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("origin", "digest", "payload", "bytes", "__page", "value", "archive", "seq")})
    warc.write(pages, f"file://{tmp_path}/w")
    got = sorted(warc.read(spark, f"file://{tmp_path}/w").collect())
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got] == [(1, 6_000_000, "revisit", 2), (2, 6_000_000, "response", None)]


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0
