import base64
import gzip
import hashlib
import io

import pytest

from pricewell.llm.warc import archive_round_trip, member, publish, read_archives, read_records, record, with_revisits, write_archives


def slow(rows, min_bytes=0):
    first = {}
    for k, h in rows:
        b = (h or "").encode()
        if k is not None and len(b) >= min_bytes:
            first[b] = min(first.get(b, k), k)
    out = []
    for k, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= min_bytes else None
        later = f is not None and (k is None or k > f)
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if later else "response", f if later else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert got(archive_round_trip(spark, pages)) == slow([(r.page_id, r.html) for r in pages.collect()])


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_edge_cases(spark, min_bytes):
    rows = [(3, "u", "same text"), (1, "v\r\nX: y", "same text"), (2, None, "same text"), (4, "w", None), (5, "w", ""), (6, "x", "é\r\n\r\nz" * 100_000), (7, "x", "abc"), (8, "x", "abc"), (1, "v", "same text"), (None, "n", "same text"), (9, "%0A", "WARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    assert got(archive_round_trip(spark, pages, min_bytes)) == slow([(k, h) for k, _, h in rows], min_bytes)
    assert archive_round_trip(spark, pages.limit(0)).collect() == []


def test_files_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"page {k % 7}") for k in range(50)], "page_id long, url string, html string")
    written = spark.createDataFrame(write_archives(with_revisits(pages), str(tmp_path / "out"), most_bytes=900).collect())
    (tmp_path / "out" / "_work" / "left.warc.gz").write_bytes(b"cut off")  # of a task that died
    for _ in range(2):
        files = publish(written).collect()
    assert sorted(str(p) for p in (tmp_path / "out").glob("*.warc.gz")) == sorted(f.path for f in files)
    assert sum(f.records for f in files) == 50 and len(files) > 5
    assert all(gzip.open(f.path).read().startswith(b"WARC/1.1\r\n") for f in files)
    rows = read_archives(spark.createDataFrame(files), payload=True).collect()
    assert {r.page_id: r.url for r in rows} == {k: f"http://a/{k}" for k in range(50)}
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {b"page %d" % k for k in range(7)}


def test_damage_is_told():
    good = member(record(1, "u", b"payload", None)) + member(record(2, "u", b"payload", 1))
    for chunk in (1, 7, 1 << 16):
        assert [h["warc-type"] for h, _ in read_records(io.BytesIO(good), chunk)] == ["response", "revisit"]
    with pytest.raises(ValueError, match="digest"):
        list(read_records(io.BytesIO(member(record(1, "u", b"payload", None).replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n")))))
    with pytest.raises(ValueError, match="ends within"):
        list(read_records(io.BytesIO(good[:-20])))


def test_paths_keep_their_scheme(spark, tmp_path):
    """Addresses with a scheme are told with it, so that readers find the store they lie in."""
    folder = (tmp_path / "far away").as_uri()
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    files = publish(spark.createDataFrame(write_archives(with_revisits(pages), folder).collect()))
    paths = [f.path for f in files.collect()]
    assert paths and all(p.startswith("file:///") for p in paths)
    assert sorted(r.page_id for r in read_archives(files).collect()) == [1, 2]
