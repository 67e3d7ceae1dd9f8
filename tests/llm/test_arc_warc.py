import base64
import hashlib
import io

import pytest

from entloom.llm import arc_warc as aw


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\n<p>\nhttp://fake 1 2 text/html 3\n</p>", b"", b"no http\n\n"]
    data = aw.arc_version_block("x.arc", "20010203040506", version)
    for i, b in enumerate(bodies):
        data += aw.arc_record(f"http://h/a b{i}", "1.2.3.4", "20010203", "text/html", b, version)
    first, *records = aw.read_arc(io.BytesIO(data))
    assert first.version == version and [r.body for r in records] == bodies
    assert records[1].fields["URL"] == "http://h/a b1"
    kinds = [aw.to_warc(r)[0]["WARC-Type"] for r in (first, *records)]
    assert kinds == ["warcinfo", "response", "resource", "resource"]
    head, block = aw.to_warc(records[0])
    assert head["WARC-Date"] == "2001-02-03T00:00:00Z" and block == bodies[0]
    assert head["WARC-Payload-Digest"] == "sha1:" + aw.base32_sha1(bodies[0].partition(b"\r\n\r\n")[2])
    assert aw.to_warc(records[0]) == aw.to_warc(records[0])
    with pytest.raises(EOFError):
        list(aw.read_arc(io.BytesIO(data[:-5])))


def test_warc_is_cut_by_length():
    block = b"WARC/1.0\r\n\r\n\r\n\r\n"
    data = b"".join(aw.warc_bytes({"WARC-Type": "resource", "N": str(i)}, block) + aw.END for i in range(3))
    assert [(h["N"], b) for h, b in aw.read_warc(io.BytesIO(data))] == [(str(i), block) for i in range(3)]


def test_pages(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, "other \r\n\r\n WARC/1.0\r\n"), (4, "u v", None), (5, "w", ""), (None, "n", "same"), (None, None, "alone"), (7, "r", "rep"), (7, "r", "rep"), (8, "é", "ünï \x00")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = aw.archive_digest(pages).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        f = first.get(h or "")
        kind = "response" if f is None or i == f else "revisit"
        want.append((i, len((h or "").encode()), digest(h), kind, f if kind == "revisit" else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert aw.archive_digest(pages.limit(0)).count() == 0


def test_large_pages_have_archives_of_their_own(spark, tmp_path):
    """A page above its share of an archive's bytes, very long ones among them."""
    rows = [(i, f"http://h/{i}", "x" * (10 if i % 5 else 3000 + i)) for i in range(40)] + [(99, "http://h/99", "é" * 1_000_000)]
    aw.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"), records_per_file=4, file_bytes=8000)
    got = {r["page_id"]: r for r in aw.read_archives(spark, str(tmp_path / "a")).collect()}
    assert len(got) == 41 and got[99]["payload_bytes"] == 2_000_000 and got[99]["payload_digest"] == digest("é" * 1_000_000)
    assert (tmp_path / "a" / "large").exists()
