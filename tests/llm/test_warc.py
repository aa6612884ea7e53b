"""WARC: round trip, revisits, byte ranges of any size, broken bytes, edge cases."""

import hashlib
import io

from estima.llm import warc


def expected(rows):
    out = []
    top = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            top[body] = max(top.get(body, -1), -1 if page is None else page)
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 1000 and sum((h or "").encode() == body for _, _, h in rows) > 1 and page != top[body]
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top[body] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    same = "<p>é</p>" * 200
    rows = [(i, f"http://x/{i}", f"<html>{i}" + "y" * (i * 37)) for i in range(60)]
    rows += [(100 + i, "http://same", same) for i in range(20)] + [(200, None, None), (201, "", ""), (202, "u\nv", "short"), (203, "u", "short")]
    rows += [(300, "magic", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for split in (64, 1000, 1 << 20):
        got = warc.round_trip(pages, f"{tmp_path}/w{split}", split=split)
        cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == expected(rows)


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 10), (2, "u", None), (None, "u", "c")], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, f"{tmp_path}/w", "page_id", "url", "html")
    got = {r["key"]: bytes(r["payload"]) for r in warc.read_warc(spark, manifest).collect()}
    assert got == {"1": b"a" * 10, "2": b"", None: b"c"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, f"{tmp_path}/w").count() == 0


def test_ranges_own_what_starts_inside_and_skip_broken_bytes():
    bodies = [bytes([65 + i]) * (i * 500) for i in range(12)]
    members = [warc._member(warc.record_bytes(str(i), "u", b, hashlib.sha1(b).hexdigest(), None, "d")) for i, b in enumerate(bodies)]
    data = members[0] + b"\x1f\x8b\x08\x00junk" + b"".join(members[1:])
    for step in (1, 7, 100, 5000, len(data)):
        found = [f["key"] for a in range(0, len(data), step) for _, f in warc.records_of(io.BytesIO(data), len(data), a, min(a + step, len(data)))]
        assert found == [str(i) for i in range(12)]
