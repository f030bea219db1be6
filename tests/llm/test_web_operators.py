import hashlib
import re

import pytest

from flightline.llm import bloom_cascade, queries, warc
from flightline.llm.bloom_cascade import RULES, Rule


def verdict(url, rules, default="allow"):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    host = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if m else ""
    path = m[2] if m else ""
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else default


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://Example.COM/", "http://www.example.com/en/x?y#z", "http://example.com/en/", "http://example.com/en", "http://notexample.com/en/a",
    "ftp://a.b.net/es/1", "http://net/fr/", "http://net/ES/", "http://x.net?/es/", "http://x.net#/fr/", "http://user@example.com:80/en/", "http://.com/", "http://com/", "a://b://c.com/d", "http://x.com\n/en/", "http://é.com/ü/", "http://www.example.com/en/x?y#z",
]


def test_cascade_equals_the_rules(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, key string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in bloom_cascade.filter_urls(pages, RULES).collect()}
    assert got == {k: verdict(u, RULES) for k, u in enumerate(URLS)}
    assert bloom_cascade.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in bloom_cascade.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_cascade_is_exact_however_poor_its_first_level(spark):
    urls = [f"http://h{k % 37}.example{k % 5}.org/p{k % 11}/{k}" for k in range(400)]
    rules = [Rule("block", f"h{k}.example{k % 5}.org", "/p1") for k in range(0, 37, 3)] + [Rule("allow", "example2.org", "/"), Rule("block", "org", "")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rate in (None, 0.5, 0.9):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in bloom_cascade.filter_urls(pages, rules, first_rate=rate).collect()}
        assert got == {k: verdict(u, rules) for k, u in enumerate(urls)}


BODY = "<html>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc</html>" + "x" * 1200


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a", BODY), (9, "http://b\r\nX: y", BODY), (5, None, BODY), (1, "http://c", "short"), (2, "http://c", "short"), (4, "http://d", None), (6, "", ""), (None, "http://e", BODY), (7, "ü", "é" * 700), (8, "ü", "é" * 700), (10, "q", "é" * 499), (11, "q", "é" * 499)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")
    warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=900)
    records = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert len(records) == len(rows) and all(r["intact"] for r in records)
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in records if r["record_type"] == "response"}
    assert bodies[9] == BODY and bodies[None] == BODY and bodies[4] == "" and bodies[8] == "é" * 700
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["resolved"]) for r in warc.resolve_revisits(warc.read_archives(spark, f"{tmp_path}/w", payloads=False)).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        revisit = i is not None and len(data) >= 1000 and max(same) != i
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None, True)


def test_archives_are_bounded_gzip_members_with_standard_headers(spark, tmp_path, monkeypatch):
    import gzip
    from pathlib import Path

    bodies = ["ab" * 700, "ab" * 700, "".join(chr(32 + 7 * k * k % 90) for k in range(40_000)), "small"]
    pages = spark.createDataFrame([(k, f"http://h/{k}", b) for k, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "MOST_MEMBER", 10_000)
    warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=2_000, date="2024-05-06T07:08:09Z")
    files = [f.read_bytes() for f in Path(f"{tmp_path}/w").glob("part-*")]
    plain = [gzip.decompress(f) for f in files if f]  # any gzip reader can
    whole = b"".join(plain)
    assert whole.count(b"WARC/1.1\r\n") == 4 and all(f.startswith(b"WARC/1.1\r\n") and f.endswith(b"\r\n\r\n") for f in plain)
    assert all(len(f) <= 2_000 or one.count(b"WARC/1.1\r\n") == 1 for f, one in zip([f for f in files if f], plain, strict=True))
    revisit = next(one for one in whole.split(b"WARC/1.1\r\n") if b"WARC-Type: revisit" in one).decode()
    fields = dict(line.split(": ", 1) for line in revisit.strip().split("\r\n"))
    assert fields["WARC-Refers-To-Target-URI"] == "http://h/1" and fields["WARC-Refers-To-Date"] == "2024-05-06T07:08:09Z" and fields["WARC-Target-URI"] == "http://h/0"
    assert f"WARC-Record-ID: {fields['WARC-Refers-To']}\r\n".encode() in whole


def test_full_bitmaps_change_no_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(warc, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(warc, "held", lambda bitmap, hashes: hashes % 3 < 3)  # everything is in doubt
    rows = [(k, f"u{k}", f"{k % 7}" * 1500) for k in range(50)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["resolved"]) for r in warc.resolve_revisits(warc.read_archives(spark, f"{tmp_path}/w")).collect()}
    last = {k % 7: k for k in range(50)}
    assert got == {k: ("response", None, True) if last[k % 7] == k else ("revisit", last[k % 7], True) for k in range(50)}


def test_archives_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    assert warc.resolve_revisits(warc.read_archives(spark, f"{tmp_path}/w")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf, tables, name):
    df = queries.queries()[name](spark, sf)
    expected = tables.sql(queries.oracle_sql()[name])
    place = [df.columns.index(c) for c in expected.columns]
    assert sorted(df.columns) == sorted(expected.columns)
    assert sorted((tuple(r[k] for k in place) for r in df.collect()), key=repr) == sorted(expected.fetchall(), key=repr)
