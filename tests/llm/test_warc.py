"""op10: round trips, revisits, the index."""

import gzip
import hashlib

import pytest

from tidefold.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, key int"
BIG = "<p>" + "é" * 60
ROWS = [(5, "http://b.example.com/x", BIG), (2, "https://www.B.example.com:443/X#top", BIG), (9, "http://a.example.org/", BIG), (1, "http://c.net", "small"), (3, "http://c.net", "small"), (4, None, None), (6, "http://c.net/ new\nline", ""), (7, "http://long", "w" * 300_000), (8, "http://d", "\r\n\r\n" * 40), (10, "http://d", "\r\n\r\n" * 40)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain(rows):
    first: dict[str, int] = {}
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        if len(raw) >= 100 and p is not None:
            first[d] = min(first.get(d, p), p)
        out.append((p, len(raw), d))
    return sorted((p, n, d, "revisit" if n >= 100 and d in first and first[d] != p else "response", first[d] if n >= 100 and d in first and first[d] != p else None) for p, n, d in out)


def test_round_trip(spark):
    assert sorted(map(tuple, warc.round_trip(pages(spark)).collect())) == plain(ROWS)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_repeated_and_null_ids(spark, monkeypatch):
    rows = [(1, "u", BIG), (1, "u", BIG), (2, "u", BIG), (2, "u", BIG), (None, "u", BIG), (None, "v", "z" * 200), (None, "v", "z" * 200)]
    for most in (1_000_000, 0):
        monkeypatch.setattr(warc, "MOST_REVISITS", most)
        found = [tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()]
        assert sorted(found, key=str) == sorted(plain([r for r in rows if r[0]]) + [(None, len(BIG.encode()), hashlib.sha256(BIG.encode()).hexdigest(), "revisit", 1)] + [(None, 200, hashlib.sha256(b"z" * 200).hexdigest(), "response", None)] * 2, key=str)


def test_archives_are_warc_and_lookups_find_records(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    captures = warc.write(pages(spark), folder)
    files = warc.index(captures, folder, block=3)
    keys = [(r.first_key, r.first_page is not None, r.first_page or 0) for r in files.orderBy("part").collect()]
    assert keys == sorted(keys) and len(keys) >= 2
    blocks = [b for r in files.orderBy("part").collect() for b in warc.IndexFile(r.path, r.offset, r.length).firsts]
    assert blocks == sorted(blocks) and len(blocks) >= 4
    lookup = warc.Lookup(files)
    found = lookup.pages("http://B.example.com/x")
    assert sorted(r["page_id"] for r in found) == [2, 5]
    by = {r["page_id"]: r for r in found}
    assert by[2]["payload"] == BIG.encode() and by[5]["payload"] is None and by[5]["refers_to"] == 2 and by[5]["payload_bytes"] == len(BIG.encode())
    assert sorted(r["page_id"] for r in lookup.pages("http://c.net/")) == [1, 3] and lookup.pages("http://nowhere.example/") == []
    for url in {r[1] for r in ROWS if r[1]}:
        assert lookup.pages(url)
    texts = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz")]
    assert all(t.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for t in texts)
    assert sum(t.count(b"WARC-Type: response") + t.count(b"WARC-Type: revisit") for t in texts) == len(ROWS)
    everything = {r.page_id: r.payload for r in warc.read(warc.find(files, pages(spark)), with_payload=True).collect()}
    assert bytes(everything[7]) == b"w" * 300_000 and everything[9] is None


def test_many_captures_of_one_url_over_files_and_blocks(spark, tmp_path):
    rows = [(i, "http://hot.example/", f"<p>{'x' * 150}{i % 7}") for i in range(400)] + [(None, "http://hot.example/", "null")] + [(1000 + i, f"http://h{i}.example/", "") for i in range(30)]
    folder = f"file://{tmp_path}/w"
    files = warc.index(warc.write(pages(spark, rows), folder), folder, block=10)
    assert len(warc.Lookup(files).captures("http://hot.example/")) == 401
    assert sorted((r.page_id for r in warc.read(warc.find(files, pages(spark, rows[100:200] + rows[-1:]))).collect())) == [*range(100, 200), 1029]
    assert sorted(map(tuple, warc.round_trip(pages(spark, rows)).collect()), key=str) == sorted(plain([r for r in rows if r[0] is not None]) + [(None, 4, hashlib.sha256(b"null").hexdigest(), "response", None)], key=str)


def test_keys():
    assert warc.url_key("https://user@WWW.Example.com:8080/A?b#c") == "com,example:8080)/a?b"
    assert warc.url_key("http://example.com") == warc.url_key("https://example.com:443/") == "com,example)/"
    assert warc.url_key("urn:page:3") == "urn:page:3"


def test_damage_is_noticed():
    raw = warc.record(1, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"payload\r\n", b"pAyload\r\n"))


def test_equals_its_sql(spark):
    import duckdb

    from tidefold.llm.queries import OP10_SQL

    c = duckdb.connect()
    c.register("pages", pages(spark).toPandas())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({OP10_SQL})").fetchall()) == sorted(map(tuple, warc.round_trip(pages(spark)).collect()))
