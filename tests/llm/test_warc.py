import gzip
import hashlib
from collections import Counter

import pytest
from pyarrow import fs

from lumera.llm import warc
from lumera.llm.warc import CaptureIndex, find_captures, parse_record, read_captures, read_manifest, resolve_revisits, url_key, write_archive

SCHEMA = "page_id long, url string, html string, file string, offset int, row_no string, key binary, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "f", 1, "r", b"k", 3) for i, u, h in rows], SCHEMA)


def pages():
    long = "<p>naïve Straße 漢字</p>\r\n\r\nWARC/1.1\r\n" * 10
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}", f"<html>{i}</html>" * 20) for i in range(60)]
    rows += [(i, "https://same.example.org/x", long) for i in (203, 201, 202)]
    rows += [(210, None, long), (211, "", "short"), (212, "http://a b.example/ü?q#f", "short"), (213, "x://y", None), (214, "x://y", "")]
    rows += [(300, "http://twice.example/", "t" * 100)] * 2 + [(None, "http://twice.example/", "t" * 100), (301, "http://long.example/", "é" * 300_000), (302, "http://w.example/\r\nX: y", "t" * 99)]
    return rows


def expected(rows):
    """One (page_id, bytes, digest, type, refers_to) a row, by a plain loop."""
    first, out = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if len(data) < 100 or digest not in first:
            first.setdefault(digest, i)
            out.append((i, len(data), digest, "response", None))
        else:
            out.append((i, len(data), digest, "revisit", first[digest]))
    return Counter(out)


def read_back(spark, folder, urls):
    entries = find_captures(urls, folder)
    found = resolve_revisits(spark.createDataFrame(read_captures(entries, folder).collect(), warc.RECORD))
    as_int = lambda v: None if v is None else int(v)
    return Counter((as_int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, as_int(r.refers_to)) for r in found.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)


def test_round_trip(spark, tmp_path, small_blocks):
    """All rows come back by their addresses, over many files, index files and blocks."""
    rows, folder = pages(), f"file://{tmp_path}/archive"
    df = table(spark, rows)
    manifest = write_archive(df.repartition(5), folder, file_bytes=1_500, shard=15)
    assert manifest == read_manifest(folder) and manifest["captures"] == len(rows)
    assert len(manifest["index"]) > 2 and len(list((tmp_path / "archive").glob("*.warc.gz"))) > 5
    assert all(a["last"] <= b["first"] for a, b in zip(manifest["index"], manifest["index"][1:], strict=False))
    assert read_back(spark, folder, df) == expected(rows)


def test_files_are_warc(spark, tmp_path):
    rows, folder = pages(), f"file://{tmp_path}/archive"
    write_archive(table(spark, rows).coalesce(1), folder)
    (path,) = (tmp_path / "archive").glob("*.warc.gz")
    data, records = gzip.decompress(path.read_bytes()), []
    while data:
        fields, block = parse_record(data)
        data = data[data.index(b"\r\n\r\n") + 4 + len(block) + 4 :]
        records.append((fields, block))
    kinds = Counter(f["warc-type"] for f, _ in records)
    want = Counter(kind for _, _, _, kind, _ in expected(rows).elements())
    assert kinds == want + Counter(warcinfo=1) and len({f["warc-record-id"] for f, _ in records}) == len(records)
    ids = {f["warc-record-id"]: f for f, _ in records}
    for f, block in records:
        if f["warc-type"] == "revisit":
            assert ids[f["warc-refers-to"]]["warc-payload-digest"] == f["warc-payload-digest"] and block.endswith(b"\r\n\r\n")
    (odd,) = (f for f, _ in records if f.get("page-id") == "302")
    assert odd["warc-target-uri"] == "http://w.example/%0D%0AX: y" and "x" not in odd
    with pytest.raises(ValueError, match="cut short"):
        parse_record(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc")


def test_keys():
    assert url_key("HTTP://user@WWW.Example.com:80/A?b=c#d") == "com,example,www)/A?b=c"
    assert url_key("https://example.com:8080") == "com,example:8080)/" and url_key("http://10.0.0.1/x") == "10,0,0,1)/x"
    assert url_key("http://é.example/ü x") == "example,%c3%a9)/%C3%BC%20x" and url_key(None) == url_key("") == url_key("  ") == ""
    assert url_key("http://[::1]:81/a") == "[::1]:81)/a" and url_key("/just/a/path") == ")/just/a/path"


def test_searches(spark, tmp_path, small_blocks):
    """A key over several blocks and files is found as a whole, once; unknown addresses find nothing."""
    rows, folder = [(i, "http://one.example/" if i % 3 else f"http://z{i}.example/", f"{i}") for i in range(90)], f"file://{tmp_path}/a"
    manifest = write_archive(table(spark, rows), folder, shard=15)
    assert sum(r["first"] <= "example,one)/" <= r["last"] for r in manifest["index"]) > 1
    asked = spark.createDataFrame([("http://one.example",), ("https://ONE.example/#x",), ("http://none.example/",), ("http://z9.example/",), (None,)], "url string")
    found = read_captures(find_captures(asked, folder), folder).collect()
    assert sorted(int(r.page_id) for r in found) == sorted([9, *[i for i in range(90) if i % 3]])
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{manifest['index'][0]['name']}") as f:
        held = CaptureIndex(f)
        read = []
        held.block = lambda i, g=held.block: read.append(i) or g(i)
        assert len(list(held.find(held.first[-1]))) >= 1 and len(read) <= len(held.first)
        assert list(held.find("zzz")) == []


def test_revisits_without_their_response_and_damaged_records(spark, tmp_path):
    rows, folder = pages(), f"file://{tmp_path}/archive"
    write_archive(table(spark, rows).coalesce(1), folder)
    only = spark.createDataFrame([("https://same.example.org/x",)], "url string")
    got = read_back(spark, folder, only)
    assert sum(got.values()) == 3 and {k[0]: k[4] for k in got} == {201: None, 202: 201, 203: 201}
    lone = spark.createDataFrame([(None,)], "url string")
    assert [(k[0], k[1], k[4]) for k in read_back(spark, folder, lone) if k[0] == 210] == [(210, None, None)]
    (path,) = (tmp_path / "archive").glob("*.warc.gz")
    place = find_captures(only, folder).where("record_type = 'response'").first()
    data = path.read_bytes()
    member = gzip.decompress(data[place.offset : place.offset + place.length])
    with pytest.raises(ValueError, match="header says"):
        warc._row(gzip.compress(member.replace(b"Stra", b"stra")))


def test_empty_table(spark, tmp_path):
    none = table(spark, [])
    folder = f"file://{tmp_path}/archive"
    assert write_archive(none, folder)["captures"] == 0
    assert read_captures(find_captures(none, folder), folder).count() == 0


def test_query(spark, tmp_path):
    rows = [r for r in pages() if r[0] is not None and r[0] != 300] * 1
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    df = warc.op11_warc(spark, str(tmp_path))
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()) == expected(rows)
