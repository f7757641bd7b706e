"""WARC packages: exact round trip, SQL, ZIP structures as the standard library writes them, damaged files."""

import base64
import collections
import gzip
import hashlib
import io
import re
import zipfile
import zlib

import duckdb
import pyarrow as pa
import pytest

from pagevault.llm import warc, zipfiles
from pagevault.llm.queries import ORACLE, QUERIES
from pagevault.llm.zipfiles import Archive, BadArchive


def of(data):
    return Archive(pa.BufferReader(data))


def package(files, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


FILES = {"archive/a.warc": b"abc" * 100, "indexes/i.cdxj": b"x", "größe.txt": b"", "archive/b.warc.gz": b"\0" * 999}


@pytest.mark.parametrize("wide", [False, True])
def test_members(monkeypatch, wide):
    if wide:  # the library then writes ZIP64 fields and records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    monkeypatch.setattr(zipfiles, "CHUNK", 60)
    data = package(FILES, b"a comment with PK\x05\x06 in it and PK\x05\x06")
    assert (b"PK\x06\x06" in data) == wide
    archive = of(data)
    got = {m.name: archive.read(archive.data_start(m), m.size) for m in archive.members()}
    assert got == FILES and list(got) == list(FILES)


def test_wide_entry():
    """All three numbers of an entry in its ZIP64 field, after another field; and only the one that overflows."""
    full = 0xFFFFFFFF
    extra = b"\x55\x54\x01\x00\x07" + b"\x01\x00\x18\x00" + b"".join(v.to_bytes(8, "little") for v in (5 << 40, 5 << 40, 7 << 40))
    assert zipfiles._wide(extra, full, full, full) == (5 << 40, 5 << 40, 7 << 40)
    assert zipfiles._wide(b"\x01\x00\x08\x00" + (9 << 33).to_bytes(8, "little"), 4, 4, full) == (4, 4, 9 << 33)
    with pytest.raises(BadArchive):
        zipfiles._wide(b"\x01\x00\x00\x00", full, 4, 4)


def test_bad_archives():
    good = package(FILES)
    for bad in (b"", b"no zip", good[:-30], good[: len(good) // 2]):
        with pytest.raises(BadArchive):
            list(of(bad).members())
    with pytest.raises(BadArchive):
        list(of(package({"archive/x.warc.gz": b"y" * 500}, method=zipfile.ZIP_DEFLATED)).members())
    with pytest.raises(BadArchive):
        of(good).read(len(good) - 1, 5)
    damaged = bytearray(good)
    damaged[0:4] = b"XXXX"
    with pytest.raises(BadArchive):
        [of(bytes(damaged)).data_start(m) for m in of(bytes(damaged)).members()]


def brute(rows):
    """uid order as the docstring says: id with null first, then HTML."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2] is not None, rows[i][2] or ""))
    last = {}
    for k in order:
        last[rows[k][2] or ""] = k
    out = []
    for k, (i, _, html) in enumerate(rows):
        p = (html or "").encode()
        again = len(p) >= 1000 and last[html or ""] != k
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", rows[last[html or ""]][0] if again else None))
    return out


def key(r):
    return tuple(str(v) for v in r)


ROWS = [
    (1, "http://a/1", "x" * 2000), (2, "http://a/2", "x" * 2000), (5, None, "x" * 2000), (3, "http://a/3", "x" * 999), (4, "u", "x" * 999),
    (6, "http://ß/ü?a b", "ß日本🎉\r\n\r\n" * 200), (7, "new\r\nline", "ß日本🎉\r\n\r\n" * 200), (8, "u", None), (9, "u", ""), (10, "u", "word " * 400_000),
]


def test_unique_ids(spark):
    df = spark.createDataFrame([(*r, 1, "t") for r in ROWS], "page_id long, url string, html string, payload_bytes int, record_type string").repartition(3)
    assert sorted(map(tuple, warc.page_records(spark, df).collect()), key=key) == sorted(brute(ROWS), key=key)
    packages = warc.write_archives(df)
    assert sum(r.n_records for r in packages.collect()) == len(ROWS)
    back = warc.resolved(warc.read_archives(packages)).collect()
    assert {r.record_id: r.payload.decode() for r in back} == {f"urn:page:{i}": h or "" for i, _, h in ROWS}
    urls = {r.record_id: r.url for r in back}
    assert urls["urn:page:5"] is None and urls["urn:page:6"] == "http://ß/ü?a b" and urls["urn:page:7"] == "new%0D%0Aline"


def test_odd_ids(spark):
    rows = ROWS + [(None, "n", "y" * 1500), (None, "n", "y" * 1500), (None, None, None), (1, "http://a/1", "x" * 2000), (6, "other", "z" * 1200), (11, "u", "y" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.page_records(spark, df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert warc.page_records(spark, df.limit(0)).count() == 0
    text = spark.createDataFrame([("a:b/c d", "u", "q" * 1000), ("z%", "u", "q" * 1000)], "page_id string, url string, html string")
    assert sorted(tuple(r)[:1] + tuple(r)[3:] for r in warc.page_records(spark, text).collect()) == [("a:b/c d", "revisit", "z%"), ("z%", "response", None)]


def test_hot_payload_and_small_packages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "HEAVY", 4)  # the largest class is broadcast, the others are shuffled
    monkeypatch.setattr(warc, "RANGE", 3000)
    rows = [(i, f"http://h/{i}", ("hot " * 300 if i % 3 else f"page {i % 60} " * 150)) for i in range(500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    packages = warc.write_archives(df, folder=str(tmp_path / "out"), package=4000)
    assert packages.count() > 8
    records = warc.read_archives(packages, payloads=False)
    got = records.select(warc.page_id("record_id").alias("i"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("r")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    # the files are what other readers expect
    kinds = collections.Counter()
    for r in packages.collect():
        with zipfile.ZipFile(re.sub("^file:/*", "/", r.path)) as z:
            assert z.testzip() is None and {m.compress_type for m in z.infolist()} == {zipfile.ZIP_STORED}
            raw = z.read("archive/data.warc.gz")
            while raw:
                unpacker = zlib.decompressobj(31)
                text = unpacker.decompress(raw)
                raw = unpacker.unused_data
                kinds[re.search(rb"WARC-Type: (\w+)", text)[1].decode()] += 1
    assert kinds["warcinfo"] == packages.count() and kinds["response"] + kinds["revisit"] == 500


def test_packages_of_others(spark, tmp_path):
    """Without an index, plain or gzipped; the index of another tool; a wrong digest."""
    def plain(i, payload, digest=None):
        digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    a, b = plain(1, b"one" * 3000), plain(2, b"")
    za, zb = gzip.compress(a), gzip.compress(b)
    index = f'com,x)/ 2020 {{"offset": "{len(za)}", "length": "{len(zb)}", "filename": "q.warc.gz"}}\n'.encode()
    for name, files in {"1": {"archive/p.warc": a + b}, "2": {"archive/q.warc.gz": za + zb, "pages/pages.jsonl": b"{}"}, "3": {"archive/q.warc.gz": za + zb, "indexes/i.cdxj": index}}.items():
        (tmp_path / f"{name}.zip").write_bytes(package(files))
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.zip"),) for n in "123"], "path string")
    got = sorted((r.record_id, len(r.payload)) for r in warc.read_archives(paths).collect())
    assert got == [("urn:x:1", 9000)] * 2 + [("urn:x:2", 0)] * 3
    (tmp_path / "4.zip").write_bytes(package({"archive/p.warc": plain(3, b"text", "A" * 32)}))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark.createDataFrame([(str(tmp_path / "4.zip"),)], "path string")).collect()


def test_query_is_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    df = QUERIES["op13_warc"](spark, sf_dir)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op13_warc']})")
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
