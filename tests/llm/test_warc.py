"""WARC archives: exact round trips, and what the reader says of broken ones."""

import glob
import hashlib
import struct

import duckdb
import pytest
import zstandard

from quirework.llm import sql, warc
from quirework.llm.queries import op13_warc

PAGES = "page_id long, url string, html string, record_type string, bytes string"
LONG = "<p>héllo</p>" * 20


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<html>{i * 7919} é {'word ' * (i % 90)}</html>", "x", "y") for i in range(400)]
    rows += [(1000 + i, "http://hot/", LONG, "x", "y") for i in range(300)] + [(1000, "http://a/", LONG, "x", "y"), (1000, "http://a/", LONG, "x", "y"), (1000, "http://a/", LONG, "x", "y"), (None, None, LONG, "x", "y")]
    rows += [(2000 + i, "u", "short", "x", "y") for i in range(5)] + [(3000, None, None, "x", "y"), (3001, "", "", "x", "y"), (3002, "a\r\nb", "v" * 2_000_000, "x", "y")]
    rows += [(None, "n", "w" * 100, "x", "y"), (None, "n", "w" * 100, "x", "y"), (5, "twice", "q" * 99, "x", "y"), (5, "twice", "q" * 99, "x", "y")]
    return rows, spark.createDataFrame(rows, PAGES).repartition(4)


@pytest.fixture(scope="module")
def archives(pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archives")
    warc.write(pages[1], f"file://{path}")
    return path


def test_round_trip_equals_brute_force_and_sql(pages, spark, tmp_path):
    rows, df = pages
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in op13_warc(spark, str(tmp_path)).collect())))
    by = {}
    for i, url, html, *_ in rows:
        by.setdefault((html or "").encode(), []).append((i is None, i or 0, i))
    want = []
    for data, ids in by.items():
        ids.sort()
        for k, (*_, i) in enumerate(ids):
            again = k and len(data) >= 100
            want.append(repr((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", ids[0][2] if again else None)))
    assert got == sorted(want)
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({sql.OP13_WARC})").fetchall()))


def test_payloads_come_back(pages, spark, archives):
    found = warc.read(spark, f"file://{archives}").collect()
    assert len(found) == len(pages[0]) and not any(r["error"] for r in found) and len({r["record_id"] for r in found}) == len(found)
    stored = sorted((r["page_id"] or -1, bytes(r["payload"])) for r in found if r["record_type"] == "response")
    assert len(stored) == sum(r["record_type"] == "response" for r in found)
    seen, want = set(), []
    for i, url, html, *_ in sorted(pages[0], key=lambda r: (r[0] is None, r[0] or 0, r[1] or "~")):
        data = (html or "").encode()
        if len(data) < 100 or data not in seen:
            want.append((i or -1, data))
            seen.add(data)
    assert stored == sorted(want)
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")


def test_archives_are_plain_zstandard(archives):
    """Any reader that takes the dictionary from the first frame reads them; each record is a frame of its own."""
    n = 0
    for name in glob.glob(f"{archives}/part-*"):
        data = open(name, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        whole = reader.stream_reader(data, read_across_frames=True).read()
        frames = [f for f in warc.frames_of(memoryview(data)) if not f[2]]
        assert whole.startswith(b"WARC/1.1\r\n") or not frames
        assert whole == b"".join(reader.decompress(data[a:b]) for a, b, _ in frames)
        n += len(frames)
    assert n == 400 + 304 + 5 + 3 + 4


def made(*recs, dictionary=None, stored=None, sized=True):
    named = warc._named(dictionary or b"")
    compressor = zstandard.ZstdCompressor(dict_data=named)
    body = b""
    for r in recs:
        stream = compressor.compressobj(size=len(r) if sized else -1)
        body += stream.compress(r) + stream.flush()
    head = stored if stored is not None else dictionary
    return (struct.pack("<II", 0x184D2A5D, len(head)) + head if head is not None else b"") + body


def response(payload=b"hello", i=1):
    return warc.record("response", f"<urn:x:{i}>", "u", payload, hashlib.sha256(payload).hexdigest(), len(payload), i)


def test_dictionaries_raw_compressed_trained_and_none():
    trained = warc.dictionary_of([response(bytes([65 + k % 26]) * 900 + str(k).encode(), k) for k in range(200)])
    assert trained[:4] == struct.pack("<I", 0xEC30A437)
    rec = response(b"WARC/1.1 some words of the dictionary")
    for archive in (
        made(rec, rec), made(rec, rec, dictionary=trained), made(rec, rec, dictionary=b"raw words of the dictionary " * 9),
        made(rec, rec, dictionary=trained, stored=zstandard.ZstdCompressor().compress(trained)), made(rec, rec, sized=False), made(rec, rec * 1, dictionary=trained, sized=False),
    ):
        found = list(warc.records(archive))
        assert [r["error"] for r in found] == [None, None] and found[0]["payload"] == b"WARC/1.1 some words of the dictionary"
    big = response(bytes(range(256)) * 4000)
    (r,) = warc.records(made(big))
    assert r["payload"] == bytes(range(256)) * 4000 and r["error"] is None


@pytest.mark.parametrize(
    "broken, error",
    [
        (lambda r: r[9:], "no WARC version line"),
        (lambda r: r.replace(b"Content-Length: ", b"Content-Size: "), "no content-length"),
        (lambda r: r.replace(b"WARC-Date: ", b"Date: "), "no warc-date"),
        (lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "), "a header without a name"),
        (lambda r: r[:-1], "a length other than told"),
        (lambda r: r + b"x", "a length other than told"),
        (lambda r: r.replace(b"hello", b"hullo"), "a block of another digest"),
        (lambda r: r.replace(b"WARC-Block-Digest: sha256", b"X: y").replace(b"hello", b"hullo"), "a payload of another digest"),
        (lambda r: r.replace(b"WARC-Block-Digest: sha256", b"X: y").replace(b"Content-Length: 5", b"Content-Length: 6"), "a payload of another length"),
        (lambda r: r.replace(b"WARC-Block-Digest: sha256", b"X: y").replace(b"\r\n\r\nhello", b"\r\n..hello"), "no end of the HTTP head"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"), "a revisit of nothing"),
    ],
)
def test_broken_records_are_told_and_the_next_is_read(broken, error):
    found = list(warc.records(made(response(), broken(response()), response(i=3))))
    assert [r["error"] for r in found] == [None, error, None] and found[2]["page_id"] == 3


def test_broken_frames():
    archive = made(response(), response(b"y" * 500, 2))
    second = [r["at"] for r in warc.records(archive)][1]
    assert [r["error"] for r in warc.records(archive[:-3])] == [None, "cut short"]
    assert [r["error"] for r in warc.records(archive[: second + 2])] == [None, "cut short"]
    assert [r["error"] for r in warc.records(archive + b"no frame of any kind")] == [None, None, "not a frame"]
    assert list(warc.records(b"")) == []
    named = made(response(), dictionary=warc.dictionary_of([response(str(k).encode() * 200, k) for k in range(300)]))
    (r,) = warc.records(named[8 + struct.unpack_from("<I", named, 4)[0] :])
    assert r["error"] == "a frame that can't be decoded"


def test_revisits_are_held_against_their_response(spark, tmp_path):
    digest = hashlib.sha256(b"hello").hexdigest()
    good, lost = (warc.record("revisit", f"<urn:x:{i}>", "u", None, digest, 5, i, to) for i, to in ((7, "<urn:x:1>"), (8, "<urn:x:9>")))
    other = warc.record("revisit", "<urn:x:10>", "u", None, digest, 6, 10, "<urn:x:1>")
    (tmp_path / "a.warc.zst").write_bytes(made(response(), good, lost, other))
    found = warc.resolved(warc.read(spark, str(tmp_path))).collect()
    assert {r["page_id"]: (r["refers_to"], r["error"]) for r in found} == {1: (None, None), 7: (1, None), 8: (None, "a revisit of no response"), 10: (1, "a revisit of another payload")}


def test_a_broken_archive_stops_the_round_trip(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "read", lambda spark, path, payloads: spark.createDataFrame([("a", 9, None, None, None, None, None, None, None, None, "cut short")], warc.RECORD))
    with pytest.raises(Exception, match="cut short"):
        warc.round_trip(pages[1]).collect()


def test_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
