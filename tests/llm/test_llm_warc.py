import gzip
import hashlib
import os
import zlib

import pytest

from inkveil.llm import warc
from inkveil.llm.shared import shared_path

BIG = "é" * 600
ROWS = [
    (1, "http://a/", "small"), (2, "http://b/", "small"), (3, "http://c/\r\nx y", BIG), (9, None, BIG), (5, "http://d/", BIG),
    (6, "", None), (7, "http://e/", "WARC/1.0\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (None, "http://f/", BIG),
    (10, "http://g/", "x" * 999), (11, "http://h/", "x" * 999), (12, "u", "y" * 100_000), (12, "u", "y" * 100_000),
]


def written(spark, rows, **options):
    path = shared_path(spark, "test-warc")
    pages = spark.createDataFrame([(i, u, h, "p", 0) for i, u, h in rows], "page_id long, url string, html string, payload string, size int")
    warc.write_archives(pages.repartition(2), path, **options)
    return path


def test_round_trip(spark):
    path = written(spark, ROWS)
    made = warc.read_archives(spark, path, payloads=True)
    assert made.where("kind = 'gap'").count() == 0
    found = warc.resolved(made).collect()
    wanted = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        winner = {BIG: 9, "y" * 100_000: 12}.get(html)
        kind = "revisit" if winner is not None and i != winner else "response"
        wanted.append((None if i is None else str(i), len(data), hashlib.sha1(data).hexdigest(), kind, str(winner) if kind == "revisit" else None))
    assert sorted(map(repr, wanted)) == sorted(repr((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_page)) for r in found)
    texts = {r.page: bytes(r.payload).decode() for r in found if r.record_type == "response"}
    assert all(texts[str(i)] == (html or "") for i, _, html in ROWS if str(i) in texts)


def test_only_null_ids_are_responses(spark):
    found = warc.read_archives(spark, written(spark, [(None, "a", BIG), (None, "b", BIG)])).collect()
    assert [(r.record_type, r.page) for r in found] == [("response", None)] * 2


def test_empty(spark):
    assert warc.read_archives(spark, written(spark, [])).count() == 0


def record(page, payload, **changes):
    digest = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    fields = {"WARC-Type": "response", "WARC-Page-ID": page, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http", "Content-Length": len(block)} | changes
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


A, B, C = (record(p, p.encode() * 50) for p in "abc")


def pages(data):
    return [what["page"] for kind, _, _, what in warc.salvage(data) if kind == "record"]


def gaps(data):
    return [(at, size) for kind, at, size, _ in warc.salvage(data) if kind == "gap"]


@pytest.mark.parametrize(
    ("data", "found", "lost"),
    [
        (b"", [], []),
        (A + B + C, ["a", "b", "c"], []),
        (A + b"junk" + B, ["a", "b"], [(len(A), 4)]),
        (A + B[:-40] + C, ["a", "c"], [(len(A), len(B) - 40)]),
        (A + B.replace(b"bbb", b"bxb", 1) + C, ["a", "c"], [(len(A), len(B))]),
        (A + B[:-30], ["a"], [(len(A), len(B) - 30)]),
        (record("a", b"x", **{"Content-Length": "many"}) + B, ["b"], [(0, len(record("a", b"x", **{"Content-Length": "many"})))]),
        (gzip.compress(A) + gzip.compress(B) + C, ["a", "b", "c"], []),
        (gzip.compress(A + B) + gzip.compress(C), ["a", "b", "c"], []),
        (record("q", b"pay", **{"WARC-Payload-Digest": "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"pay").digest()).decode()}), ["q"], []),
        (A + b"WARC/1.0 WARC/1.0\r\n\r\n" + b"\x1f\x8b\x08 no member" + B, ["a", "b"], [(len(A), 34)]),
    ],
)
def test_salvage(data, found, lost):
    assert pages(data) == found
    assert gaps(data) == lost


def test_damaged_member():
    first, second, third = gzip.compress(A), bytearray(gzip.compress(B)), gzip.compress(C)
    second[30] ^= 0xFF
    data = first + bytes(second) + third
    assert pages(data) == ["a", "c"]
    assert gaps(data) == [(len(first), len(second))]
    assert pages(first + gzip.compress(B)[:-20] + third) == ["a", "c"]


def test_records_before_the_damage_in_a_member():
    member = gzip.compress(A + record("n", os.urandom(90_000)) + B, 1)
    assert pages(member[:60_000] + gzip.compress(C)) == ["a", "c"]


def test_reader_on_damaged_files(spark, tmp_path):
    (tmp_path / "one.warc").write_bytes(A + b"#" + B)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(C) + b"tail")
    (tmp_path / "empty.warc").write_bytes(b"")
    made = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page for r in made if r.kind == "record") == ["a", "b", "c"]
    assert sorted((r.path.rsplit("/", 1)[1], r.offset, r.length) for r in made if r.kind == "gap") == [
        ("one.warc", len(A), 1), ("two.warc.gz", len(gzip.compress(C)), 4),
    ]


def test_small_damaged_members_give_the_records_before_the_damage():
    many = [record(str(i), os.urandom(300)) for i in range(60)]
    for level in (0, 1, 9):
        member = bytearray(gzip.compress(b"".join(many), level))
        assert len(member) < 65536
        member[-6] ^= 0xFF  # the checksum
        assert pages(bytes(member) + gzip.compress(C)) == [str(i) for i in range(60)] + ["c"]
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    head = packer.compress(b"".join(many[:40])) + packer.flush(zlib.Z_FULL_FLUSH)
    member = bytearray(head + packer.compress(b"".join(many[40:])) + packer.flush())
    member[len(head)] = 0xFF  # no type of block
    assert pages(bytes(member) + gzip.compress(C)) == [str(i) for i in range(40)] + ["c"]
    flipped = bytearray(gzip.compress(b"".join(many)))
    flipped[len(flipped) // 2] ^= 0xFF
    assert pages(bytes(flipped) + gzip.compress(C))[:25] == [str(i) for i in range(25)]


def test_gaps_are_stored(spark, tmp_path):
    (tmp_path / "one.warc").write_bytes(A + b"#" + B)
    records, gaps = warc.stored_records(spark, str(tmp_path))
    assert sorted(r.page for r in records.collect()) == ["a", "b"]
    assert [(r.path.rsplit("/", 1)[1], r.offset, r.length, r.reason) for r in gaps.collect()] == [("one.warc", len(A), 1, "no record starts here")]


def test_damage_costs_time_in_proportion():
    """Header numbers of any length, and megabytes of what only looks like a record or a member."""
    import time

    good = record_bytes(b"kept")
    for bad in (b"5" * 5000, b"0" * 6000 + b"7", b"-1", b"", "٣".encode()):
        data = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: " + bad + b"\r\n\r\n" + good
        assert [f["payload"] for kind, _, _, f in warc.salvage(data) if kind == "record"] == [b"kept"]
    start = time.time()
    for false in (b"WARC/1.0\r\n", b"x WARC/1.1\r\nContent-Length: 3\r\n", b"\x1f\x8b\x08\x00", b"WARC/1.0\r\n\r\n"):
        data = good + false * (4_000_000 // len(false)) + good
        found = list(warc.salvage(data))
        assert [f["payload"] for kind, _, _, f in found if kind == "record"] == [b"kept", b"kept"]
        headless = [kind for kind, *_ in warc.salvage(false.replace(b"\r\n\r\n", b"\r\n") * 50_000)]
        assert set(headless) == {"gap"}
    assert time.time() - start < 60


def record_bytes(payload):
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"
