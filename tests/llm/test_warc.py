import hashlib
import io
import random
import re

from kindred.llm import warc
from kindred.llm.workspace import Workspace


def _records(n=6, size=3000):
    rnd = random.Random(3)
    return [warc.build_record("response", f"urn:page:{i}", f"http://x/{i}", bytes(rnd.randrange(256) for _ in range(size + i))) for i in range(n)]


def _read(data):
    return list(warc.read_records(io.BytesIO(data)))


def test_round_trip_of_members_and_plain_records():
    plain = _records()
    for parts in (plain, [warc.member(r) for r in plain]):
        found = _read(b"".join(parts))
        assert [x.length for x in found] == [len(p) for p in parts]
        assert all(isinstance(x, warc.Record) for x in found)


def test_salvage_recovers_everything_but_the_damaged_record():
    for parts in (_records(), [warc.member(r) for r in _records()]):
        for hurt in range(len(parts)):
            for damage in ("flip", "cut", "drop head", "noise"):
                bad = list(parts)
                p = bytearray(bad[hurt])
                if damage == "flip":
                    p[len(p) // 2] ^= 0x55
                elif damage == "cut":
                    del p[len(p) // 2 :]
                elif damage == "drop head":
                    del p[:12]
                else:
                    p = bytearray(b"\x1f\x8b\x08WARC/1.1\r\n" * 5) + p
                bad[hurt] = bytes(p)
                found = _read(b"".join(bad))
                ids = [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)]
                want = [f"<urn:page:{i}>" for i in range(len(parts)) if i != hurt or damage == "noise"]
                assert [i for i in ids if i in want] == want, (hurt, damage)
                gaps = [x for x in found if isinstance(x, warc.Gap)]
                assert gaps and gaps[0].offset == sum(map(len, bad[:hurt]))
                assert sum(x.length for x in found) == sum(map(len, bad))


def test_digests_in_hexadecimal():
    record = _records(1)[0]
    block = _read(record)[0].block
    for digest in (hashlib.sha1(block).hexdigest(), hashlib.sha1(block).hexdigest().upper()):
        stated = record.replace(warc._digest(block).encode(), f"sha1:{digest}".encode())
        assert stated != record and [type(x) for x in _read(stated)] == [warc.Record]
    wrong = record.replace(warc._digest(block).encode(), b"sha1:" + b"0" * 40)
    assert [type(x) for x in _read(wrong)] == [warc.Gap]


def test_empty_and_garbage_archives():
    assert _read(b"") == []
    assert _read(b"x" * 200_000) == [warc.Gap(0, 200_000, "no version line")]


def test_damaged_lengths_are_gaps():
    first, hurt, last = _records(3)
    for length in ("²", "5" * 5000, "-1", "9" * 18, "", "1e3", "0x10"):
        bad = re.sub(rb"\r\nContent-Length: [0-9]+\r\n\r\nHTTP", f"\r\nContent-Length: {length}\r\n\r\nHTTP".encode(), hurt)
        assert bad != hurt
        for pack in (lambda x: x, warc.member):
            found = _read(pack(first) + pack(bad) + pack(last))
            assert [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)] == ["<urn:page:0>", "<urn:page:2>"]
            assert [(x.offset, x.length) for x in found if isinstance(x, warc.Gap)] == [(len(pack(first)), len(pack(bad)))]


def test_any_damage_is_survived():
    rnd = random.Random(7)
    for pack in (lambda x: x, warc.member):
        parts = [pack(r) for r in _records(5, 300)]
        whole = b"".join(parts)
        starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
        for _ in range(300):
            data = bytearray(whole)
            at = rnd.randrange(len(data))
            n = rnd.choice([1, 1, 2, 8, 40, 900])
            data[at : at + n] = bytes(rnd.choice([0, 13, 10, 31, 48, 255, rnd.randrange(256)]) for _ in range(min(n, len(data) - at)))
            found = _read(bytes(data))
            assert sum(x.length for x in found) == len(data) and [x.offset for x in found] == sorted(x.offset for x in found)
            safe = {k for k in range(len(parts)) if starts[k + 1] <= at or starts[k] >= at + n}
            assert {f"<urn:page:{k}>" for k in safe} <= {x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)}


def test_archives_with_gaps_and_long_payloads_are_read(spark, tmp_path):
    parts = [warc.member(r) for r in _records(4)]
    parts[1] = parts[1][:40]
    huge = warc.build_record("response", "urn:page:9", "u", b"0123456789" * 3_000_000)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc").write_bytes(huge + b"trailing noise")
    names = spark.createDataFrame([("a.warc.gz",), ("b.warc",)], "name string")
    got = sorted(warc.read_archives(names, tmp_path.as_uri()).collect(), key=lambda r: (r.archive, r.offset))
    assert [(r.record_id, r.gap is None) for r in got] == [("urn:page:0", True), (None, False), ("urn:page:2", True), ("urn:page:3", True), ("urn:page:9", True), (None, False)]
    assert got[1].length == 40 and got[4].payload_bytes == len(got[4].payload) == 30_000_000 and got[5].length == 14


def test_equal_payloads_become_revisits(spark):
    big, small = "é" * 700, "tiny"
    rows = [(1, "u", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", None), (2, None, big), (None, "u", big), (7, "line\r\nbreak", "x" * 1000)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in out)
    assert got == sorted([(1, 1400, "revisit", 2), (2, 1400, "response", None), (2, 1400, "response", None), (3, 4, "response", None), (4, 4, "response", None), (5, 0, "response", None), (6, 0, "response", None), (0, 1400, "revisit", 2), (7, 1000, "response", None)], key=lambda r: (r[0], r[1], r[2]))
    assert {r.payload_digest for r in out if r.page_id == 5} == {"da39a3ee5e6b4b0d3255bfef95601890afd80709"}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    named = warc.round_trip(spark.createDataFrame([("a b/é\r\n", "u", "x"), ("+", "u", "x")], "page_id string, url string, html string")).collect()
    assert {r.page_id for r in named} == {"a b/é\r\n", "+"}
    long = warc.round_trip(spark.createDataFrame([("p" * 12_000, "http://a.com/" + "u" * 1_500_000, "x"), ("é" * 4_000, "u", "x" * 2000), ("q", "u", "x" * 2000)], "page_id string, url string, html string")).collect()
    assert {(len(r.page_id), r.refers_to) for r in long} == {(12_000, None), (4_000, None), (1, "é" * 4_000)}


def test_frequent_payloads_are_joined_apart(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "HOT", 3)
    rows = [(i, f"u{i}", ("hot" if i % 3 == 0 else f"p{i % 20}") + "x" * 2000) for i in range(120)] + [(None, None, None), (500, "u", "short"), (501, "u", "short")]
    planned = warc.plan_revisits(spark.createDataFrame(rows, "page_id long, url string, html string"), Workspace(spark, "test")).collect()
    largest = {}
    for page, _, html in rows:
        largest[html] = max(largest.get(html, -1), -1 if page is None else page)
    want = {page: None if html is None or len(html) < 1000 or largest[html] == page else largest[html] for page, _, html in rows}
    assert {r.page_id: r.original for r in planned} == want and len(planned) == len(rows)
