"""WARC archives: round trips, revisits, and what is left of damaged archives."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mrkit.llm import warc
from mrkit.session import shared_folder

LONG = "<p>" + "a long page é " * 200_000
PAGES = [
    (7, "http://a/7", "<p>copied</p>", "x"),
    (3, "http://a/3", "<p>copied</p>", "x"),
    (None, "http://a/", "<p>copied</p>", "x"),
    (5, None, None, None),
    (4, "http://a/4 with space\r\nX: y", "", "x"),
    (8, "http://a/8", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n", "x"),
    (9, "http://a/9", LONG, "x"),
    (10, "http://a/10", LONG, "x"),
    (11, "http://a/11", "own", "x"),
    (11, "http://a/11", "own", "x"),
    (None, None, "without an id", "x"),
]
SCHEMA = "page_id long, url string, html string, refers_to string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute_force(pages, least=0):
    rows = []
    for page_id, _, html, _ in pages:
        payload = (html or "").encode()
        ids = [i for i, _, other, _ in pages if (other or "").encode() == payload and i is not None]
        other = min(ids) if ids and page_id != min(ids) and len(payload) >= least else None
        rows.append((page_id, len(payload), digest(html), "response" if other is None else "revisit", other))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


def test_round_trip(spark, pages):
    for least, archive_bytes in ((0, warc.ARCHIVE_BYTES), (0, 1), (14, 100)):
        found = sorted(map(tuple, warc.round_trip(pages, least, archive_bytes).collect()), key=str)
        assert found == brute_force(PAGES, least)
    assert warc.round_trip(pages.where("page_id < 0")).collect() == []


def test_archives_are_deleted(spark, pages):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.rglob("*.txt"))
    warc.round_trip(pages)
    assert set(folder.rglob("*.txt")) == before


def test_payloads_and_places(spark, pages):
    with shared_folder(spark) as folder:
        warc.write_archives(pages.coalesce(1), folder)
        rows = warc.read_archives(spark, folder).collect()
        archive = next(Path(folder.removeprefix("file:")).glob("*.txt")).read_bytes()
        assert gzip.decompress(archive).count(b"WARC-Record-ID") == len(PAGES)
        html = {f"<urn:page:{i}>": (h or "").encode() for i, _, h, _ in PAGES}
        for row in rows:
            own = gzip.decompress(archive[row.start : row.start + row.length])
            assert own.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {row.record_id}\r\n".encode() in own
            assert row.problem is None and row.archive.startswith("file:")
            if row.record_type == "response" and row.record_id != "<urn:page:none>":
                assert row.payload == html[row.record_id]
        targets = {row.record_id: row.target for row in rows}
        assert targets["<urn:page:4>"] == "http://a/4%20with%20space%0D%0AX:%20y" and targets["<urn:page:5>"] is None
        place = next(r for r in rows if r.record_id == "<urn:page:9>")
        damaged = bytearray(archive)
        damaged[place.start + place.length // 2] ^= 1
    found = list(warc.salvage(bytes(damaged)))
    assert gaps(found) == [(place.start, place.start + place.length)]
    assert len(found) == len(PAGES)


def records(n, plain=()):
    """Records of ``n`` pages as they stand in an archive, plain where their number says so."""
    whole = [warc.page_record(i, f"http://a/{i}", b"<p>%d " % i * (5 + i), None) for i in range(n)]
    return [record if i in plain else warc.member(record) for i, record in enumerate(whole)]


def ids(found):
    return [int(f.headers["warc-record-id"][10:-1]) for f in found if not f.problem]


def gaps(found):
    return [(f.start, f.end) for f in found if f.problem]


@pytest.mark.parametrize("plain", [(), range(6), (0, 3), (2, 5)])
def test_damage_is_quarantined(plain):
    parts = records(6, plain)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list(range(6)) and gaps(warc.salvage(whole)) == []
    for i in range(6):
        middle = starts[i] + len(parts[i]) // 2
        flipped = whole[:middle] + bytes([whole[middle] ^ 1]) + whole[middle + 1 :]
        found = list(warc.salvage(flipped))
        assert ids(found) == [j for j in range(6) if j != i] and gaps(found) == [(starts[i], starts[i + 1])]
        # Bytes lost from a record, and junk that looks like a beginning between two.
        lost = list(warc.salvage(whole[: middle - 3] + whole[middle:]))
        assert ids(lost) == [j for j in range(6) if j != i] and gaps(lost) == [(starts[i], starts[i + 1] - 3)]
        junk = b"junk\nWARC/1.0\r\nno header\r\n\r\n" + warc.MEMBER + b"junk\n"
        inserted = list(warc.salvage(whole[: starts[i]] + junk + whole[starts[i] :]))
        assert ids(inserted) == list(range(6)) and gaps(inserted) == [(starts[i], starts[i] + len(junk))]
    cut = list(warc.salvage(whole[:-5]))
    assert ids(cut) == list(range(5)) and gaps(cut) == [(starts[5], len(whole) - 5)]
    assert list(warc.salvage(b"")) == [] and gaps(warc.salvage(b"\x00\x01")) == [(0, 2)]


def test_member_of_several_records():
    parts = records(4, range(4))
    assert ids(warc.salvage(warc.member(b"".join(parts)))) == list(range(4))
    parts[1] = parts[1].replace(b"<p>1", b"<p>x", 1)
    packed = warc.member(b"".join(parts))
    found = list(warc.salvage(records(1)[0] + packed))
    assert ids(found) == [0, 0, 2, 3]
    (gap,) = [f for f in found if f.problem]
    assert gap.end - gap.start == len(packed) and "of the member" in gap.problem and "digest" in gap.problem


def test_digests_and_lengths_are_checked():
    good = warc.page_record(1, "http://a", b"payload", None)
    header = lambda name, value: b"\r\n".join(
        name + b": " + value if line.startswith(name) else line for line in good.split(b"\r\n")
    )
    for bad, problem in (
        (header(b"WARC-Block-Digest", b"sha1:AAAA"), "block"),
        (header(b"WARC-Payload-Digest", b"sha1:AAAA"), "payload"),
        (header(b"Content-Length", b"7"), "where its length says"),
        (header(b"Content-Length", b"-7"), "no length"),
        (header(b"WARC-Date", b"x\r\nnonsense"), "no name"),
        (good.replace(b"WARC/1.1", b"WARC/9.9"), "no version line"),
    ):
        (gap,) = list(warc.salvage(bad))
        assert problem in gap.problem and (gap.start, gap.end) == (0, len(bad))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6), st.data())
def test_any_bytes_between_and_any_cut(payloads, data):
    """Whatever stands between records, nothing crashes, and found places are in order and inside of the archive."""
    parts = []
    for i, payload in enumerate(payloads):
        record = warc.page_record(i, None, payload, None)
        parts += [data.draw(st.binary(max_size=20)), warc.member(record) if data.draw(st.booleans()) else record]
    archive = b"".join(parts)
    archive = archive[: data.draw(st.integers(0, len(archive)))]
    places = [(f.start, f.end) for f in warc.salvage(archive)]
    assert all(a < b for a, b in places) and all(x[1] <= y[0] for x, y in zip(places, places[1:]))
    assert not places or places[-1][1] <= len(archive)


def test_the_log_of_gaps(spark, tmp_path):
    parts = records(3)
    (tmp_path / "one.warc.gz").write_bytes(parts[0] + b"lost bytes" + parts[1])
    (tmp_path / "two.warc").write_bytes(b"".join(records(2, range(2))) + parts[2][:-1])
    rows = warc.read_archives(spark, str(tmp_path), payloads=False).collect()
    assert sorted((Path(r.archive).name, r.start, r.length) for r in rows if r.problem) == [
        ("one.warc.gz", len(parts[0]), 10),
        ("two.warc", sum(map(len, records(2, range(2)))), len(parts[2]) - 1),
    ]
    assert sorted(r.record_id for r in rows if not r.problem) == ["<urn:page:0>"] * 2 + ["<urn:page:1>"] * 2
    assert all(r.payload is None and r.payload_bytes for r in rows if not r.problem)
