from __future__ import annotations

import base64
import gzip
import hashlib
import random
import time
from collections import Counter

from palimpsest.llm import warc

DATE = "2024-01-01T00:00:00Z"


def members(n=6):
    return [warc.record(str(i), f"http://x/{i}", (f"payload {i} " * (i * 40)).encode() + b"\x00\xff", None, DATE) for i in range(n)]


def ids(data, **more):
    found, gaps = [], []
    for offset, length, gap, header, _ in warc.salvage(data, **more):
        if gap is None:
            found.append(header["warc-record-id"][len("<urn:page:") : -1])
        else:
            gaps.append((offset, length, gap))
    return found, gaps


def test_whole_archives_have_no_gaps():
    data = warc.EMPTY_MEMBER.join(members()) + warc.EMPTY_MEMBER
    assert ids(data) == (["0", "1", "2", "3", "4", "5"], [])
    assert ids(gzip.decompress(data)) == (["0", "1", "2", "3", "4", "5"], [])
    assert ids(b"") == ([], [])


def test_time_grows_as_the_archive():
    def took(n):
        data = warc.EMPTY_MEMBER.join(warc.record(str(i), "http://x", b"some payload %d " % i * 30, None, DATE) for i in range(n))
        began = time.process_time()
        assert len(ids(data)[0]) == n
        return time.process_time() - began

    small, large = min(took(2000) for _ in range(2)), took(8000)
    assert large < 8 * small + 0.1  # 4 times the records; a reader that copies the rest at each takes 16 times as long


def test_time_grows_as_the_damage():
    noise = {
        "version lines": lambda n: b"WARC/1.0\r\n" * n,
        "version lines in values": lambda n: b"WARC/1.0\r\n" + b"x: WARC/1.0\r\n" * n,
        "headers without length": lambda n: b"WARC/1.0\r\n" + b"x: WARC/1.0\r\n" * n + b"\r\n",
        "headers that break off": lambda n: b"WARC/1.0\r\n" + b"x: WARC/1.0\r\n" * n + b"y\r\n\r\n",
    }
    last = members(1)[0]

    def took(data, n_found):
        began = time.process_time()
        found, gaps = ids(data)
        assert len(found) == n_found and gaps
        return time.process_time() - began

    for kind, make in noise.items():
        for data in (lambda n: make(n) + last, lambda n: gzip.compress(make(n), 1) + last, lambda n: make(n) + gzip.decompress(last)):  # noqa: B023
            # Behind what never ends its header, a plain record belongs to that header.
            n_found = len(ids(data(3))[0])
            small, large = min(took(data(5_000), n_found) for _ in range(2)), took(data(20_000), n_found)
            assert large < 8 * small + 0.1, kind


def test_every_damaged_byte_costs_one_record_at_most():
    parts = members(4)
    data = b"".join(parts)
    rng = random.Random(1)
    for at in rng.sample(range(len(data)), 150):
        broken = bytearray(data)
        broken[at] ^= 0x5A
        hit = next(k for k in range(4) if at < sum(map(len, parts[: k + 1])))
        found, gaps = ids(bytes(broken))
        assert [i for i in found if i != str(hit)] == [str(i) for i in range(4) if i != hit]
        if str(hit) not in found:
            assert gaps == [(sum(map(len, parts[:hit])), len(parts[hit]), gaps[0][2])]


def test_plain_records_after_damage():
    parts = [gzip.decompress(m) for m in members(4)]
    start = len(parts[0])
    longer = parts[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)  # the HTTP head's or the record's
    wrong = parts[1].replace(b"sha1:", b"sha1:A")
    for bad in (longer, wrong, parts[1][:-4], parts[1].replace(b"WARC/1.1", b"WARC/9.9", 1), b"noise"):
        found, gaps = ids(parts[0] + bad + parts[2] + b"\x1f\x8b\x08 no member" + parts[3])
        assert found == ["0", "2", "3"]
        assert [(o, n) for o, n, _ in gaps][0] == (start, len(bad)) and len(gaps) == 2


def test_truncated_and_oversized():
    parts = members(3)
    data = b"".join(parts)
    found, gaps = ids(data[:-5])
    assert found == ["0", "1"] and gaps == [(len(parts[0]) + len(parts[1]), len(parts[2]) - 5, "gzip member without end")]
    found, gaps = ids(data, most=600)
    assert "2" not in found and gaps


def test_records_inside_a_damaged_member(monkeypatch):
    parts = [gzip.decompress(m) for m in members(6)]
    wrong = parts[2].replace(b"sha1:", b"sha1:A")
    inner = b"".join([*parts[:2], wrong, *parts[3:]])
    one, after = gzip.compress(inner, mtime=0), members(8)[7]
    start = len(parts[0] + parts[1])
    for piece in (warc.PIECE, 300, 7):
        monkeypatch.setattr(warc, "PIECE", piece)
        found, gaps = ids(one + after)
        assert found == ["0", "1", "3", "4", "5", "7"]
        assert [(o, n) for o, n, _ in gaps] == [(0, len(one))] and f"{start}-{start + len(wrong)} of the member at 0" in gaps[0][2]
        found, gaps = ids(gzip.compress(b"".join(parts), mtime=0)[:-5])
        assert found == ["0", "1", "2", "3", "4"] and len(gaps) == 1
        found, gaps = ids(gzip.compress(b"".join(parts), mtime=0), most=len(parts[4]))
        assert found == ["0", "1", "2", "3", "4"] and gaps
        whole = bytearray(gzip.compress(b"".join(parts), 0, mtime=0) + after)
        whole[-len(after) - 1] ^= 1  # the member's own sum; stored bytes show their version lines
        found, gaps = ids(bytes(whole))
        assert found == ["0", "1", "2", "3", "4", "7"] and gaps


def test_round_trip_with_nulls_and_repeats(spark, tmp_path):
    rows = [(3, "http://a b/\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "u", "same"), (7, "ü", "other\r\n\r\nWARC/1.1\r\n"), (7, "ü", "other\r\n\r\nWARC/1.1\r\n"), (9, "u", "é" * 50_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, _id string, payload int")
    path = f"{tmp_path}/w"
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).where("gap is null").collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = Counter()
    for i, _, t in rows:
        one = first[t or ""]
        revisit = i != one
        want[(None if i is None else str(i), len((t or "").encode()), digest(t), "revisit" if revisit else "response", str(one) if revisit else None)] += 1
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    bodies = {r.record_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert bodies["7"] == rows[5][2] and bodies["9"] == rows[7][2] and bodies["1"] == "same"
    assert next(r.uri for r in got if r.record_id == "3") == "http://a%20b/%0D%0AX:%20y"


def test_gaps_are_logged_by_archive(spark, tmp_path):
    parts = members(3)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"junk" + parts[1])
    (tmp_path / "b.warc.gz").write_bytes(parts[2])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    gaps = [(r.archive[-9:], r.offset, r.length, r.gap) for r in rows if r.gap]
    assert gaps == [("a.warc.gz", len(parts[0]), 4, "no version line")]
    assert sorted(r.record_id for r in rows if not r.gap) == ["0", "1", "2"]


def test_small_payloads_are_never_revisits_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w", min_revisit_bytes=3)
    got = {r.record_id: r.record_type for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    warc.write_warc(pages.where("false"), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0
