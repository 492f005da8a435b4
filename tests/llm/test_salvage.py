"""Salvage of archives: members of many records, damage inside them, bodies over the limit."""

import io
import random

from cloakwork.llm import warc


def body(i, size=300):
    return b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(i).randbytes(size)


def rec(i, size=300):
    return warc.record("response", f"urn:x-page:{i}", "http://a/", body(i, size))


def ids(found):
    return [r.headers["warc-record-id"].split(":")[-1][:-1] for r in found if not r.gap]


def test_records_of_one_member():
    whole = warc.member(b"".join(rec(i) for i in range(10)))
    assert ids(warc.read(io.BytesIO(whole))) == list("0123456789")
    assert ids(warc.read(io.BytesIO(whole), 400)) == list("0123456789")  # the limit is a record's, not a member's


def test_damaged_record_between_good_ones_of_a_member():
    bad = bytearray(rec(1))
    bad[-40] ^= 1
    wrong = rec(2).replace(b"Content-Length: 319", b"Content-Length: 9319")
    data = warc.member(rec(0) + bytes(bad) + rec(3)) + warc.member(rec(4) + wrong + rec(5)) + rec(6) + wrong + rec(7)
    got = list(warc.read(io.BytesIO(data)))
    assert ids(got) == list("034567")
    assert sum(r.gap != "" for r in got) == 3


def test_cut_and_flipped_members_give_what_they_hold():
    parts = [warc.member(b"".join(rec(10 * k + i, 40_000) for i in range(6))) for k in range(3)]
    cut = parts[0][: len(parts[0]) * 2 // 3] + parts[1] + parts[2]
    got = ids(warc.read(io.BytesIO(cut)))
    assert got[:3] == list("012") and got[-12:] == [str(i) for k in (1, 2) for i in range(10 * k, 10 * k + 6)]
    flipped = bytearray(b"".join(parts))
    flipped[len(parts[0]) + len(parts[1]) // 2] ^= 0xFF
    got = ids(warc.read(io.BytesIO(bytes(flipped))))
    assert got[:8] == ["0", "1", "2", "3", "4", "5", "10", "11"] and got[-6:] == [str(i) for i in range(20, 26)]


def test_long_bodies_are_measured_not_held():
    for pack in (warc.member, bytes):
        data = b"".join(map(pack, (rec(0), rec(1, 3_000_000), rec(2))))
        got = list(warc.read(io.BytesIO(data), 100_000))
        assert ids(got) == list("012") and got[1].body == (3_000_000, warc.digest(body(1, 3_000_000)[19:])) and len(got[1].block) == 19
        assert [r.offset for r in got][0] == 0 and sum(r.length for r in got) == len(data)


def test_folded_headers_and_noise():
    folded = rec(1).replace(b"WARC-Target-URI: http://a/", b"WARC-Target-URI: http://a/\r\n b\r\n\tc")
    got = list(warc.read(io.BytesIO(b"noise\x1f\x8b\x08" + rec(0) + folded)))
    assert ids(got) == list("01") and [r.headers["warc-target-uri"] for r in got if not r.gap][1] == "http://a/ b c"
    rng = random.Random(5)
    whole, blocks = b"".join(warc.member(rec(i)) if i % 2 else rec(i) for i in range(8)), {body(i) for i in range(8)}
    for _ in range(200):
        data = bytearray(whole)
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        got = [r for r in warc.read(io.BytesIO(bytes(data))) if not r.gap]
        assert len(got) >= 5 and sum(r.block in blocks for r in got) >= len(got) - 1  # a flipped digest header leaves a block unchecked


def test_an_archive_a_task(spark):
    files = [(f"file:///x/{i}",) for i in range(9)]
    listed = spark.createDataFrame(files, "path string")
    dealt = warc.dealt(listed, 100)
    assert sorted(len(x) for x in dealt.rdd.glom().collect()) == [1] * 9
    assert sorted(len(x) for x in warc.dealt(listed, 4).rdd.glom().collect()) == [2, 2, 2, 3]
