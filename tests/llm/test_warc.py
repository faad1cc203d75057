import base64
import gzip
import hashlib
import random
import time
import uuid
from pathlib import Path

import pytest

from glebe.llm import warc


def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" if i % 3 else "hot page") for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nWARC-Type: evil 100%", ""), (102, "u", "é😀" * 10), (103, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 50),
             (None, "u", "only here"), (None, "u", "hot page"), (104, "u", "twice"), (104, "u", "twice"), (105, "u", "x" * 300_000)]
    return spark.createDataFrame([(*r, "extra", None) for r in rows], "page_id bigint, url string, html string, key string, sha1 string").repartition(5)


def plain(rows, least):
    largest = {}
    for key, _, html in rows:
        html = html or ""
        if key is not None:
            largest[html] = max(key, largest.get(html, key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = largest.get(html or "")
        revisit = len(data) >= least and top is not None and key != top
        out.append((str(key), len(data), digest, "revisit" if revisit else "response", str(top) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, tmp_path, least):
    frame = pages(spark)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(frame, path, min_bytes=least)
    pieces = warc.read_archives(spark, path)
    assert warc.gaps(pieces).count() == 0
    got = [(str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(pieces).collect()]
    rows = [(r.page_id, r.url, r.html) for r in frame.collect()]
    assert sorted(got, key=str) == plain(rows, least)
    payloads = {r.key: bytes(r.payload) for r in warc.records(pieces).filter("record_type = 'response'").collect()}
    assert payloads["102"] == "é😀".encode() * 10 and payloads["100" if least else "101"] == b""
    uris = {r.key: r.uri for r in warc.records(pieces).collect()}
    assert uris["100"] is None and uris["101"] == "u%0D%0AWARC-Type: evil 100%25"
    # The files are ordinary gzip: any reader unpacks them.
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in Path(path).glob("part-*") if f.stat().st_size)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: re") == len(rows)


def test_no_pages(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(pages(spark).limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def record(key, payload, kind="response"):
    return warc._record(kind, key, f"http://x/{key}", warc.DATE, warc.payload_digest(payload), len(payload), payload, None)


def archive(packed):
    records = [record(str(i), random.Random(i).randbytes(200 + i)) for i in range(12)]
    members = [gzip.compress(r, mtime=0) if packed else r for r in records]
    starts = [sum(map(len, members[:i])) for i in range(13)]
    return b"".join(members), starts


def keys(pieces):
    return [warc._key(p.headers["warc-record-id"]) for p in pieces if p.reason is None]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_the_damaged_records(packed):
    data, starts = archive(packed)
    assert keys(warc.salvage(data)) == [str(i) for i in range(12)]
    for seed in range(60):
        rng = random.Random(seed)
        broken = bytearray(data)
        hurt = set()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(data) - 20)
            for i in range(at, at + rng.randrange(1, 20)):
                broken[i] ^= rng.randrange(1, 256)
                hurt.add(max(k for k in range(12) if starts[k] <= i))
        pieces = list(warc.salvage(bytes(broken)))
        lost = {str(i) for i in range(12)} - set(keys(pieces))
        assert lost <= {str(i) for i in hurt}
        # Records and gaps cover all bytes but padding, and every lost record lies in a gap.
        spans = sorted((p.start, p.end) for p in pieces)
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] >= b[0] for a, b in zip(spans, spans[1:]))
        for k in map(int, lost):
            assert any(p.start <= starts[k] < p.end if p.reason else p.start == starts[k] for p in pieces)


@pytest.mark.parametrize("packed", [True, False])
def test_cut_and_foreign_bytes(packed):
    data, starts = archive(packed)
    cut = data[:starts[11] + 30]
    pieces = list(warc.salvage(cut))
    assert keys(pieces) == [str(i) for i in range(11)]
    assert [(p.start, p.end) for p in pieces if p.reason] == [(starts[11], len(cut))]
    missing = data[:starts[3] + 40] + data[starts[5]:]
    assert keys(warc.salvage(missing)) == ["0", "1", "2", *map(str, range(5, 12))]
    junk = data[:starts[4]] + b"\x1f\x8b\x08junk" * 50 + b"\nWARC/1.1\r\n" + data[starts[4]:]
    pieces = list(warc.salvage(junk))
    assert keys(pieces) == [str(i) for i in range(12)]
    (gap,) = [p for p in pieces if p.reason]
    assert (gap.start, gap.end) == (starts[4], starts[4] + len(junk) - len(data))
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"\0\0")) != []
    assert [p.reason is None for p in warc.salvage(b"no archive at all")] == [False]


def test_several_records_in_a_member_and_no_digests():
    plain_ = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    bad = plain_.replace(b"4\r\n\r\n", b"9\r\n\r\n", 1)
    pieces = list(warc.salvage(gzip.compress(plain_ + bad + plain_)))
    assert [p.block for p in pieces if p.reason is None] == [b"abcd", b"abcd"] and sum(p.reason is not None for p in pieces) == 1


def test_quarantine_log_of_damaged_files(spark, tmp_path):
    data, starts = archive(True)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/good.warc.gz").write_bytes(data)
    (tmp_path / "a/bad.warc.gz").write_bytes(data[:starts[2]] + b"?" * 50 + data[starts[3]:])
    (tmp_path / "a/empty.warc.gz").write_bytes(b"")
    pieces = warc.read_archives(spark, f"{tmp_path}/a", with_payload=False)
    assert warc.records(pieces).count() == 23
    (gap,) = warc.gaps(pieces).collect()
    assert gap.path.endswith("bad.warc.gz") and (gap.start, gap.end) == (starts[2], starts[2] + 50)


def test_damage_takes_linear_time():
    started = time.perf_counter()
    for bare in (b"WARC/1.0\r\n", b"WARC/1.0\r\na: b\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\n", b"\x1f\x8b\x08\x00"):
        data = bare * (10_000_000 // len(bare))
        assert [p.reason is None for p in warc.salvage(data)] == [False]
    assert time.perf_counter() - started < 60


def test_lost_records_are_an_error_where_asked(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nbroken")
    pieces = warc.read_archives(spark, str(tmp_path))
    assert warc.records(pieces).count() == 0 and warc.gaps(pieces).count() == 1
    with pytest.raises(Exception, match="gap in"):
        warc.whole_records(pieces).collect()
