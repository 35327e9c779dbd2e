import hashlib
import io
import random
import uuid
import zlib

import pytest

from livgrid.llm import arc_warc as A
from livgrid.llm.storage import Work

HTTP = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_is_read_by_declared_lengths(version):
    bodies = [HTTP + b"a\nhttp://x 0.0.0.0 20000101000000 text/html 3\nabc", b"", b"\n\n", "é😀".encode(), b"\x00\xff raw"]
    data = A.write_arc([(f"http://h/{i} b", "1.2.3.4", "1999", "text/html", b) for i, b in enumerate(bodies)], version)
    head, *records = A.read_arc(io.BytesIO(data))
    assert head.fields["URL"].startswith("filedesc:") and [r.body for r in records] == bodies
    assert all(len(r.fields) == len(A.ARC_FIELDS[version]) for r in records) and records[0].fields["URL"] == "http://h/0%20b"
    if version == 2:
        assert records[0].fields["Result-code"] == "404" and int(records[1].fields["Offset"]) == records[1].offset
    made = [A.to_warc(r) for r in [head, *records]]
    assert [w.headers["WARC-Type"] for w in made] == ["warcinfo", "response", *["resource"] * 4]
    assert made[1].headers["WARC-Date"] == "1999-01-01T00:00:00Z"
    back = list(A.read_warc(io.BytesIO(b"".join(w.to_bytes() + b"\r\n\r\n" for w in made))))
    assert [w.block for w in back] == [w.block for w in made] and len({w.headers["WARC-Record-ID"] for w in back}) == 6


@pytest.mark.parametrize("bad", [b"no version block\n", b"filedesc://x 0.0.0.0 2000 text/plain 4\n9 0\n\n", A.write_arc([])[:-20], A.write_arc([]) + b"http://x 1.1.1.1 2000 text/html\n", A.write_arc([]) + b"http://x 1.1.1.1 2000 text/html 50\nshort"])
def test_damaged_arc_is_an_error(bad):
    with pytest.raises(ValueError):
        list(A.read_arc(io.BytesIO(bad)))


def test_blanks_in_a_legacy_url():
    data = A.write_arc([]) + b"http://x/a b c 1.1.1.1 20010203 text/html 2\nhi\n"
    assert list(A.read_arc(io.BytesIO(data)))[1].fields["URL"] == "http://x/a b c"


def plain(rows):
    first = {}
    for i, _, h in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        if i is not None and len((h or "").encode()) >= 100:
            first[d] = min(i, first.get(d, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        d = hashlib.sha256(data).hexdigest()
        again = i is not None and len(data) >= 100 and i > first[d]
        out.append((i, len(data), d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=str)


def test_pages_and_back(spark):
    long, trap = "x" * 99 + "é", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 3
    rows = [(5, "u", long), (3, "u", long), (9, None, long), (3, "u", long), (1, "a b\n", "x" * 99), (2, "c", "x" * 99), (4, "d", None), (6, "e", ""), (7, "f", trap), (8, "g", trap), (None, "h", long), (10, "é", "\r\n\r\n" * 40)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, first string")
    for version in (1, 2):
        work = Work(spark, "t")
        A.write_archives(df, work, f"{work.path}/warc", version=version)
        got = A.read_archives(spark, f"{work.path}/warc").collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain(rows)
    assert A.archive_and_read(df.limit(0), Work(spark, "t")).count() == 0


def test_record_ids_name_pages():
    for i in (0, 1, 7, -5, 2**62, 2**63 - 1, -(2**63)):
        made = A.page_record_id(i, "sha256:00")
        assert A.page_of(made) == i and uuid.UUID(made[10:-1]).version == 8
    assert A.page_of(A.record_id("x")) is None and A.page_of(None) is None and A.page_of(A.page_record_id(None, "sha256:00", "u")) is None
    assert A.page_record_id(1, "sha256:00") != A.page_record_id(1, "sha256:01")


def test_files_are_bounded_by_bytes_and_have_a_member_a_record(spark, monkeypatch):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefghij \n") for _ in range(rng.choice((10, 3000))))) for i in range(200)]
    rows += [(1000, "http://h/big", "".join(rng.choice("abcdefghij") for _ in range(3_000_000))), *((2000 + i, "http://h/copy", rows[1][2] + "x" * 100) for i in range(20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    work = Work(spark, "t")
    A.write_archives(df, work, f"{work.path}/warc")
    files = [(r["path"], bytes(r["content"])) for r in spark.read.format("binaryFile").load(f"{work.path}/warc/*").collect()]
    files = [(p, c) for p, c in files if p.endswith(".warc.gz")]
    assert len(files) > 4
    ids = {}
    for _, content in files:
        members, rest = [], content
        while rest:
            one = zlib.decompressobj(31)
            members.append(one.decompress(rest) + one.flush())
            rest = one.unused_data
        assert members[-1] == b"" and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members[:-1])
        records = [r for m in members[:-1] for r in A.read_warc(io.BytesIO(m))]
        assert len(records) == len(members) - 1 and records[0].headers["WARC-Type"] == "warcinfo"
        assert len(records) == 2 or len(content) < 20_000 + 4_000
        ids |= {r.headers["WARC-Record-ID"]: r for r in records[1:]}
    assert not any(k.lower().startswith("x-") for r in ids.values() for k in r.headers) and not any(b"X-Archive" in r.block[:300] for r in ids.values())
    revisits = [r for r in ids.values() if r.headers["WARC-Type"] == "revisit"]
    assert len(revisits) == 19 and all(ids[r.headers["WARC-Refers-To"]].headers["WARC-Payload-Digest"] == r.headers["WARC-Payload-Digest"] for r in revisits)
    got = A.read_archives(spark, f"{work.path}/warc").collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain(rows)


def test_a_payload_of_a_third_of_all_pages(spark):
    rows = [(i, "u", "copy " * 30 if i % 3 else f"own {i} " * 30) for i in range(3000)]
    got = A.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string"), Work(spark, "t")).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain(rows)
