"""WARC: round trips, revisits, and salvage of damaged archives with logged gaps."""

import gzip
import hashlib
import random

from wakeline.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def page(k, size=300):
    return f"<p>{k}</p>" + "x" * size


def archive(n=6):
    """(member bytes of n records)."""
    out = []
    for k in range(n):
        body = page(k).encode()
        out.append(warc.gzip_member(warc.record(k, f"http://h/{k}", body, hashlib.sha256(body).hexdigest(), None)))
    return out


def ids(found):
    return [int(x["record_id"][10:-1]) for x in found if x["kind"] == "record"]


def gaps(found):
    return [(x["offset"], x["length"]) for x in found if x["kind"] == "gap"]


def test_round_trip_with_revisits(spark):
    rows = [(1, "http://a/?q=ü&x=<1>", page(1), ""), (2, None, page(1), ""), (3, "http://b/", "tiny", ""), (4, "http://b/2", "tiny", ""), (5, "u", None, ""), (6, "u", "", ""), (7, "u", "ü" * 50, ""), (8, "u", "ü" * 50, ""), (0, "u", "line\r\n\r\nline" * 20, "")]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    raw = {i: (h or "").encode() for i, _, h, _ in rows}
    first = {2: 1, 8: 7}
    assert got == {i: (len(b), hashlib.sha256(b).hexdigest(), "revisit" if i in first else "response", first.get(i)) for i, b in raw.items()}


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, page(1), ""), (3, "u", page(1), ""), (3, "u", page(1), "")], SCHEMA)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [(-1, "revisit", 3), (3, "response", None), (3, "response", None)]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_gzip_and_carry_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(k, "u", page(k), "") for k in range(20)], SCHEMA), path)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert files and sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 20
    got = {r.record_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).where("kind = 'record'").collect()}
    assert got == {f"<urn:page:{k}>": page(k) for k in range(20)}


def test_intact_archive():
    members = archive()
    for data in (b"".join(members), warc.EMPTY_MEMBER.join(members), b"".join(map(gzip.decompress, members))):
        found = list(warc.salvage(data))
        assert ids(found) == list(range(6)) and not gaps(found)


def test_damaged_member_is_skipped_and_logged():
    members = archive()
    for k in range(6):
        for at in (0, 5, 20, len(members[k]) // 2, len(members[k]) - 3):
            bad = bytearray(members[k])
            bad[at] ^= 0xFF
            found = list(warc.salvage(b"".join(members[:k]) + bytes(bad) + b"".join(members[k + 1 :])))
            lost = ids(found) != list(range(6))
            if lost:  # some header bytes of gzip carry nothing
                assert ids(found) == [j for j in range(6) if j != k]
                assert gaps(found) == [(sum(map(len, members[:k])), len(bad))]


def test_garbage_and_truncation():
    members = archive()
    r = random.Random(3)
    junk = bytes(r.randrange(256) for _ in range(500)) + warc.MAGIC + b"no member"
    data = junk + members[0] + junk + b"".join(members[1:5]) + members[5][:-20]
    found = list(warc.salvage(data))
    assert ids(found) == [0, 1, 2, 3, 4]
    assert gaps(found) == [(0, len(junk)), (len(junk) + len(members[0]), len(junk)), (len(data) - len(members[5]) + 20, len(members[5]) - 20)]


def test_plain_records_after_damage():
    plain = [gzip.decompress(m) for m in archive()]
    broken = plain[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    data = plain[0] + plain[1] + broken + plain[3] + plain[4][:100] + plain[5]
    found = list(warc.salvage(data))
    assert ids(found) == [0, 1, 3, 5]
    assert gaps(found) == [(len(plain[0] + plain[1]), len(broken)), (len(plain[0] + plain[1] + broken + plain[3]), 100)]
    flipped = data.replace(b"<p>3</p>", b"<p>9</p>")
    assert ids(warc.salvage(flipped)) == [0, 1, 5], "a digest that does not fit is a failed check"


def test_records_lost_and_kept_add_up():
    """Random damage anywhere: what is kept is intact, and all else is inside a gap."""
    members = archive(8)
    whole = b"".join(members)
    r = random.Random(7)
    for _ in range(40):
        bad = bytearray(whole)
        for _ in range(r.randint(1, 3)):
            a = r.randrange(len(bad))
            bad[a : a + r.randint(1, 80)] = bytes(r.randrange(256) for _ in range(r.randint(0, 80)))
        found = list(warc.salvage(bytes(bad)))
        for x in found:
            if x["kind"] == "record":
                assert x["payload_digest"] == hashlib.sha256(page(int(x["record_id"][10:-1])).encode()).hexdigest()
        covered = sorted((x["offset"], x["length"]) for x in found if x["length"])
        assert sum(n for _, n in covered) == len(bad) and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:], strict=False))


def test_gaps_reach_the_table(spark, tmp_path):
    members = archive()
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"?" * 10 + members[1])
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.kind for r in got) == ["gap", "record", "record"]
    (gap,) = (r for r in got if r.kind == "gap")
    assert (gap.offset, gap.length, gap.reason) == (len(members[0]), 10, "no gzip member") and gap.path.endswith("a.warc.gz")


def test_gzip_payloads_in_a_plain_archive():
    """Payloads that are gzip members do not cut the plain records that hold them."""

    def record(k, block):
        return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = [gzip.compress(b"first" * 50), b"plain", gzip.compress(b"third" * 50), b"last"]
    content = b"".join(record(k, b) for k, b in enumerate(blocks))
    got = list(warc.salvage(content))
    assert [x["kind"] for x in got] == ["record"] * 4 and [x["payload"] for x in got] == blocks
    assert [x["offset"] + x["length"] for x in got] == [x["offset"] for x in got[1:]] + [len(content)]
    # a gzip member after the plain records is still told apart
    got = list(warc.salvage(content + gzip.compress(record(9, b"member"))))
    assert [x["payload"] for x in got] == [*blocks, b"member"]


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    r = random.Random(2)
    bodies = {k: "".join(r.choice("abcdefghij") for _ in range(4000 if k == 7 else 300)) for k in range(30)}
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(k, "u", x, "") for k, x in bodies.items()], SCHEMA).coalesce(1), path)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("*.warc.gz"))
    assert len(sizes) > 5 and all(x <= 2000 + len(warc.EMPTY_MEMBER) for x in sizes[:-1])
    got = {x.record_id: bytes(x.payload).decode() for x in warc.read_archives(spark, path).where("kind = 'record'").collect()}
    assert got == {f"<urn:page:{k}>": x for k, x in bodies.items()}


def test_records_before_a_fault_in_a_member_are_kept():
    """A file gzipped as a whole and cut or damaged near its end leaves the records before that."""
    r = random.Random(9)
    bodies = ["".join(r.choice("abcdefghijklmnop") for _ in range(30_000)).encode() for _ in range(6)]
    plain = b"".join(warc.record(k, "u", x, hashlib.sha256(x).hexdigest(), None) for k, x in enumerate(bodies))
    whole, after = warc.gzip_member(plain), archive()[0]
    for bad in (whole[:-20_000] + after, whole[:-4] + b"\xff\xff\xff\xff" + after):
        found = list(warc.salvage(bad))
        kept = [x["record_id"] for x in found if x["kind"] == "record"]
        gap = next(x for x in found if x["kind"] == "gap")
        assert kept[:4] == [f"<urn:page:{k}>" for k in range(4)] and len(kept) >= 5 and found[-1]["kind"] == "record"
        assert (gap["offset"], gap["length"]) == (0, len(bad) - len(after)) and gap["inner_offset"]


def test_sha1_payload_digests_are_checked():
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    record = lambda body, digest: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: " + digest.encode() + f"\r\nContent-Length: {len(http + body)}\r\n\r\n".encode() + http + body + b"\r\n\r\n"
    good, bad = record(b"body", warc._digest(b"body")), record(b"b0dy", warc._digest(b"body"))
    assert [x["kind"] for x in warc.salvage(good + bad + good)] == ["record", "gap", "record"]
