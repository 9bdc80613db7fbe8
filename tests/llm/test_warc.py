import gzip
import random

from kbspark.llm import warc

HEAD = "WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\nContent-Type: text/plain\r\nContent-Length: {size}\r\n\r\n"


def record(n: int, payload: bytes, kind: str = "resource") -> bytes:
    return HEAD.format(kind=kind, n=n, size=len(payload)).encode() + payload + b"\r\n\r\n"


def ids(data: bytes) -> list[str]:
    return [r["record_id"] for r in warc.records(data) if r["kind"] == "record"]


def gaps(data: bytes) -> list[tuple[int, int]]:
    return [(r["at"], r["end"]) for r in warc.records(data) if r["kind"] == "gap"]


def test_plain_and_members():
    parts = [record(i, b"x" * i * 50 + b"\r\nWARC/1.1\r\nnot a record") for i in range(5)]
    assert ids(b"".join(parts)) == [f"<urn:x:{i}>" for i in range(5)]
    assert ids(b"".join(map(gzip.compress, parts))) == [f"<urn:x:{i}>" for i in range(5)]
    assert ids(gzip.compress(b"".join(parts))) == [f"<urn:x:{i}>" for i in range(5)]
    assert not gaps(b"".join(parts)) and not gaps(b"".join(map(gzip.compress, parts)))
    assert ids(b"") == []


def test_salvage_plain():
    a, b, c = record(1, b"one"), record(2, b"two" * 100), record(3, b"three")
    wrong = b.replace(b"Content-Length: 300", b"Content-Length: 290")
    assert ids(a + wrong + c) == ["<urn:x:1>", "<urn:x:3>"]
    assert gaps(a + wrong + c) == [(len(a), len(a) + len(wrong))]
    assert ids(b"garbage\n" + a + b"noise" + c[:20]) == ["<urn:x:1>"]


def test_salvage_members():
    rng = random.Random(1)
    members = [gzip.compress(record(i, bytes(rng.choice(b"0123456789abcdef") for _ in range(3000)))) for i in range(4)]
    hurt = bytearray(members[1])
    hurt[200:260] = b"\0" * 60
    data = members[0] + bytes(hurt) + members[2] + members[3][:-9]
    assert ids(data)[:2] == ["<urn:x:0>", "<urn:x:2>"]
    assert gaps(data)[0][1] == len(members[0]) + len(hurt)


def test_payload_digest():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:9>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert ids(good) == [] and gaps(good) == [(0, len(good))]


def test_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u5", "é \r\n\r\nWARC/1.1\r\n" * 50), (6, "u6", "same"), (6, "u6", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload")
    warc.write(df, str(tmp_path / "w"), "page_id", "url", "html")
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    u = "<urn:kbspark:{}>".format
    assert got == {(u(1), "revisit", u(6), 4), (u(2), "revisit", u(6), 4), (u(3), "revisit", u(4), 0), (u(4), "response", None, 0), (u(5), "response", None, 50 * 17), (u(6), "response", None, 4)}
    payloads = {r.record_id: bytes(r.payload or b"") for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert payloads[u(5)].decode() == rows[4][2]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "e"), "page_id", "url", "html")
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_damaged_archives_of_the_writer(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"u{i}", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9999)) for _ in range(200))) for i in range(300)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "d"), "page_id", "url", "html")
    (file,) = (tmp_path / "d").glob("part-*")
    data = file.read_bytes()
    assert len(ids(data)) == 300 and not gaps(data)
    # Any gzip reader takes the archive as a whole.
    assert gzip.decompress(data).count(b"\r\nWARC-Type: ") == 300
    for at in (len(data) * k // 20 for k in range(1, 20)):
        flipped = data[:at] + bytes([data[at] ^ 16]) + data[at + 1 :]
        for hurt, most in ((flipped, 1), (data[:at] + b"\0" * 60 + data[at + 60 :], 2), (data[:at] + b"\0" * 4096 + data[at + 4096 :], 8), (data[:at] + data[at + 500 :], 2)):
            assert 300 - most <= len(set(ids(hurt))) < 301
            assert len(set(ids(hurt))) == 300 or gaps(hurt)


def test_long_records(spark, tmp_path):
    rows = [(1, "u" * 100_000, "a"), (2, "u2", "b" * (17 << 20)), (3, "u3", "c")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "l"), "page_id", "url", "html")
    got = {r.record_id: (len(r.uri), r.payload_bytes) for r in warc.read(spark, str(tmp_path / "l"), payloads=False).collect()}
    assert got == {"<urn:kbspark:1>": (100_000, 1), "<urn:kbspark:2>": (2, 17 << 20), "<urn:kbspark:3>": (2, 1)}


def test_damaged_member_of_many_records():
    rng = random.Random(3)
    parts = []
    for i in range(40):
        payload = bytes(rng.choice(b"0123456789abcdef") for _ in range(3000))
        digest = warc.base64.b32encode(warc.hashlib.sha1(payload).digest()).decode()
        parts.append(record(i, payload).replace(b"WARC-Record-ID", f"WARC-Payload-Digest: sha1:{digest}\r\nWARC-Record-ID".encode()))
    parts.insert(3, record(99, b"", "revisit"))
    data = bytearray(gzip.compress(b"".join(parts)))
    data[len(data) // 2 : len(data) // 2 + 60] = b"\xff" * 60
    found = list(warc.records(bytes(data)))
    assert len([r for r in found if r["kind"] == "record"]) >= 18
    assert any(r["kind"] == "gap" and "<urn:x:99>" in r["reason"] for r in found)


def test_query_with_negative_ids(spark, tmp_path):
    from kbspark.llm import queries

    rows = [(-5, "u", "same"), (-9, "u", "same"), (0, None, "x"), (None, "u", "y")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.record_type, r.refers_to) for r in queries.op3_warc(spark, str(tmp_path)).collect()}
    assert got == {(-5, "response", None), (-9, "revisit", -5), (0, "response", None), (None, "response", None)}
