"""WARC archives: a writer that records repeated payloads as revisits, and a reader that salvages damaged archives.

Writing is a Spark text write of whole gzip members, one a record, compressed inside the tasks (a member's last byte is
the writer's line separator), so that it has Spark's commit protocol on any file system and damage costs the records it
lies in. The reader takes plain archives and gzip members of one record or many. When a record fails a check (version
line, headers, length, end mark, payload digest, compression) it keeps what was read before, searches for the next gzip
member or version line that begins a valid record, goes on there, and reports the bytes between as a quarantined gap. So
is each record of a damaged member that no digest confirms, such as a revisit, with its place inside.

Defined cases: a null payload counts as empty; an empty payload is a payload like any other; of rows with equal
payloads and the same largest key, all are responses; null keys are written as such and revisit if a key is there;
repeated rows are each written; an empty table makes no archive and gives no records; other columns don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



VERSION = b"WARC/1.1\r\n"
#: Bytes that an archive's members should hold; the mean record size turns them into a number of records per file.
ARCHIVE_BYTES = 32 << 20
_START = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")
#: Where headers end, or where another version line shows that they don't.
_HEAD_END = re.compile(rb"\r\n\r\n|\nWARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
#: The text writer's line separator. A member ends in the top byte of its content's size, which is 0 under 16 MB.
_LAST = b"\0"
_EMPTY = gzip.compress(b"", mtime=0)
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Base32 SHA-1 of a string's UTF-8 bytes: each 5 hexadecimal digits are 4 digits of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def with_responses(rows: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """`rows` with digest, n_bytes and refers_to: the largest key with the same payload, null on that row itself."""
    rows = rows.withColumn("digest", base32_sha1(F.col(payload))).withColumn("n_bytes", F.octet_length(payload).cast("long"))
    groups = rows.select("digest", key, "n_bytes").where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max(key).alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = rows.join(groups, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("response")), F.col("response"))).drop("response")


def record(key: Column, uri: Column, payload: Column, digest: Column, n_bytes: Column, refers_to: Column) -> Column:
    """A whole record as text. A revisit holds the response's HTTP headers only."""
    line = "\r\n"
    ident = lambda k: F.concat(F.lit("<urn:kbspark:"), F.coalesce(k.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n_bytes.cast("string"), F.lit(line * 2))
    revisit = refers_to.isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    headers = F.concat_ws(
        line,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), ident(key)),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(uri, F.lit("")), "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), ident(refers_to))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(headers, F.lit(line * 2), block, F.lit("\r\n\r\n"))


def member(content: bytes) -> bytes:
    """`content` as a gzip member, less its last byte, _LAST. From 16 MB on an empty member follows, as it ends in _LAST."""
    made = gzip.compress(content, 6, mtime=0)
    return (made if made.endswith(_LAST) else made + _EMPTY)[: -len(_LAST)]


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, held = [], 0
        for value in batch["value"]:
            made.append(member(value.as_buffer().to_pybytes()))
            held += len(made[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_pydict({"value": pa.array(made, pa.binary())})
                made, held = [], 0
        if made:
            yield pa.RecordBatch.from_pydict({"value": pa.array(made, pa.binary())})


def write(df: DataFrame, path: str, key: str, uri: str, payload: str, least_bytes: int = 0) -> None:
    """Archives of all rows under `path`, in the rows' partitions, about ARCHIVE_BYTES of content each."""
    rows = df.select(key, uri, F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    mean = rows.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    rows = with_responses(rows, key, "payload", least_bytes)
    text = rows.select(record(F.col(key), F.col(uri), F.col("payload"), F.col("digest"), F.col("n_bytes"), F.col("refers_to")).alias("value"))
    packed = text.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    packed.write.option("compression", "none").option("lineSep", _LAST.decode()).option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (mean + 500)))).text(path)


RECORD = "path string, at long, end long, inner long, kind string, reason string, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def parsed(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that begins at `at` and where it ends, or why there is none."""
    ends = _HEAD_END.search(data, at) if data.startswith(b"WARC/1.", at) else None
    if ends is None or not ends[0].startswith(b"\r"):
        return "no version line or headers"
    lines = data[at : ends.start()].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch("[0-9]+", headers.get("content-length", "")):
        return "no length"
    start = ends.end()
    end = start + int(headers["content-length"])
    if not data.startswith(b"\r\n\r\n", end):
        return "no end mark where the length points to"
    block = memoryview(data)[start:end]
    found = {"record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to")}
    payload, stated, full = block, headers.get("warc-payload-digest", ""), len(block)
    if "application/http" in headers.get("content-type", ""):
        body = data.find(b"\r\n\r\n", start, end)
        if body < 0:
            return "no end of HTTP headers"
        payload = block[body + 4 - start :]
        told = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)\r\n", data[start : body + 2])
        full = int(told[1]) if told else len(payload)
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found["record_type"] != "revisit" and stated.startswith("sha1:") and stated[5:] != own:
        return "payload digest differs"
    if found["record_type"] == "revisit":
        return found | {"payload_digest": stated.removeprefix("sha1:"), "payload_bytes": full, "payload": None, "confirmed": False}, end + 4
    return found | {"payload_digest": own, "payload_bytes": len(payload), "payload": payload, "confirmed": stated.startswith("sha1:")}, end + 4


def unpacked(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` holds, as far as it can be read, where it ends, and what is wrong with it ('' if nothing)."""
    inflate, out, end = zlib.decompressobj(wbits=31), [], at
    while end < len(data) and not inflate.eof:
        try:
            out.append(inflate.decompress(data[end : end + 65536]))
        except zlib.error as e:
            # Once more, the last piece byte by byte: what lies in it before the damage is read too.
            inflate, fault = zlib.decompressobj(wbits=31), end
            inflate.decompress(data[at:end])
            try:
                for fault in range(end, len(data)):
                    out.append(inflate.decompress(data[fault : fault + 1]))
            except zlib.error:
                pass
            return b"".join(out), fault, f"gzip: {e}"
        end = min(end + 65536, len(data))
    return b"".join(out), end - len(inflate.unused_data), "" if inflate.eof else "gzip: cut off"


def records(data: bytes) -> Iterator[dict]:
    """Records of an archive in their order, with gaps between them: kind 'record' or 'gap', positions and reason.

    In a gzip member, which may hold a record or many, `at` and `end` are the member's and `inner` is the place inside.
    """
    at, bad, reason, view = 0, None, "", memoryview(data)
    line, found = 0, 0  # the next version line and member, looked for once passed
    while at < len(data):
        got, inner = "", []
        if data.startswith(_MEMBER, at):
            content, end, got = unpacked(view, at)
            # Of a damaged member only records count that their own digest confirms; the others are told as gaps.
            inner = [r if not got or r["kind"] == "gap" or r["confirmed"] else {"at": r["at"], "end": r["end"], "kind": "gap", "reason": f"{got}; not confirmed: {r['record_id']}"} for r in records(content)]
            if got and not any(r["kind"] == "record" for r in inner):
                inner = []  # the gap over the whole member tells it
            if not got and content and not any(r["kind"] == "record" for r in inner):
                got = "gzip member without a record"
        else:
            one = parsed(data, at)
            if isinstance(one, str):
                got = one
            else:
                inner, end = [one[0] | {"at": 0, "kind": "record"}], one[1]
        if inner and bad is not None and (not got or any(r["kind"] == "record" for r in inner)):
            yield {"at": min(bad, at), "end": at, "kind": "gap", "reason": reason}
            bad = None
        if inner:
            yield from (r | {"inner": r["at"], "at": at, "end": end} for r in inner)
        if not got:
            at = end
            continue
        # Quarantine from here, after what was saved, to the next member or version line that begins something valid.
        if bad is None:
            bad, reason = (end if inner else at), got
        if line <= at:
            line = m.start() if (m := _START.search(data, at + 1)) else len(data)
        if found <= at:
            found = m if (m := data.find(_MEMBER, at + 1)) > 0 else len(data)
        at = min(line, found)
    if bad is not None:
        yield {"at": bad, "end": len(data), "kind": "gap", "reason": reason}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under `path`; one task reads an archive, which the writer keeps small."""
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 7, pa.int64(), pa.binary()]
    schema = pa.schema(list(zip((x.split()[0] for x in RECORD.split(", ")), kinds)))

    def salvage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for r in records(content.as_buffer().to_pybytes()):
                    p = r.get("payload") if payloads else None
                    rows.append(r | {"path": name.as_py(), "payload": bytes(p) if p is not None else None})
                    held += len(p or b"")
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(salvage, RECORD)
