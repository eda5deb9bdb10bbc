"""Web archives with a salvage reader.

The writer puts one gzip member a record, so any member can be read without
those before it. A record carries the SHA-1 of its block and of its full
payload. Of pages with equal payloads of at least MIN_REVISIT bytes the one with
the largest page_id is a response; the others are revisit records that refer to
it and hold only the HTTP head, whose Content-Length tells the payload's bytes.

The reader checks each member: gzip checksum, version line, head, block length
and digests. After a failed check it searches for the next gzip magic or version
line from one byte on, takes the first place from which a whole valid record can
be read, and logs the bytes between as a quarantined gap (from, to, reason).
Records may be of any length; a reader may set a limit, beyond which an inflated
member counts as damaged and is reported as a gap. Bare (uncompressed) records are
read too, by version line and length.

Null html is an empty payload. Null page_ids come back as null (the smallest of
equal payloads' ids; such rows never stand for others that have an id). Repeated
rows are records each; of equal payloads that share the largest page_id all are
responses. Archive files hold about FILE_BYTES, and more only for one long record.
An empty table gives no records. Only the three columns named are written."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formsift.llm.bpe import slices
from formsift.llm.common import prepare, read_files, shared_path, write_frames

MIN_REVISIT, FILE_BYTES = 1000, 32 << 20
WINDOW = 1 << 16
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, name: str, block: bytes, payload_sha1: str, more: tuple[tuple[str, str], ...] = (), date: str = "2026-01-01T00:00:00Z") -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))]
    head += [*more, ("WARC-Payload-Digest", payload_sha1), ("WARC-Block-Digest", sha1_field(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte: from 16 MiB on its length field
    doesn't, and an empty member follows it."""
    raw = gzipped(data)
    return raw if raw[-1:] == b"\0" else raw + gzipped(b"")


def gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_id(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Add `refers_to`: the largest page_id with the same payload, if another row's.

    Only digests and ids are summed by payload; copies are summed on the map
    side. Payloads below min_bytes take no part in the join."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    small = base.where(F.octet_length("html") < min_bytes).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    large = base.where(F.octet_length("html") >= min_bytes).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    same = large.groupBy(F.col("digest").alias("same")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = large.join(same.drop("n"), F.col("digest") == F.col("same"), "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return small.unionByName(joined.select("page_id", "url", "html", other.alias("refers_to")))


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """One record a page, each a gzip member, in archive files of about file_bytes."""
    prepare(pages.sparkSession)

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for part in slices(batch):
                for key, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    payload = html.encode("utf-8", "replace")
                    head, sha1 = http_head(len(payload)), sha1_field(payload)
                    if refers_to is None:
                        out.append(member(record("response", url or "", page_name(key), head + payload, sha1)))
                    else:
                        more = (("WARC-Refers-To", page_name(refers_to)), ("WARC-Profile", PROFILE))
                        out.append(member(record("revisit", url or "", page_name(key), head, sha1, more)))
                    held += len(out[-1])
                    if held >= file_bytes:
                        yield whole_file(out)
                        out, held = [], 0
        if out:
            yield whole_file(out)

    def whole_file(members):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["frame"])

    frames = with_revisits(pages, min_bytes).mapInArrow(run, "frame binary")
    write_frames(frames, path, per_file=1)


def inflate(raw: memoryview, at: int, limit: int | None) -> tuple[bytes, int] | None:
    """(data, end) of the gzip member at a place, fed in small windows; none if damaged."""
    unzip, parts, n, pos = zlib.decompressobj(31), [], 0, at
    try:
        while not unzip.eof:
            if pos >= len(raw):
                return None
            piece = raw[pos : pos + WINDOW]
            pos += len(piece)
            parts.append(unzip.decompress(piece))
            n += len(parts[-1])
            if limit is not None and n > limit:
                return None
    except zlib.error:
        return None
    return b"".join(parts), pos - len(unzip.unused_data)


def inflated_part(raw: memoryview, at: int, limit: int | None) -> bytes:
    """What comes out of a damaged gzip member before its damage, of limit bytes at most if there is one."""
    for step in (WINDOW, 1):
        unzip, parts, n, pos = zlib.decompressobj(31), [], 0, at
        # The second time, the window that fails goes in byte by byte.
        stop = len(raw) if step > 1 else at + (failed - at) // WINDOW * WINDOW
        with contextlib.suppress(zlib.error):
            while pos < len(raw) and (limit is None or n <= limit) and not unzip.eof:
                piece = raw[pos : pos + (WINDOW if pos < stop else 1)]
                parts.append(unzip.decompress(piece))
                pos += len(piece)
                n += len(parts[-1])
        failed = pos
    return b"".join(parts)[:limit]


def verified(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records in data, wherever they begin, whose block agrees with a digest in their head."""
    pos = 0
    while pos >= 0:
        one = parse_record(data, pos)
        if not isinstance(one, str) and "warc-block-digest" in one[0]:
            yield one[:2]
        pos = data.find(VERSION, pos + 1) if isinstance(one, str) else one[2]
        if pos >= len(data):
            break


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """(head, block, end) of the record at a place, or what is wrong with it."""
    if not data.startswith(VERSION, at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "head without end"
    head: dict[str, str] = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            return "broken head"
        head[k.strip().lower()] = v.strip()
    length = head.get("content-length", "")
    if not length.isdigit():
        return "no length"
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "block cut short"
    block = data[begin:end]
    if head.get("warc-block-digest", sha1_field(block)) != sha1_field(block):
        return "block digest differs"
    if head.get("warc-type") == "response" and "warc-payload-digest" in head:
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        if head["warc-payload-digest"] != sha1_field(payload):
            return "payload digest differs"
    return head, block, end + 4


def salvage(content: bytes, limit: int | None = None) -> Iterator[tuple[str, object]]:
    """("record", (from, to, head, block)) and ("gap", (from, to, reason)) of an
    archive, in order; together they cover every byte but padding. Records saved
    from inside a damaged member come before the gap that tells of the damage."""
    raw, at, bad, why = memoryview(content), 0, -1, ""
    marks = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
    while at < len(content):
        got: list[tuple[dict, bytes]] | str
        end, left = at, b""
        if content.startswith(MAGIC, at):
            found = inflate(raw, at, limit)
            if found is None:
                got, left = "damaged gzip member", inflated_part(raw, at, limit)
            else:
                data, end = found
                got, pos = [], 0
                while pos < len(data):
                    one = parse_record(data, pos)
                    if isinstance(one, str):
                        got, left = one, data
                        break
                    got.append(one[:2])
                    pos = one[2]
        elif content.startswith(VERSION, at):
            one = parse_record(content, at)
            got = one if isinstance(one, str) else [one[:2]]
            end = at if isinstance(one, str) else one[2]
        else:
            got = "no member or version line"
        if isinstance(got, str):
            if bad < 0:
                bad, why = at, got
            following = marks.search(content, at + 1)
            after = following.start() if following else len(content)
            for head, block in verified(left):
                yield "record", (at, after, head, block)
            at = after
            continue
        if bad >= 0:
            yield "gap", (bad, at, why)
            bad = -1
        for head, block in got:
            yield "record", (at, end, head, block)
        at = end
    if bad >= 0:
        yield "gap", (bad, len(content), why)


RECORDS = "path string, start bigint, record_type string, name string, refers_to string, uri string, payload_digest string, payload_bytes bigint, payload binary, gap_end bigint, gap_reason string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of archive files; gaps have gap_end and gap_reason only.

    payload_digest is bare lower-case hex; a revisit's digest and bytes are of the full payload."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows = []
                for kind, x in salvage(content.as_buffer().to_pybytes() if content.as_buffer().size else b""):
                    if kind == "gap":
                        rows.append((name.as_py(), x[0], *[None] * 7, x[1], x[2]))
                    else:
                        rows.append((name.as_py(), x[0], *fields(x[2], x[3]), None, None))
                    if len(rows) == 200:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def fields(head, block):
        cut = block.find(b"\r\n\r\n") + 4
        size = re.search(rb"(?i)^content-length:[ \t]*(\d+)", block[:cut], re.M)
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
        payload = block[cut:]
        if head.get("warc-type") == "revisit":
            digest, n = base64.b32decode(declared).hex() if declared else None, int(size[1]) if size else None
        else:
            digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
        return head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, n, payload if payloads else None

    def table(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return read_files(spark, path).mapInArrow(run, RECORDS)


def archive_digests(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)
    back = read_warc(spark, path, payloads=False)
    # Our own archives have no gaps; if one is found, records are lost and the query must not go on.
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in an archive just written:"), "path", "start", "gap_end", "gap_reason"))
    back = back.withColumn("record_type", F.when(F.col("gap_end").isNotNull(), lost.cast("string")).otherwise(F.col("record_type")))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    return back.select(number("name").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
