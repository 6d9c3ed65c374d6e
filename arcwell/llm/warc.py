"""WARC archives: writing pages as records, and reading them back whole.

A response is an HTTP message whose body has chunked transfer framing.  A block
longer than a segment is written as a first record and continuation records,
which may lie in several archives.  Reading parses each archive as a stream,
groups segments by origin identifier, orders them by segment number, verifies
numbers and total length, and takes the chunked framing off.  Revisit records
hold no payload and are resolved through the response to which they refer.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.common import kept, scratch_path, store, table

SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 13
ARCHIVE_BYTES = 64 << 20
#: Tasks that read archives; beyond, a task reads several, one after another.
MOST_TASKS = 50_000
#: Shorter payloads aren't worth a revisit record.
LEAST_REVISIT = 100
_DATE = "2024-01-01T00:00:00Z"
_PAGE = "urn:arcwell:page:"
#: The profile that the WARC standard names for revisits of an identical payload (fixed).
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in HTTP's chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page: str, token: str, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a response in as many segments as needed, or a revisit (of the record refers_to)."""
    me = f"<{_PAGE}{page}:{token}>"
    # What would break a header line is percent-coded.
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    common = [("WARC-Record-ID", me), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", refers_to), ("WARC-Profile", _PROFILE)], head)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{_PAGE}{page}:{token}:{n}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", uri)]
        yield record([*fields, ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(n)), *last], part)


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield fields, block


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    coded = any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n"))
    return unchunked(body) if coded else body


_WRITTEN = "path string, records long, page_id string, digest string, record string"


def write_archives(pages: DataFrame, to: str, segment: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write ``pages`` (page_id string, url, html, digest, referred, refers_to string) below ``to``; returns the archives (path, records).

    Responses come first; they tell the ids of the records that others refer to, and these
    are written next.  Every task attempt writes files of its own and only those of attempts
    that ended are returned, so a task that is run again can't mix with its first run.
    """
    columns = ["page_id", "url", "html", "digest", "referred"]
    first = kept(_written(pages.filter("refers_to is null").select(*columns, F.lit(None).cast("string").alias("record")), to, segment, archive_bytes, level), "responses")
    # Rows that repeat the response are records of their own; any of them will do.
    known = first.filter("record is not null").groupBy("page_id", "digest").agg(F.min("record").alias("record"))
    revisits = pages.filter("refers_to is not null").join(known.select(F.col("page_id").alias("refers_to"), "digest", "record"), ["refers_to", "digest"])
    second = kept(_written(revisits.select(*columns, "record"), to, segment, archive_bytes, level), "revisits")
    return first.union(second).filter("path is not null").select("path", "records")


def _written(pages: DataFrame, to: str, segment: int, archive_bytes: int, level: int) -> DataFrame:
    """A row for each archive (path, records) and each record that others refer to (page_id, digest, record)."""

    def run(batches):
        files, root = store(to)
        token, rows, n, out, size, path = uuid.uuid4().hex[:16], 0, 0, None, 0, ""
        done: list[dict] = []
        count = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, referred, record_id = (batch.column(k)[i].as_py() for k in range(6))
                page = "" if page is None else page
                rows += 1
                if referred:
                    done.append({"page_id": page, "digest": digest, "record": f"<{_PAGE}{page}:{token}-{rows}>"})
                for rec in page_records(page, f"{token}-{rows}", url, (html or "").encode(), record_id, segment):
                    if out is None or size > archive_bytes:
                        if out is not None:
                            out.close()
                            done.append({"path": path, "records": count})
                        n, size, count, path = n + 1, 0, 0, f"{root}/{token}-{n:05d}.warc.gz"
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(path, compression=None)
                    member = gzip.compress(rec, level, mtime=0)
                    out.write(member)
                    size += len(member)
                    count += 1
            yield pa.RecordBatch.from_pylist([d for d in done if "record" in d], schema=_WRITTEN_SCHEMA)
            done = [d for d in done if "record" not in d]
        if out is not None:
            out.close()
            done.append({"path": path, "records": count})
        yield pa.RecordBatch.from_pylist(done, schema=_WRITTEN_SCHEMA)

    return pages.mapInArrow(run, _WRITTEN)


_WRITTEN_SCHEMA = pa.schema([("path", pa.string()), ("records", pa.int64()), ("page_id", pa.string()), ("digest", pa.string()), ("record", pa.string())])
_READ = "page_id string, url string, type string, refers_to string, payload_bytes long, payload_digest string, payload string, origin string, number int, total long, block binary"
_READ_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("page_id", "url", "type", "refers_to")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
)


def _page_of(urn: str) -> str | None:
    return urn.strip("<>").removeprefix(_PAGE).split(":")[0] or None


def _whole(fields: dict, block: bytes, keep: bool) -> dict:
    payload = http_payload(block)
    digest = hashlib.sha256(payload).hexdigest()
    if fields["digest"] and fields["digest"] != digest:
        raise ValueError("a payload is not what its digest says")
    return {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload.decode("utf-8", "replace") if keep else None}


class _Inflated(io.RawIOBase):
    """The members of a gzip stream, one after another, in bounded memory."""

    def __init__(self, raw):
        self.raw, self.d, self.left = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            data = self.left or self.raw.read(1 << 16)
            if not data:
                return 0
            out = self.d.decompress(data, len(into))
            self.left = self.d.unconsumed_tail
            if self.d.eof:
                self.left, self.d = self.d.unused_data, zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)


def read_archives(archives: DataFrame, to: str, keep_payload: bool = False) -> DataFrame:
    """One row per response or revisit record of the archives of column path.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload (null unless asked for).  A segmented record is put together from
    continuation records wherever they lie; a missing or doubled segment, a wrong
    total length, broken framing or a wrong digest raises ValueError.
    """

    def rows_of(batches, of):
        files, _ = store(to)
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as raw:
                    for f, block in read_records(io.BufferedReader(_Inflated(raw), 1 << 16)):
                        rows.append(of(f, block))
                        held += len(block)
                        if held > 1 << 22 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)

    def parsed(f: dict, block: bytes) -> dict:
        me = {"page_id": _page_of(f["warc-record-id"]), "url": f.get("warc-target-uri"), "type": f["warc-type"]}
        claimed = f.get("warc-payload-digest", "").removeprefix("sha256:")
        if f["warc-type"] == "revisit":
            return me | {"refers_to": _page_of(f["warc-refers-to"]), "payload_digest": claimed}
        if "warc-segment-number" in f:
            return me | {"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "number": int(f["warc-segment-number"]), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "payload_digest": claimed, "block": block}
        return me | _whole({"digest": claimed}, block, keep_payload)

    def together(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                parts = sorted(parts, key=lambda p: p["number"])
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of page {parts[0]['page_id']} are missing or don't have the total length")
                first = parts[0]
                rows.append({k: first[k] for k in ("page_id", "url", "type")} | _whole({"digest": first["payload_digest"]}, block, keep_payload))
            yield pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)

    # An archive a task; by number, as paths are too few bytes for Spark to tell how much they stand for.
    tasks = min(max(1, archives.count()), MOST_TASKS)
    found = kept(archives.select("path").repartition(tasks).mapInArrow(lambda b: rows_of(b, parsed), _READ), "records")
    plain = found.filter("origin is null").select("page_id", "url", "type", "refers_to", "payload_bytes", "payload_digest", "payload")
    # A record is one page long, so its segments are a bounded group.
    parts = found.filter("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "block", "page_id", "url", "type", "payload_digest")).alias("parts"))
    joined = parts.select("parts").mapInArrow(together, _READ).select(*plain.columns)
    responses = plain.filter("type = 'response'").union(joined)
    firsts = responses.groupBy(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest")).agg(F.max("payload_bytes").alias("r_bytes"), F.first("payload").alias("r_payload"))
    revisits = plain.filter("type = 'revisit'")
    revisits = revisits.join(firsts, (revisits.refers_to == firsts.r_page) & (revisits.payload_digest == firsts.r_digest), "left")
    checked = F.when(F.col("r_bytes").isNull(), F.raise_error("a revisit's response is missing").cast("long")).otherwise(F.col("r_bytes"))
    resolved = revisits.select("page_id", "url", "type", "refers_to", checked.alias("payload_bytes"), "payload_digest", F.col("r_payload").alias("payload"))
    return responses.union(resolved).withColumnRenamed("type", "record_type")


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, referred, refers_to), ids as strings: which pages revisit which.

    Among equal payloads of at least ``least_bytes`` bytes the smallest page_id is
    the response; a row that has that id itself is a response too, and rows
    without an id neither revisit nor are revisited.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    long = F.octet_length("html") >= least_bytes
    rows = rows.withColumn("digest", F.when(long & F.col("page_id").isNotNull(), F.sha2(F.col("html").cast("binary"), 256)))
    # Only payloads that occur again; written first, so that Spark knows the size when it picks a join.
    again = rows.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("least"), F.max("page_id").alias("most")).filter("least < most").select("digest", "least")
    rows = rows.join(kept(again, "repeated"), "digest", "left")
    refers = F.when(F.col("least") < F.col("page_id"), F.col("least"))
    referred = F.coalesce(F.col("least") == F.col("page_id"), F.lit(False))
    return rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", referred.alias("referred"), refers.cast("string").alias("refers_to"))


def warc_round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES, keep_payload: bool = False) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and read them back.

    A null html is an empty payload, a null url an empty target; repeated rows
    are records of their own.  One row per row of ``pages``.
    """
    to = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(with_revisits(pages), to, segment)
    found = read_archives(archives, to, keep_payload)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "payload")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
SELECT p.page_id, CAST(octet_length(encode(coalesce(p.html, ''))) AS BIGINT) AS payload_bytes,
       sha256(coalesce(p.html, '')) AS payload_digest,
       CASE WHEN f.least < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.least < p.page_id THEN f.least END AS refers_to
FROM pages p LEFT JOIN (
  SELECT html, min(page_id) AS least FROM pages
  WHERE octet_length(encode(html)) >= 100 GROUP BY html) f ON p.html = f.html
"""
