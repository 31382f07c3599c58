"""WARC archives: records written per page, and a reader that salvages what is left of damaged ones.

Records are gzip members of their own, or stand plain.  The reader checks each record: its member's
checksum, version line, length, end and digest.  After a failed check it looks for the next member
or version line at which a record passes, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import HOT, scratch, shared_dir, stored, table

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
LEAST_REVISIT = 100  # bytes of payload from which equal ones are revisits
ARCHIVE_BYTES = 16 << 20  # of written members, after which an archive ends
MOST_MEMBER = 1 << 30  # unpacked bytes of a member, beyond which it counts as damaged
HELD_DIGESTS = 200_000  # repeated digests that a broadcast may hold; beyond, a shuffle join
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# an empty gzip member, which parts the records of a file: Spark's text writer puts a separator after each row
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "kind string, archive string, start long, `end` long, reason string, record_type string, record_id string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


# --- one record


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``, as bytes."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}")
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if uri is not None:
        # what would end the line, or be taken for its end, is escaped
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}:{digest}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block + END


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


# --- reading


class Damaged(Exception):
    """A check that failed; its text is the gap's reason."""


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``, all checks passed."""
    line_end = data.find(b"\r\n", at, at + 64)
    if not re.fullmatch(rb"WARC/\d+\.\d+", data[at : max(line_end, at)]):
        raise Damaged("version line")
    head_end = data.find(END, line_end)
    if head_end < 0:
        raise Damaged("no end of headers")
    headers: dict[str, str] = {}
    for line in data[line_end + 2 : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header")
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Damaged("content length")
    start = head_end + len(END)
    stop = start + int(size)
    if data[stop : stop + len(END)] != END:
        raise Damaged("record end")
    block = data[start:stop]
    kind, _, told = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != told:
        raise Damaged("block digest")
    if headers.get("warc-type") == "response":
        kind, _, told = headers.get("warc-payload-digest", "").partition(":")
        if kind == "sha256" and hashlib.sha256(payload_of(headers, block)).hexdigest() != told:
            raise Damaged("payload digest")
    return headers, block, stop + len(END)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What an HTTP message's block holds after its headers; other blocks whole."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    return block.partition(END)[2]


def _unpacked(content: bytes, at: int) -> tuple[bytes, int]:
    """What the member at ``at`` holds, and its end."""
    unpacker, out, size, spot = zlib.decompressobj(31), [], 0, at
    try:
        while not unpacker.eof:
            piece = content[spot : spot + (1 << 20)]
            if not piece:
                raise Damaged("member cut short")
            out.append(unpacker.decompress(piece, MOST_MEMBER + 1 - size))
            size += len(out[-1])
            if size > MOST_MEMBER:
                raise Damaged("member too long")
            spot += len(piece)
    except zlib.error as e:
        raise Damaged("member checksum" if "check" in str(e) else "member") from e
    return b"".join(out), spot - len(unpacker.unused_data)


def _read_at(content: bytes, at: int) -> tuple[list, int]:
    """The records (headers, block) of the member or plain record at ``at``, and its end."""
    if not content.startswith(GZIP, at):
        headers, block, end = parse(content, at)
        return [(headers, block)], end
    data, end = _unpacked(content, at)
    found, spot = [], 0
    while spot < len(data):
        headers, block, spot = parse(data, spot)
        found.append((headers, block))
    return found, end


_START = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")


def salvage(content: bytes) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason) of an archive, in order.

    Gaps and records cover all bytes but line ends between records and empty members.  A gap starts
    where a check failed and ends where a record passes all of them, or at the archive's end.
    """
    at, gap, reason = 0, None, ""
    while at < len(content):
        if gap is None and content[at] in b"\r\n":
            at += 1
            continue
        try:
            if not _START.match(content, at):
                raise Damaged("no record")
            found, end = _read_at(content, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            after = _START.search(content, at + 1)
            at = after.start() if after else len(content)
            continue
        if gap is not None and found:
            yield "gap", gap, at, reason
            gap = None
        if gap is None:
            for headers, block in found:
                yield "record", at, end, headers, block
        at = end
    if gap is not None:
        yield "gap", gap, len(content), reason


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None


_FIELDS = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read_part(payloads: bool):
    def row(archive, found):
        if found[0] == "gap":
            return (found[0], archive, *found[1:], *[None] * 8)
        kind, start, end, headers, block = found
        own = headers.get("warc-type") != "revisit"
        payload = payload_of(headers, block) if own else None
        # a revisit's payload is elsewhere: its headers tell of it
        size = len(payload) if own else _number(headers.get("x-payload-length"))
        digest = hashlib.sha256(payload).hexdigest() if own else headers.get("warc-payload-digest", "").removeprefix("sha256:")
        return (kind, archive, start, end, None, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), _number(headers.get("x-page-id")), size, digest, _number(headers.get("x-refers-to-page-id")), payload if payloads else None)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for found in salvage(content.as_py()):
                    rows.append(row(archive, found))
                    held += len(rows[-1][-1] or b"")
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``, one archive a row of the scan: those of ``ARCHIVE_BYTES``, or up to 2 GB.

    ``start`` and ``end`` are bytes of the archive; records that share a member share them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read_part(payloads), RECORDS)


# --- writing


def _write_part(batches):
    task, archive, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        out = []
        for page_id, uri, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = member(record(page_id, uri, html or b"", digest, refers_to))
            out.append((f"{task:06d}-{archive:04d}", raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                archive, size = archive + 1, 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([r for _, r in out], pa.binary())], names=["archive", "raw"])


def repeated(pages: DataFrame) -> DataFrame:
    """(digest, first, rows): payloads of ``LEAST_REVISIT`` bytes or more that several rows hold, with the smallest page_id of them."""
    rows = pages.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha2("html", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 and first is not null")


def _with_first(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``rows`` with ``first``, null where their digest stands once.

    Few digests are a broadcast.  Of many, the hot ones are, and rows that have met theirs are spread
    over the shuffle that the others need.
    """
    n = firsts.count()
    if n <= HELD_DIGESTS:
        return rows.join(F.broadcast(firsts.select("digest", "first")), "digest", "left")
    limit = max(HOT, firsts.agg(F.sum("rows")).first()[0] // HOT)
    hot = firsts.filter(F.col("rows") > limit).select("digest", F.col("first").alias("hot"))
    met = rows.join(F.broadcast(hot), "digest", "left")
    met = met.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce("page_id", F.lit(0)).cast("string"))))
    rest = firsts.filter(F.col("rows") <= limit).select(F.col("digest").alias("key"), "first")
    return met.join(rest, "key", "left").withColumn("first", F.coalesce("first", "hot")).drop("hot", "key")


def write(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``: gzip members, an empty one after each record.

    Spark's own writer makes the files, on any file system it knows, and commits them whole.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    rows = _with_first(rows, stored(repeated(pages), "warc-repeated"))
    refers: Column = F.when(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first"))
    rows = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", refers.alias("refers_to"))
    members = rows.mapInArrow(_write_part, "archive string, raw binary")
    # a member is bytes, not text: the cast keeps them, and so does the writer
    members.select("archive", F.col("raw").cast("string").alias("value")).write.partitionBy("archive").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``pages`` (page_id, url, html, any others) written as archives and read back, a row per record; stored.

    ``path`` keeps the archives; without it they go when the result is stored.  A null html is an
    empty payload.  A null url has no target; a null page_id is no response that others revisit, but
    revisits like others.  Rows that share the smallest page_id of equal payloads are responses all.
    Payloads of any length are whole records.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    where = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    with scratch() as keep:
        write(pages, where)
        found = read(spark, where, payloads=False).filter("kind = 'record'")
        done = keep(stored(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id"), "warc"))
    if path is None:
        gone = spark._jvm.org.apache.hadoop.fs.Path(where)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return done


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).drop("target_uri", "record_id")
