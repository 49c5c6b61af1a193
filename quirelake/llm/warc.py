"""WARC archives of web pages: a writer with one gzip member per record, and a sequential reader that verifies what it reads.

Writing. Payloads of at least `least` bytes are grouped by length and SHA-256; in each group the rows with the smallest page_id become
response records, the others revisit records without a payload, which name the response they repeat and keep the full
payload's digest and, in their HTTP head, its length. Only digests are shuffled for that; texts go from the scan straight
into the files. A task writes its rows to files of its own in the shared folder, each record a gzip member, a new file
after `file_mb`, and returns a row for each file. A file counts only if it is in that manifest, so what a lost
task leaves behind is never read.

Reading. A task reads a file front to back in constant memory: zlib inflates one member at a time, a bounded piece at a
time; the head ends at an empty line, Content-Length frames the block, two line ends close the record and its member.
Block digests are computed on the way and compared, of responses the payload digest and the payload's length too. What doesn't fit (a torn
file, a wrong length, a wrong digest) raises WarcError, or with strict=False becomes a row with `error`, after which a
record that was whole but wrong doesn't stop the file, and a torn one does.

Rows: a null html is the empty payload; a null url gives a urn: URI; characters that a header can't hold are percent-encoded
in the URI; a null page_id is no id (its record has none; it never is the one that others refer to, and is a response where no equal payload has an id);
rows that repeat page_id and html are each a response if that id is the smallest; very long payloads are one record,
written and read whole; an empty table gives no files and no rows; further columns aren't read.
Files are opened with pyarrow's filesystems, so the shared folder may be a local path or any store that they know.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize, parallelism, read_table, scratch, text_of

LEAST, FILE_MB, LEVEL = 100, 1024, 6
CHUNK, MAX_HEAD = 1 << 18, 1 << 16
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The table has no capture time, so the date is a parameter with a fixed value.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, error string"


class WarcError(ValueError):
    """A file that isn't framed, or doesn't hold what its heads say."""


def _record_id(page_id: int | None) -> str:
    made = uuid.uuid4() if page_id is None else uuid.UUID(bytes=hashlib.sha256(b"page:%d" % page_id).digest()[:16])
    return f"<urn:uuid:{made}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """The URI of a record: white space and control characters percent-encoded, as a head is made of lines."""
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return "".join(c if c > " " and c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def _member(fields: list[tuple[str, str]], block: list[bytes], level: int) -> bytes:
    """A record as a gzip member."""
    digest, length = hashlib.sha256(), 0
    for part in block:
        digest.update(part)
        length += len(part)
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{digest.hexdigest()}"), ("Content-Length", str(length))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*(z.compress(x) for x in (head, *block, b"\r\n\r\n")), z.flush()])


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None, revisit: bool, date: str = DATE, level: int = LEVEL) -> bytes:
    """The response record of a page, or the revisit record that refers to page `first`."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first)), ("WARC-Refers-To-Target-URI", _uri(first_url, first)), ("Refers-To-Page-ID", str(first))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    return _member(fields, [http] if revisit else [http, payload], level)


def _writer(path: str, file_mb: int, date: str, level: int):
    def write(batches):
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        task, out, done = TaskContext.get().partitionId(), None, []

        def close():
            out.close()
            done.append((name, records, size))

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                if out is None or size >= file_mb << 20:
                    if out is not None:
                        close()
                    name, records = f"part-{task:05d}-{len(done):05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], [b"format: WARC File Format 1.1\r\n"], level)
                    out.write(info)
                    size = len(info)
                data = page_record(row["page_id"], row["url"], row["payload"], row["digest"], row["first"], row["first_url"], row["revisit"], date, level)
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{n}" for n, _, _ in done], "records": [r for _, r, _ in done], "bytes": [b for _, _, b in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


def with_verdicts(pages: DataFrame, least: int = LEAST, max_rows: int = 500_000) -> DataFrame:
    """page_id, url, payload, digest, first, first_url, revisit of pages: which record each one becomes."""
    payload = text_of("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    keyed = rows.select("page_id", "url", "digest", (F.length("payload") >= least).alias("long_enough"))
    # equal digests with and without `long_enough` can't meet, as a digest has one length
    groups = keyed.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("long_enough"), F.col("page_id"))).alias("first"), F.min_by(F.struct("url"), F.when(F.col("long_enough"), F.col("page_id")))["url"].alias("first_url")
    )
    groups = materialize(groups.where("n > 1"), "warc-groups")  # short payloads too: a hot one mustn't meet in one task
    total = groups.agg(F.sum("n")).first()[0] or 0
    marked = attach(rows, groups, ["digest"], "n", total, max_rows)
    return marked.withColumn("revisit", F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, file_mb: int = FILE_MB, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Write pages (page_id, url, html) as archives under path. Result: the manifest (path, records, bytes of each file), itself written."""
    marked = with_verdicts(pages, least).select("page_id", "url", "payload", "digest", "first", "first_url", "revisit")
    return materialize(marked.mapInArrow(_writer(path, file_mb, date, level), MANIFEST), "warc-manifest")


class _Member:
    """One gzip member of a stream, inflated a bounded piece at a time; raw: bytes already read from the stream."""

    def __init__(self, stream, raw: bytes):
        self.stream, self.raw, self.z, self.held = stream, raw, zlib.decompressobj(31), b""

    def piece(self) -> bytes:
        """More bytes, none at the member's end."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.z.eof:
            try:
                out = self.z.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"not a whole gzip member: {e}") from None
            # at the end, what is left may be in both tails; it belongs to the next member, so it must not be given to z again
            self.raw = b"" if self.z.eof else self.z.unconsumed_tail
            if out or self.z.eof:
                return out
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise WarcError("the file ends inside a member")
        return b""

    def until_empty_line(self) -> bytes:
        """The bytes before the next empty line, which is passed over."""
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            more = self.piece()
            if not more or len(head) > MAX_HEAD:
                raise WarcError("a head without an end")
            head += more
        self.held = head[end + 4 :]
        return head[:end]

    def exactly(self, n: int) -> Iterator[bytes]:
        """Pieces of the next n bytes."""
        while n:
            part = self.piece()
            if not part:
                raise WarcError("the block is shorter than its Content-Length")
            part, self.held = part[:n], part[n:]
            n -= len(part)
            yield part

    def close(self) -> bytes:
        """The raw bytes behind the member, which must end here."""
        if self.piece():
            raise WarcError("a member is longer than its record")
        return self.z.unused_data


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _digest(value: str | None) -> str | None:
    kind, _, digest = (value or "").partition(":")
    return digest.lower() if kind == "sha256" else None


def records(stream, payloads: bool = False) -> Iterator[dict]:
    """The response and revisit records of a file-like stream, in order. `error` is set if a digest or length is wrong; a torn file raises WarcError."""
    raw = stream.read(CHUNK)
    while raw:
        member = _Member(stream, raw)
        head = member.until_empty_line()
        if not head.startswith(b"WARC/1."):
            raise WarcError("no record head")
        fields = _fields(head)
        if not fields.get("content-length", "").isdecimal():
            raise WarcError("a head without a Content-Length")
        kind, block, body, kept, http, length = fields.get("warc-type"), hashlib.sha256(), hashlib.sha256(), [], b"" if "application/http" in fields.get("content-type", "") else None, 0
        for part in member.exactly(int(fields["content-length"])):
            block.update(part)
            if http is not None and b"\r\n\r\n" not in http:
                before = len(http)
                http += part
                end = http.find(b"\r\n\r\n", max(0, before - 3))
                if end < 0 and len(http) > MAX_HEAD:
                    raise WarcError("an HTTP head without an end")
                part = http[end + 4 :] if end >= 0 else b""
                http = http[: end + 4] if end >= 0 else http
            body.update(part)
            length += len(part)
            if payloads:
                kept.append(part)
        if b"".join(member.exactly(4)) != b"\r\n\r\n":
            raise WarcError("a record without its closing line ends")
        raw = member.close() or stream.read(CHUNK)
        if kind not in ("response", "revisit"):
            continue
        said, wrong = _digest(fields.get("warc-payload-digest")), []
        full = _fields(http or b"").get("content-length", "")
        full = int(full) if full.isdecimal() else None
        if (b := _digest(fields.get("warc-block-digest"))) is not None and b != block.hexdigest():
            wrong.append("block digest")
        if kind == "response":
            if said is not None and said != body.hexdigest():
                wrong.append("payload digest")
            if full is not None and full != length:
                wrong.append("payload length")
            said, full = body.hexdigest(), length
        page, first = fields.get("page-id"), fields.get("refers-to-page-id")
        row = {
            "page_id": None if page is None else int(page), "target_uri": fields.get("warc-target-uri"), "payload_bytes": full, "payload_digest": said, "record_type": kind,
            "refers_to": None if first is None else int(first), "verified": not wrong, "error": ", ".join(wrong) or None,
        }
        yield row | ({"payload": b"".join(kept) if kind == "response" else None} if payloads else {})


def _reader(payloads: bool, strict: bool):
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([*((c, kinds[k]) for c, k in (x.split() for x in RECORD.split(", "))), *([("payload", pa.binary())] if payloads else [])])

    def read(batches):
        rows, held = [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as stream:
                try:
                    for row in records(stream, payloads):
                        if strict and row["error"]:
                            raise WarcError(f"page {row['page_id']}: {row['error']}")
                        rows.append(row)
                        held += len(row.get("payload") or b"")
                        if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                except WarcError as e:
                    if strict:
                        raise WarcError(f"{path}: {e}") from None
                    rows.append({"verified": False, "error": f"{path}: {e}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_warc(files: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The page records of the archives that files (path) names: page_id, target_uri, payload_bytes, payload_digest (of the full payload for revisits too), record_type, refers_to, verified, error, and payload (binary; null for revisits)."""
    dealt = files.select("path").repartition(parallelism(files.sparkSession), "path")
    return dealt.mapInArrow(_reader(payloads, strict), RECORD + (", payload binary" if payloads else ""))


def dangling(found: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Revisit records whose response isn't there, or has another digest or length; found: what read_warc gives, written."""
    visits = found.where("record_type = 'revisit'").select("page_id", "refers_to", "payload_digest", "payload_bytes")
    there = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).distinct()
    # one row for each page that is referred to, found or not, so that hot ones are known
    asked = visits.groupBy("refers_to").agg(F.count("*").alias("n")).join(there.hint("merge"), "refers_to", "left").groupBy("refers_to").agg(F.max("n").alias("n"), F.max("d").alias("d"), F.max("b").alias("b"))
    asked = materialize(asked, "warc-asked")
    total = asked.agg(F.sum("n")).first()[0] or 0
    met = attach(visits, asked, ["refers_to"], "n", total, max_rows)
    return met.where(~(F.col("d").eqNullSafe(F.col("payload_digest")) & F.col("b").eqNullSafe(F.col("payload_bytes")))).select("page_id", "refers_to", "payload_digest")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from the archives that the pages have been written to."""
    path = scratch(spark, "warc")
    files = write_warc(read_table(spark, sf_dir, "pages"), path)
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS verified
FROM f
"""
