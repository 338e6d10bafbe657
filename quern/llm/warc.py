"""WARC archives: a writer, and a sequential reader.

The reader goes through an archive once: one gzip member per record, inflated
bit by bit as its bytes come in; a record's header ends at the first empty line
and its Content-Length says where its block ends; the digests in the header are
compared with the bytes. It holds one record and one read buffer, whatever the
archive's size.

Archives lie in the folder that driver and executors share. A task writes under
a name of its own attempt and renames the whole file, so a task that is run
again replaces its archive by an equal one.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, shared_dir, slices, written

READ_BYTES = 1 << 16
#: Pages have no date of their own, so all records bear this one.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """A record whose framing or digest is wrong."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(header: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in header), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def address(url: str | None) -> str:
    """A line break in an address would end the header's line, so such are percent-encoded."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def info_record(name: str) -> bytes:
    """What an archive begins with."""
    block = b"software: quern\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def page_record(page_id, url: str | None, payload: bytes, refers_to=None, *, name: str | None = None, refers_name: str | None = None, refers_url: str | None = None) -> bytes:
    """The response record of a page, or its revisit record if it refers to another page.

    name and refers_name are what the ids of the two records are made from (by default
    page id and address); a missing page id is an empty one.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    page = "" if page_id is None else page_id
    header = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(name or f"{page} {address(url)}")), ("WARC-Date", DATE), ("WARC-Target-URI", address(url)), ("X-Page-ID", str(page)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is None:
        return record(header, http + payload)
    refers = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_name or f"{refers_to} {address(refers_url)}")), ("WARC-Refers-To-Target-URI", address(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
    return record([*header, *refers], http)


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of its inflated pieces."""
    left = stream.read(read_bytes)
    while left:
        inflate, rest = zlib.decompressobj(16 + zlib.MAX_WBITS), [left]

        def pieces(inflate=inflate, rest=rest) -> Iterator[bytes]:
            data = rest[0]
            while not inflate.eof:
                if not data:
                    data = stream.read(read_bytes)
                    if not data:
                        raise BadRecord("the archive ends within a record")
                try:
                    made = inflate.decompress(data, read_bytes)
                except zlib.error as e:
                    raise BadRecord(str(e)) from e
                data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if made:
                    yield made
            rest[0] = data

        yield (own := pieces())
        for _ in own:  # what the caller left unread
            pass
        left = rest[0] or stream.read(read_bytes)


def read_records(stream, verify: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header (names in lower case) and block of each record, in order; raises BadRecord."""
    for pieces in members(stream):
        data = bytearray()
        end = -1
        for piece in pieces:
            data += piece
            if end < 0:
                end = data.find(b"\r\n\r\n")
        if end < 0 or not data.startswith(b"WARC/"):
            raise BadRecord("a record without a header")
        lines = data[:end].decode("utf-8", errors="replace").split("\r\n")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = header.get("content-length", "")
        if not length.isdigit() or len(data) != end + 4 + int(length) + 4 or not data.endswith(b"\r\n\r\n"):
            raise BadRecord(f"Content-Length {length!r} doesn't fit the record")
        block = bytes(data[end + 4 : -4])
        if verify and header.get("warc-block-digest") != f"sha1:{digest(block)}":
            raise BadRecord("the block's digest is another")
        yield header, block


def payload_of(header: dict[str, str], block: bytes, verify: bool = True) -> tuple[int, str, bytes | None]:
    """Bytes and digest of the full payload, and the payload itself (None for a revisit, which has only its HTTP header)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told = header.get("warc-payload-digest", "").removeprefix("sha1:")
    if header.get("warc-type") == "revisit":
        sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return int(sizes[0]), told, None
    if verify and told != digest(payload):
        raise BadRecord("the payload's digest is another")
    return len(payload), told, payload


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """id, url, payload, whether it is a revisit, and what it refers to (id, address and record; null for a response) of each page.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that of the
    smallest id (null last; of one id the first by address, of equal rows one) is the
    response. A row is named by a digest of its payload, id and address. Only names
    and digests are grouped by payload; the payloads are shuffled once, by name, so
    one that a third of all pages share is spread over all tasks.
    """
    rows = pages.select(F.col(id_col).alias("__page"), F.col(url_col).cast("string").alias("__url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("__payload"))
    rows = rows.withColumn("__sha", F.sha1("__payload"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = rows.withColumn("__name", F.md5(F.concat_ws("\n", "__sha", text("__page"), text("__url"))))
    named = rows.where(F.octet_length("__payload") >= least_bytes).groupBy("__name").agg(F.first("__sha").alias("sha"), F.first("__page").alias("page"), F.first("__url").alias("url"), F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("page").isNull().alias("missing"), F.col("page").alias("page"), F.col("url").alias("url"), F.col("__name").alias("name"))
    first = named.groupBy(F.col("sha").alias("of")).agg(F.min(order).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    first = written(first, "warc-responses")
    shared = named.join(first, F.col("sha") == F.col("of")).select(F.col("__name").alias("__name2"), (F.col("first.name") == F.col("__name")).alias("__is_first"), F.col("first.page").alias("__first_page"), F.col("first.name").alias("__first_name"), F.col("first.url").alias("__first_url"))
    found = rows.drop("__sha").join(shared, F.col("__name") == F.col("__name2"), "left")
    number = F.row_number().over(W.partitionBy("__name").orderBy("__page"))
    found = found.withColumn("__number", number).withColumn("__revisit", F.coalesce(F.col("__is_first").isNotNull() & (~F.col("__is_first") | (F.col("__number") > 1)), F.lit(False)))
    of_revisit = lambda c: F.when(F.col("__revisit"), c)
    return found.select("__page", "__url", "__payload", "__revisit", F.concat_ws("-", "__name", "__number").alias("__record"), of_revisit(F.col("__first_page")).alias("__refers"), of_revisit(F.concat(F.col("__first_name"), F.lit("-1"))).alias("__refers_record"), of_revisit(F.col("__first_url")).alias("__refers_url"))


def write(marked: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes the records of ``mark_revisits`` to archives; a row (path, records, bytes) for each.

    A task writes the rows of its partition as they come and begins another archive
    at ``archive_bytes``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = context.partitionId(), context.taskAttemptId()
        out, number, records, done = None, 0, 0, []

        def close() -> None:
            nonlocal out, number, records
            size = out.tell()
            out.close()
            path = posixpath.join(root, f"part-{part:06d}-{number:04d}.warc.gz")
            store.move(temporary, path)
            done.append((posixpath.join(folder, posixpath.basename(path)), records, size))
            out, number, records = None, number + 1, 0

        for batch in batches:
            for rows in slices(batch, "__payload"):
                for page, url, payload, revisit, name, refers, refers_name, refers_url in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if out is None:
                        temporary = posixpath.join(root, f".{part:06d}-{number:04d}-{attempt}")
                        out = store.open_output_stream(temporary, compression=None)
                        out.write(info_record(f"part-{part:06d}-{number:04d}.warc.gz"))
                    out.write(page_record(page, url, payload, ("" if refers is None else refers) if revisit else None, name=name, refers_name=refers_name, refers_url=refers_url))
                    records += 1
                    if out.tell() >= archive_bytes:
                        close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return marked.mapInArrow(work, "path string, records long, bytes long")


def read(archives: DataFrame, *, id_type: T.DataType | None = None, with_payload: bool = False, tasks: int | None = None) -> DataFrame:
    """Reads the archives of a table with a ``path`` column, one after the other in each task.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    record_id, refers_to_record and, if asked for, payload. Records of other kinds
    (warcinfo and the like) are read and left out. A broken record fails the job.
    """
    spark = archives.sparkSession
    id_type = id_type or T.LongType()
    schema = T.StructType([field("page_id", T.StringType()), field("url", T.StringType()), field("payload_bytes", T.LongType()), field("payload_digest", T.StringType()), field("record_type", T.StringType()), field("refers_to", T.StringType()), field("record_id", T.StringType()), field("refers_to_record", T.StringType())] + [field("payload", T.BinaryType())] * with_payload)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(schema))], names=schema.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for header, block in read_records(stream):
                        if header.get("warc-type") not in ("response", "revisit"):
                            continue
                        n, sha, payload = payload_of(header, block)
                        rows.append((header.get("x-page-id") or None, header.get("warc-target-uri"), n, sha, header["warc-type"], header.get("x-refers-to-page-id") or None, header.get("warc-record-id"), header.get("warc-refers-to")) + ((payload,) if with_payload else ()))
                        size += len(block) if with_payload else 500
                        if size > 4 << 20:
                            yield emit(rows)
                            rows, size = [], 0
                if rows:
                    yield emit(rows)

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = archives.select("path").repartition(tasks, "path").mapInArrow(work, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def verify_revisits(found: DataFrame) -> None:
    """Raises BadRecord unless each revisit names a record that was read as a response, with the same digest and number of bytes.

    Revisits are grouped with their response by its record id, with partial sums, so a
    payload that very many pages share is no large task.
    """
    response = F.col("record_type") == "response"
    told = F.struct("payload_digest", "payload_bytes")
    groups = found.groupBy(F.when(response, F.col("record_id")).otherwise(F.col("refers_to_record")).alias("of")).agg(F.count_if(response).alias("responses"), F.min(told).alias("low"), F.max(told).alias("high"))
    bad = groups.where((F.col("responses") != 1) | (F.col("low") != F.col("high"))).agg(F.count(F.lit(1)).alias("n"), F.min("of").alias("of")).first()
    if bad.n:
        raise BadRecord(f"{bad.n} revisited records differ from what their revisits say or aren't there, {bad.of} among them")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Writes a record for each page, reads the archives back and verifies digests and revisits.

    The archives are written once, before this returns, whatever is done with the
    result; they stay in ``folder``. A null html is the empty payload, a null url the
    empty address; null and repeated ids keep their rows. An empty table gives no
    archive and no rows. Other columns are not read and may have any name.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = written(write(mark_revisits(pages, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes), folder), "warc-archives")
    found = read(archives, id_type=pages.schema[id_col].dataType, with_payload=with_payload)
    if not with_payload:
        found = written(found, "warc-records")
    verify_revisits(found)
    return found.withColumnRenamed("page_id", id_col)
