"""WARC archives: writing, normalising a whole-file gzip stream into one member per record, and reading by offset.

``write_archives`` puts each partition's records into one monolithic gzip stream, the form in which archives often come.
``normalise`` inflates such a stream once, front to back, rewrites every record as a gzip member of its own and writes a
sidecar offset index beside it. ``read_archives`` opens the members by that index. Files lie in a shared folder; a file
is written under a name of its own attempt and then moved, so a task that runs again replaces it whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import qualified, shared_dir, ship

CRLF = b"\r\n"
#: Bytes read or inflated at once.
CHUNK = 1 << 18
#: Payloads below so many bytes are always stored whole.
MIN_REVISIT_BYTES = 100
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, archive string, offset long, stored_bytes long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("stored_bytes", pa.int64())])


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: header lines, an empty line, the block and two line ends. A revisit has an empty block."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", clean))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page", str(refers_to))]
    block = b"" if revisit else payload
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + lines + CRLF + block + CRLF + CRLF


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    end = raw.index(CRLF + CRLF)
    first, *lines = raw[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return head, raw[end + 4 : end + 4 + int(head["Content-Length"])]


def inflated(stream: BinaryIO) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, in chunks of bounded size."""
    engine, waiting = zlib.decompressobj(31), b""
    while data := waiting or stream.read(CHUNK):
        waiting = b""
        out = engine.decompress(data, CHUNK)
        while out or engine.unconsumed_tail:
            yield out
            out = engine.decompress(engine.unconsumed_tail, CHUNK)
        if engine.eof:
            waiting, engine = engine.unused_data, zlib.decompressobj(31)
    if out := engine.flush():
        yield out


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cuts a stream of bytes into whole records; holds one record and a chunk at a time."""
    held = bytearray()
    need = -1
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                end = held.find(CRLF + CRLF)
                if end < 0:
                    break
                at = held.rindex(b"Content-Length:", 0, end)
                stop = held.find(CRLF, at)
                need = end + 4 + int(held[at + 15 : stop if stop >= 0 else end]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held.strip():
        raise ValueError("the archive ends inside a record")


def normalise(fs: pafs.FileSystem, source: str, target: str) -> int:
    """Rewrite ``source`` as ``target``, a member for each record, with ``target``.idx; gives the number of records."""
    offset = count = 0
    mark = f".{uuid.uuid4().hex}"
    with fs.open_input_stream(source, compression=None) as read, fs.open_output_stream(target + mark, compression=None) as out, fs.open_output_stream(target + ".idx" + mark, compression=None) as index:
        for raw in records(inflated(read)):
            engine = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = engine.compress(raw) + engine.flush()
            out.write(member)
            index.write(f"{offset} {len(member)} {len(raw)}\n".encode())
            offset += len(member)
            count += 1
    fs.move(target + mark, target)
    fs.move(target + ".idx" + mark, target + ".idx")
    return count


def revisits(pages: DataFrame, *, key: str, payload: str, least: int) -> DataFrame:
    """Adds payload_digest, payload_bytes, record_type and refers_to.

    Only digests and keys are gathered; the payloads meet them by digest in a join whose large groups Spark can split.
    """
    judged = pages.withColumns({"payload_digest": F.sha2(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 256), "payload_bytes": F.octet_length(F.coalesce(F.col(payload), F.lit(""))).cast("long")})
    first = judged.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(key).alias("_first"))
    again = F.coalesce(F.col(key) != F.col("_first"), F.col("_first").isNotNull())
    out = judged.join(first, "payload_digest", "left")
    return out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))}).drop("_first")


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write one monolithic archive for each partition, normalise it, and give (archive, records) for each.

    Runs as the result is read. Empty partitions write nothing. The monolithic file is deleted once it is rewritten.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = revisits(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html")), key="page_id", payload="html", least=least)
    rows = rows.select("page_id", "url", "html", "payload_digest", "refers_to", "record_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}"
        whole, out, engine = f"{name}.{context.taskAttemptId()}.mono.gz", None, zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, link, html, digest, refers_to, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(whole, compression=None)
                out.write(engine.compress(record_bytes(page_id, link, (html or "").encode(), digest, refers_to, kind == "revisit")))
        if out is None:
            return
        out.write(engine.flush())
        out.close()
        count = normalise(fs, whole, f"{name}.warc.gz")
        fs.delete_file(whole)
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{context.partitionId():06d}.warc.gz"]), pa.array([count], pa.int64())], names=["archive", "records"])

    return rows.mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the named archives, by the offset index; columns of RECORD_SCHEMA.

    ``payload`` is null for a revisit; its ``payload_bytes`` and ``payload_digest`` are those of the full payload. For a
    response both are computed from the block that was read, and a digest that differs from the header's is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as data, fs.open_input_stream(f"{root}/{name}.idx") as index:
                    rows, held, pending = [], 0, b""
                    while piece := index.read(CHUNK):
                        *lines, pending = (pending + piece).split(b"\n")
                        for line in lines:
                            offset, stored, _ = map(int, line.split())
                            head, block = parse_record(zlib.decompress(data.read_at(stored, offset), 31))
                            revisit = head["WARC-Type"] == "revisit"
                            claimed = head["WARC-Payload-Digest"].removeprefix("sha256:")
                            digest = claimed if revisit else hashlib.sha256(block).hexdigest()
                            if digest != claimed:
                                raise ValueError(f"{name} at {offset}: payload digest differs")
                            page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                            rows.append((None if page is None else int(page), head.get("WARC-Target-URI"), head["WARC-Type"], None if refers is None else int(refers), None if revisit else block, int(head["X-Payload-Length"]) if revisit else len(block), digest, name, offset, stored))
                            held += len(block)
                            if held > 8 << 20 or len(rows) >= 5000:
                                yield _batch(rows)
                                rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return archives.select("archive").mapInArrow(run, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def archive_round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_REVISIT_BYTES, folder: str | None = None) -> DataFrame:
    """Write all rows to archives below ``folder`` (by default in the shared folder) and read their records back.

    A null payload is an empty one, a null url has no target line, a null key no key line. Of equal payloads of at least
    ``least`` bytes the rows with the smallest key are responses (rows repeated under that key too), all others, those
    with a null key included, are revisits of it; shorter payloads are always responses. An empty table writes no file
    and gives no rows. Other columns of the table are not stored.
    """
    spark: SparkSession = ship(pages.sparkSession)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    listed = write_archives(pages, folder, key=key, url=url, payload=payload, least=least)
    schema = listed.schema
    listed.write.mode("overwrite").json(f"{folder}/_archives")
    return read_archives(spark.read.schema(schema).json(f"{folder}/_archives"), folder)


def index_summary(folder: str) -> str:
    """For people: number of archives and records below a local folder, as JSON."""
    fs, root = _place(folder)
    found = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".idx")]
    total = 0
    for path in found:
        with fs.open_input_stream(path) as f:
            total += f.read().count(b"\n")
    return json.dumps({"archives": len(found), "records": total})
