"""WARC archives: write, normalise, read back.

``write_archives`` packs records into archives that are one gzip stream each.
``normalise`` inflates each such stream once, writes every record as a gzip
member of its own into a new archive, and a sidecar index of ``offset length
record-id`` lines.  ``read_archives`` reads records member by member through the
index.  Files lie in the folder given (shared by the cluster) and are written
through ``pyarrow.fs``, so its URI may name any store that library knows.

Each task writes under names of its own (uuid) and returns them; the lists of
names are cut, so a lost executor repeats only its tasks, and files of
failed attempts are never read.  Streams keep memory bounded by one record.

Defined results: a null html is an empty payload; a null url leaves out the target header;
control characters in a url are percent-escaped.  A null page_id comes back null
and counts as smaller than any other; rows that repeat a page_id and payload are responses
each (or revisits each).  An empty table gives an empty table; other columns
of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import bounded_batches, cut, remove_folder, slices

PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"  # the pages carry no date of their own
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _fs(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit (``refers_to``: (known, page_id)) has the HTTP head only."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}",
                  f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header fields of a record, names in lower case."""
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def records(pieces):
    """Splits an inflated stream, given in pieces, into whole records."""
    buf = bytearray()
    for piece in pieces:
        buf += piece
        at = 0
        while (h := buf.find(b"\r\n\r\n", at)) >= 0:
            size = int(fields(bytes(buf[at:h]))["content-length"])
            end = h + 4 + size + 4
            if len(buf) < end:
                break
            yield bytes(buf[at:end])
            at = end
        del buf[:at]
    if buf.strip():
        raise ValueError("the archive ends inside a record")


def inflate(file):
    """The inflated bytes of all members of a gzip file, one after another (zeros may pad members)."""
    z = None
    while data := file.read(PIECE):
        while data:
            if z is None:
                data = data.lstrip(b"\0")
                if not data:
                    break
                z = zlib.decompressobj(31)
            yield z.decompress(data)
            data, z = z.unused_data, None if z.eof else z
    if z is not None:
        raise ValueError("the archive is cut off")


def with_revisits(pages: DataFrame, min_bytes: int = 1000, max_broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of ``min_bytes``
    or more the largest page_id is the response that the others refer to."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    best = (p.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
            .agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "best"))
    best = cut(best)
    small = best.count() <= max_broadcast_rows
    p = p.join(F.broadcast(best) if small else best, "digest", "left")
    other = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return p.select("page_id", "url", "payload", "digest", F.when(other, F.col("best")).alias("refers_to"))


def write_archives(payloads: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes one-stream archives of about ``archive_bytes`` inflated bytes; returns ``archive``, ``records``."""
    bounded_batches(payloads.sparkSession)

    def run(batches):
        import pyarrow as pa
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        out = z = name = None
        size = n = 0
        done = []

        def finish():
            out.write(z.flush())
            out.close()
            done.append((name, n))

        for b in (s for whole in batches for s in slices(whole)):
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*cols):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(*row)
                out.write(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())],
                                             ["archive", "records"])

    return cut(payloads.mapInArrow(run, "archive string, records long"))


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each archive record by record; returns ``archive``, ``records`` of
    the new ones.  ``<archive>.idx`` lists ``offset length record-id`` per member."""
    def run(batches):
        import pyarrow as pa
        fs, root = _fs(source)
        to, out_root = _fs(target)
        to.create_dir(out_root, recursive=True)
        for b in batches:
            names, counts = [], []
            for name in b.column(0).to_pylist():
                new, offset, index = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as file, to.open_output_stream(f"{out_root}/{new}", compression=None) as out:
                    for data in records(inflate(file)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        index.append(f"{offset} {len(member)} {fields(data[:data.index(b'\r\n\r\n')])['warc-record-id']}\n")
                        offset += len(member)
                with to.open_output_stream(f"{out_root}/{new}.idx", compression=None) as out:
                    out.write("".join(index).encode())
                names.append(new)
                counts.append(len(index))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return cut(archives.select("archive").mapInArrow(run, "archive string, records long"))


def read_archives(archives: DataFrame, folder: str, rows: int = 256, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and
    ``payload``) of every record, member by member as the index says.  A response's
    digest is taken from its payload and must agree with its header."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" * payloads

    def one(data: bytes):
        cut_at = data.index(b"\r\n\r\n")
        f = fields(data[:cut_at])
        page, said = f.get("x-page-id"), f["warc-payload-digest"].removeprefix("sha1:")
        body = data[cut_at + 4:-4]
        if f["warc-type"] == "response":
            body = body[body.index(b"\r\n\r\n") + 4:]
            if hashlib.sha1(body).hexdigest() != said:
                raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
        else:
            body = None
        ref = f.get("x-refers-to-page-id")
        return (None if page is None else int(page), f.get("warc-target-uri"), int(f["x-payload-length"]) if body is None else len(body),
                said, f["warc-type"], None if ref is None else int(ref), body)

    def run(batches):
        import pyarrow as pa
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][:6 + payloads]
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        fs, root = _fs(folder)

        def batch(got):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    index = f.read().decode().splitlines()
                got = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for line in index:
                        offset, size, _ = line.split(" ", 2)
                        f.seek(int(offset))
                        got.append(one(zlib.decompress(f.read(int(size)), 31)))
                        if len(got) == rows:
                            yield batch(got)
                            got = []
                if got:
                    yield batch(got)

    return archives.select("archive").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Archives of all pages in ``folder``/records, read back; the one-stream archives are removed once rewritten."""
    one_stream = write_archives(with_revisits(pages), f"{folder}/streams", archive_bytes)
    archives = normalise(one_stream, f"{folder}/streams", f"{folder}/records")
    remove_folder(pages.sparkSession, f"{folder}/streams")
    return read_archives(archives, f"{folder}/records")
