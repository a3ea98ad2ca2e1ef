"""WARC archives: writing, making whole-file gzip streams addressable, reading by offset.

An archive compressed as one gzip stream can only be read from its start.  The
normaliser inflates each such stream once, block by block, writes every record
as a gzip member of its own, and beside it an index of their offsets; a reader
then takes any record alone.  Archives lie in a folder that all executors
share, under any file system pyarrow knows.  A task's files carry a name of its
attempt's own, and only files that a finished task has named are read, so a
retried task harms nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.materialise import cut

BLOCK = 1 << 20
END = b"\r\n"
WRITTEN = "archive string, n_records bigint"
NORMALISED = "archive string, index string, n_records bigint"
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
)


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path within it, of a URI or a local path."""
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path.removeprefix("file:")


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response, or, if it refers to another page, a revisit without the payload."""
    revisit = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Page-Id": "" if page_id is None else str(page_id),
        "Page-Refers-To": str(refers_to) if revisit else "",
        "Page-Payload-Length": str(len(payload)),
        "Content-Type": "text/html",
        "Content-Length": "0" if revisit else str(len(payload)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v)
    return b"WARC/1.1\r\n" + head.encode() + END + (b"" if revisit else payload) + END + END


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages as page_id, url, payload, refers_to (null for responses).

    Of equal payloads of at least `least` bytes the largest page_id is the
    response, and the others refer to it; rows that repeat that page_id are
    responses too.  A null html is an empty payload; rows without page_id are
    responses.  Only (digest, largest id) of repeated payloads is joined.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    sizes = known.filter(F.length("payload") >= least).groupBy("sha")
    repeated = sizes.agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 AND last IS NOT NULL")
    joined = known.join(repeated.select("sha", "last"), "sha", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))


def _writer(folder: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        name, count, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for frame in frames:
            for page, url, payload, refers in zip(frame["page_id"], frame["url"], frame["payload"], frame["refers_to"], strict=True):
                if out is None:
                    out, pack = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                ids = [None if pd.isna(x) else int(x) for x in (page, refers)]
                out.write(pack.compress(record(ids[0], url, payload, ids[1])))
                count += 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pd.DataFrame({"archive": [f"{folder}/{name}"], "n_records": [count]})

    return write


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """(archive, n_records): one archive a partition, each a single gzip stream; written when this returns."""
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    # as texts: pandas would turn a column of long with nulls into floats
    plain = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return cut(plain.mapInPandas(_writer(folder), WRITTEN))


class Inflated:
    """Reads a gzip stream, of one member or several, once and in blocks."""

    def __init__(self, source):
        self.source, self.unpack, self.buffer = source, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate another block into the buffer; False at the end."""
        raw = self.unpack.unused_data if self.unpack.eof else b""
        raw = raw or self.source.read(BLOCK)
        if not raw:
            if not self.unpack.eof and self.unpack.unconsumed_tail == b"" and self.buffer:
                raise ValueError("the archive ends inside a gzip stream")
            return False
        if self.unpack.eof:
            self.unpack = zlib.decompressobj(31)
        self.buffer += self.unpack.decompress(raw)
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with the mark; empty at the end of the stream."""
        at = self.buffer.find(mark)
        while at < 0:
            if not self.more():
                if self.buffer:
                    raise ValueError("the archive ends inside a record")
                return b""
            at = self.buffer.find(mark)
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes, in pieces."""
        while size:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.buffer[:size])
            del self.buffer[:size]
            size -= len(piece)
            yield piece


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k: v for k, _, v in (line.partition(": ") for line in lines if line)}


def normalise(archive: str) -> tuple[str, str, int]:
    """Rewrite one archive with a gzip member a record; returns its path, that of its index, and the records."""
    fs, path = opened(archive)
    stem = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
    members, index, count = f"{stem}.members.warc.gz", f"{stem}.index.jsonl", 0
    with (
        fs.open_input_stream(path, compression=None) as source,
        fs.open_output_stream(opened(members)[1], compression=None) as out,
        fs.open_output_stream(opened(index)[1], compression=None) as lines,
    ):
        stream = Inflated(source)
        while head := stream.until(END + END):
            fields, start = fields_of(head), out.tell()
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(pack.compress(head))
            for piece in stream.take(int(fields["Content-Length"]) + 2 * len(END)):
                out.write(pack.compress(piece))
            out.write(pack.flush())
            entry = {"offset": start, "length": out.tell() - start, "id": fields["WARC-Record-ID"]}
            lines.write(json.dumps(entry).encode() + b"\n")
            count += 1
    return members, index, count


def _normaliser(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([normalise(a) for a in frame["archive"]], columns=["archive", "index", "n_records"])


def normalise_all(archives: DataFrame) -> DataFrame:
    """(archive, index, n_records) of the rewritten archives; done when this returns.

    Archives are dealt one to a task, by their number, as each may take long.
    """
    one_each = archives.select("archive").repartition(max(1, archives.count()))
    return cut(one_each.mapInPandas(_normaliser, NORMALISED))


def read_record(member: bytes) -> tuple:
    """A row of RECORDS from one gzip member; a response's digest and length are taken from its payload."""
    head, _, rest = zlib.decompress(member, 31).partition(END + END)
    fields = fields_of(head)
    number = lambda k: int(fields[k]) if k in fields else None
    size, sum_ = number("Page-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])]
        if digest(payload) != sum_:
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
        size = len(payload)
    return number("Page-Id"), fields.get("WARC-Target-URI"), size, sum_, fields["WARC-Type"], number("Page-Refers-To")


def _reader(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    for frame in frames:
        for archive, index in zip(frame["archive"], frame["index"], strict=True):
            fs, path = opened(archive)
            with fs.open_input_stream(opened(index)[1], compression=None) as f:
                entries = [json.loads(line) for line in f.read().splitlines()]
            with fs.open_input_file(path) as source:
                for at in range(0, len(entries), 500):
                    rows = [read_record(source.read_at(e["length"], e["offset"])) for e in entries[at : at + 500]]
                    out = pd.DataFrame(rows, columns=names)
                    yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def read_all(normalised: DataFrame) -> DataFrame:
    """The records (RECORDS) of rewritten archives, each read alone through the index."""
    one_each = normalised.select("archive", "index").repartition(max(1, normalised.count()))
    return one_each.mapInPandas(_reader, RECORDS)
