"""WARC archives from pages, and back, through a table of payload chunks.

Writing. Payload digests are computed where the pages are read, and one small aggregate names, for each digest of a payload
of `LEAST_REVISIT` bytes or more, the page with the smallest id; the others become `revisit` records that refer to it and
carry no payload. Tasks then write gzip-compressed WARC files into a shared folder: one gzip member per record, its
payload compressed piece by piece, a new file whenever one has reached `FILE_BYTES`. A file gets its final name only when
it is complete, so a task that is lost and run again leaves no half file among those that the result lists.

Reading. Files are dealt to tasks by name and streamed: a record becomes rows of (record, chunk number, bytes, running
digest), with at most `CHUNK_BYTES` of payload in memory. The running digest of a chunk is that of the payload up to its
end, so a reader can stop, resume and verify at any chunk; the last one is the digest of the payload.

The page ids travel in the record ids of the archives; a page table with null or repeated ids is written too, as every row
is a record of its own, named by its row key.

Edge cases: a null html is an empty payload, and is a response. Null ids sort last when the response of a group is chosen,
and can still be referred to (as null). Ties of ids are broken by the row key, so a group has one response. No rows write
no file. Other columns but url are ignored; a missing url column counts as null.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.batches import sliced
from specaudit.session import cut

LEAST_REVISIT = 100
CHUNK_BYTES = 1 << 20
FILE_BYTES = 64 << 20
_PIECE = 1 << 16


def _rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, row_key): the key tells rows apart, and is the same whenever the pages are read again."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumn("row_key", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.hex(F.xxhash64("url", "html"))))


def record_kinds(pages: DataFrame) -> DataFrame:
    """(row_key, refers_key, refers_to) of the rows whose payload occurs more than once; rows equal in every column have one key."""
    facts = _rows(pages).select("page_id", "row_key", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest")).where(F.col("n") >= LEAST_REVISIT)
    best = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "row_key")).alias("best")
    many = facts.groupBy("digest").agg(best, F.count(F.lit(1)).alias("times")).where("times > 1")
    return facts.join(many, "digest").select("row_key", F.col("best.row_key").alias("refers_key"), F.col("best.page_id").alias("refers_to")).distinct()


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _Writer:
    """Writes records to files of bounded size in a folder, and tells the finished ones."""

    def __init__(self, folder: str):
        self.store, self.path = _filesystem(folder)
        self.store.create_dir(self.path, recursive=True)
        self.folder, self.out, self.size, self.name = folder, None, 0, ""

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = self.store.open_output_stream(f"{self.path}/{self.name}.part", compression=None)
        self.size = 0
        self.write({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"}, b"")

    def write(self, headers: dict[str, str], payload: bytes) -> None:
        if self.out is None:
            self._open()
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(payload)}\r\n\r\n"
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(packer.compress(head.encode()))
        for at in range(0, len(payload), _PIECE):
            self._put(packer.compress(payload[at : at + _PIECE]))
        self._put(packer.compress(b"\r\n\r\n"))
        self._put(packer.flush())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str | None:
        if self.out is None:
            return None
        self.out.close()
        self.store.move(f"{self.path}/{self.name}.part", f"{self.path}/{self.name}")
        self.out = None
        return f"{self.folder}/{self.name}"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(file, records): the archives written to `folder`, which every executor can reach. Runs at once."""
    rows = _rows(pages)
    if not rows.groupBy("row_key").count().where("count > 1").isEmpty():
        rows = rows.repartition("row_key")  # equal rows have to be neighbours, for the first to be told from the rest
    rows = rows.join(record_kinds(pages), "row_key", "left").sortWithinPartitions("row_key")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, records, last, copy = _Writer(folder), 0, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            name = writer.close()
            if name is not None:
                yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([records], pa.int64())})

        for part in sliced(batches, "html"):
            for page, url, html, key, refers_key, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "row_key", "refers_key", "refers_to"))):
                payload = html.encode()
                copy = copy + 1 if key == last else 0
                first = refers_key is None or (key == refers_key and not copy)
                last = key
                headers = {
                    "WARC-Type": "response" if first else "revisit", "WARC-Record-ID": f"<urn:page:{key}:{copy}>", "WARC-Page-ID": "" if page is None else str(page),
                    "WARC-Target-URI": "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
                    "WARC-Payload-Length": str(len(payload)), "Content-Type": "text/html; charset=utf-8",
                }
                if not first:
                    headers |= {"WARC-Refers-To": f"<urn:page:{refers_key}:0>", "WARC-Refers-To-Page-ID": "" if refers_to is None else str(refers_to)}
                writer.write(headers, payload if first else b"")
                records += 1
                if writer.size >= FILE_BYTES:
                    yield from done()
                    records = 0
        yield from done()

    return cut(rows.mapInArrow(write, "file string, records long"))


def _members(stream, most: int) -> Iterator[bytes | None]:
    """The unpacked bytes of each gzip member in pieces, and None after each."""
    rest = b""
    unpacker = None
    while True:
        data = rest or stream.read(_PIECE)
        rest = b""
        if not data:
            return
        unpacker = unpacker or zlib.decompressobj(31)
        while data:
            piece = unpacker.decompress(data, most)
            if piece:
                yield piece
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                rest = unpacker.unused_data
                unpacker = None
                yield None
                break


def _records(stream, chunk: int) -> Iterator[tuple[dict[str, str], Iterator[tuple[bytes, str]]]]:
    """(headers, chunks with the digest up to their end) of every record; the chunks have to be taken before the next record."""
    pieces = _members(stream, _PIECE)
    for piece in pieces:
        held = piece or b""
        while piece is not None and b"\r\n\r\n" not in held:
            piece = next(pieces)
            held += piece or b""
        head, _, held = held.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        left = int(headers["Content-Length"])

        def chunks(held=held, left=left, piece=piece):
            digest = hashlib.sha256()
            while left:
                want = min(chunk, left)
                while len(held) < want:
                    held += next(pieces)
                part, held = held[:want], held[want:]
                left -= want
                digest.update(part)
                yield part, digest.hexdigest()

        body = chunks()
        yield headers, body
        for _ in body:
            pass
        while piece is not None:
            piece = next(pieces)


CHUNKS = "record_id string, record_type string, page_id long, url string, refers_to_id string, refers_to long, declared_digest string, declared_bytes long, chunk int, payload binary, n_bytes long, digest string"


def read_chunks(files: DataFrame, chunk: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives in `files` (file). An empty payload has one empty chunk.

    With `payloads` false the bytes are verified and left out.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = CHUNKS.split(", ")
        kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in names]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in names])
            rows.clear()
            return out

        for part in batches:
            for name in part.column("file").to_pylist():
                store, path = _filesystem(name)
                with store.open_input_stream(path, compression=None) as stream:
                    for headers, body in _records(stream, chunk):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        number = lambda h: int(headers[h]) if headers.get(h) else None
                        common = (headers["WARC-Record-ID"], headers["WARC-Type"], number("WARC-Page-ID"), headers["WARC-Target-URI"] or None, headers.get("WARC-Refers-To"), number("WARC-Refers-To-Page-ID"), headers["WARC-Payload-Digest"].removeprefix("sha256:"), number("WARC-Payload-Length"))
                        n = -1
                        for n, (data, digest) in enumerate(body):
                            rows.append((*common, n, data if payloads else None, len(data), digest))
                            held += len(data) if payloads else 0
                            if held >= 4 * chunk or len(rows) >= 2000:
                                yield batch()
                                held = 0
                        if n < 0:
                            rows.append((*common, 0, b"" if payloads else None, 0, hashlib.sha256().hexdigest()))
        if rows:
            yield batch()

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(tasks, "file").mapInArrow(read, CHUNKS)


def payload_facts(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified, n_chunks), one row per record.

    Bytes and digest of a response are those of the chunks read; a revisit has those that its record declares.
    """
    last = F.max_by("digest", "chunk")
    grouped = chunks.groupBy("record_id").agg(
        *(F.first(c).alias(c) for c in ("page_id", "record_type", "refers_to", "declared_digest", "declared_bytes")),
        F.sum("n_bytes").alias("n_bytes"), last.alias("digest"), F.count(F.lit(1)).alias("n_chunks"))
    response = F.col("record_type") == "response"
    return grouped.select(
        "page_id", F.when(response, F.col("n_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to",
        (~response | ((F.col("digest") == F.col("declared_digest")) & (F.col("n_bytes") == F.col("declared_bytes")))).alias("verified"), "n_chunks")
