"""WARC archives of individually compressed records that share a Zstandard dictionary.

Each ``.warc.zst`` file begins with a skippable frame that holds a dictionary built from the
records of that file; every record is a frame of its own, compressed with it. A page whose
payload equals that of another page is a revisit record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, shared_folder
from . import words

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 24 << 20  # record bytes of one archive
DICTIONARY_BYTES = 64 << 10
TRAINING_BYTES = 4 << 20
LEVEL = 3
SKIPPABLE = 0x184D2A5D  # frame magic of a dictionary in front of WARC records
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha1(f'{page_id} {digest}'.encode()).hexdigest()[:32])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, which has HTTP headers but no payload."""
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]), *([] if url is not None else ["X-No-URL: 1"]),
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; the payload is empty for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def dictionary(records: list[bytes]):
    """A trained dictionary; where there is too little to train on, the records' own bytes serve as one."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    samples = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The bytes of one archive: the dictionary's frame, then a frame per record."""
    import zstandard

    shared = dictionary(records)
    raw = shared.as_bytes()
    yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    shared.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
    for one in records:
        yield compressor.compress(one)


def read_archive(file, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an open archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary")
    raw = file.read(size)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=shared)
    rest = file.read(chunk)
    while rest:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else file.read(chunk)
        yield b"".join(parts)
        rest = rest or file.read(chunk)


def write_archives(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive every row of ``pages(page_id, url, html, ...)`` in ``folder``; -> ``archive, records, bytes``, one row per file.

    ``folder`` is a URI that every executor can write to. Equal payloads of
    at least 1,000 bytes are one response, that with the largest page_id, and revisits; rows
    that repeat that page_id are responses too. Only ids and digests meet to decide this, and
    only rows that are revisits have anything to join. A null html is an empty payload; a null page_id is always a response.

    A task writes each file under a name of its own, so a task that runs again leaves a stray
    file but no wrong one: the returned manifest, which is checkpointed, names those that count.
    """
    pages = words.small_batches(pages)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = durable(pages.select("page_id", F.octet_length(payload).alias("n"), F.sha1(payload).alias("digest")).where(f"n >= {LEAST_REVISIT}"))
    best = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("held")).where("held > 1")
    revisits = keyed.join(best, "digest").where("page_id < refers_to").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)

        def put(records: list[bytes]) -> pa.RecordBatch:
            name, written = f"{uuid.uuid4().hex}.warc.zst", 0
            with system.open_output_stream(f"{root}/{name}") as out:
                for part in archive(records):
                    written += len(part)
                    out.write(part)
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [len(records)], "bytes": [written]})

        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, body, digest, refers_to = (batch.column(i)[row].as_py() for i in range(5))
                held.append(record(page_id, url, body, digest, refers_to, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return durable(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST))


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest``, with its payload (null for a revisit) unless left out.

    A response whose payload does not match its digest fails the job.
    """
    schema = RECORDS + (", payload binary" if payloads else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [part.split()[0] for part in schema.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        kinds = [types[part.split()[1]] for part in schema.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                rows, size = [], 0
                with system.open_input_stream(path) as file:
                    for raw in read_archive(file):
                        headers, payload = parse_record(raw)
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind = headers["WARC-Type"]
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["X-Payload-Length"])):
                            raise ValueError(f"{name}: payload and digest of {headers['WARC-Record-ID']} differ")
                        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
                        url = None if "X-No-URL" in headers else headers["WARC-Target-URI"]
                        row = (page and int(page), int(headers["X-Payload-Length"]), digest, kind, refers and int(refers), url)
                        rows.append((*row, payload if kind == "response" else None) if payloads else row)
                        size += len(raw)
                        if size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # The manifest has a partition per writer, so as many tasks read as have written.
    return manifest.select("archive").mapInArrow(read, schema)


def fresh_folder(spark) -> str:
    """A folder of its own for archives in the shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


ORACLE = f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as digest, max(page_id) over (partition by sha1(payload)) as best from p)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= {LEAST_REVISIT} and page_id < best then 'revisit' else 'response' end as record_type,
  case when n >= {LEAST_REVISIT} and page_id < best then best end as refers_to
from d"""
