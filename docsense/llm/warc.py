"""Zstandard-compressed WARC archives: writer, reader and revisit records (operator 12).

An archive (``.warc.zst``) begins with a skippable frame that holds its dictionary, itself compressed or not; after it every
record is one Zstandard frame of its own, so a reader can start at any frame. The reader loads the dictionary, decodes frame
by frame in windows of ``WINDOW`` bytes and validates each record: version line, mandatory headers, block length, the blank
lines that end it, block and payload digests, and the HTTP length of the payload. What is broken raises ``Broken`` with the
archive and the place; nothing is skipped silently.

Records are HTTP responses. Of records with equal payloads of at least ``LEAST`` bytes the one with the largest page_id is
written in full; the others are ``revisit`` records, which keep the HTTP head but no payload and name the response. Equal
payloads are those of one SHA-256 digest, so hot groups of copies meet in aggregates only; the table of repeated payloads
is broadcast up to ``BROADCAST_COPIES`` rows and joined by a shuffle beyond.

A null html is an empty payload. Rows that repeat a page_id with the same payload are records of their own and alike (all
responses, if theirs is the largest page_id). A null page_id is smaller than any other; if a group has no other, its rows
are responses. An empty table writes no archive and gives an empty result. Pages of any length are one record, whole; other
columns are ignored. Archives are rolled at ``ROLL`` bytes, so a task's memory doesn't grow with its share of the pages.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsense.llm.common import materialise, shared_dir

#: Payloads of fewer bytes are always written in full.
LEAST = 1000
#: Compressed bytes after which a task begins another archive.
ROLL = 64 << 20
#: Bytes that the reader takes from the store at once.
WINDOW = 256 << 10
LEVEL = 3
#: The dictionary is trained on the first bytes of about so many pages, twice as many at most; it changes sizes, never results.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 600, 8192, 64 << 10
BROADCAST_COPIES = 200_000

#: Fixed values of the format: magic numbers of the dictionary's skippable frame, of a frame and of a trained dictionary.
SKIPPABLE, FRAME, DICTIONARY = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Archives must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"


class Broken(ValueError):
    """An archive or record that isn't what its headers say."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as it stands in the archive before compression."""
    digest = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _page_uri(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_uri(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes], where: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Broken(f"{where}: header line without a name")
        key = name.strip().lower().decode("ascii", "replace")
        if key in found and key in MANDATORY:
            raise Broken(f"{where}: header {key} twice")
        found.setdefault(key, value.strip().decode("utf-8", "replace"))
    return found


def _length(value: str, where: str) -> int:
    if not (value.isascii() and value.isdigit()):
        raise Broken(f"{where}: length {value!r} is no number")
    return int(value)


def decode(raw: bytes, where: str = "record") -> Record:
    """The record in the bytes of one frame, with version, headers, length, end and block digest validated."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not lines[0].startswith(b"WARC/1."):
        raise Broken(f"{where}: no version line or no end of the headers")
    headers = _fields(lines[1:], where)
    if missing := [k for k in MANDATORY if k not in headers]:
        raise Broken(f"{where}: without {', '.join(missing)}")
    size = _length(headers["content-length"], where)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Broken(f"{where}: block of {max(len(rest) - 4, 0)} bytes, headers say {size}")
    block = rest[:size]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != hashlib.sha1(block).hexdigest():
        raise Broken(f"{where}: block digest differs")
    return Record(headers["warc-type"], headers, block)


def payload_of(record: Record, where: str = "record") -> tuple[int, str, bytes]:
    """Length and SHA-1 (hex) of the full payload, and the payload bytes that the record holds.

    For a response they are measured and held against its headers; a revisit has none, and its headers tell.
    """
    head, blank, payload = record.block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not lines[0].startswith(b"HTTP/"):
        raise Broken(f"{where}: block is no HTTP response")
    size = _length(_fields(lines[1:], where).get("content-length", ""), where)
    stated = record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if record.kind == "revisit":
        if payload or not stated or "warc-refers-to" not in record.headers:
            raise Broken(f"{where}: revisit with a payload, or without digest or response")
        return size, stated, payload
    digest = hashlib.sha1(payload).hexdigest()
    if size != len(payload) or stated != digest:
        raise Broken(f"{where}: payload of {len(payload)} bytes and digest {digest}, headers say {size} and {stated}")
    return size, digest, payload


def preamble(dictionary: bytes) -> bytes:
    """The leading skippable frame with the dictionary, compressed."""
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return SKIPPABLE + struct.pack("<I", len(body)) + body


def load_dictionary(stream, where: str = "archive") -> bytes:
    """The dictionary in the leading skippable frame of ``stream``, which is left behind that frame."""
    start = stream.read(8)
    if len(start) < 8 or start[:4] != SKIPPABLE:
        raise Broken(f"{where}: no dictionary frame at its start")
    size = struct.unpack("<I", start[4:])[0]
    body = stream.read(size)
    if len(body) != size:
        raise Broken(f"{where}: dictionary of {len(body)} bytes, its frame says {size}")
    if body[:4] == FRAME:
        body = zstandard.ZstdDecompressor().decompress(body)
    return body


def frames(stream, dictionary: bytes, where: str = "archive") -> Iterator[tuple[int, bytes]]:
    """(place, content) of every frame that follows; memory holds one frame and one window."""
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    number, held = 0, b""
    while True:
        held = held or stream.read(WINDOW)
        if not held:
            return
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as error:
                raise Broken(f"{where}, frame {number}: {error}") from error
            held = frame.unused_data
            if not frame.eof:
                held = stream.read(WINDOW)
                if not held:
                    raise Broken(f"{where}, frame {number}: ends within a frame")
        yield number, b"".join(parts)
        number += 1


def records(stream, where: str = "archive") -> Iterator[tuple[str, Record]]:
    """(place, record) of every record of an open archive."""
    for number, raw in frames(stream, load_dictionary(stream, where), where):
        at = f"{where}, frame {number}"
        yield at, decode(raw, at)


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_of(pages: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample of the pages."""
    share = max(1, pages.count() // SAMPLE_PAGES)
    chosen = pages.where("html is not null").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(share)) == 0)
    rows = chosen.select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(2 * SAMPLE_PAGES).collect()
    return train([encode(0, "", r.html.encode()) for r in rows])


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, record_type and refers_to: which pages are written in full and which revisit another."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(_payload(F.col("html"))) >= LEAST, F.unhex(F.sha2(_payload(F.col("html")), 256))).alias("key"))
    counted = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    copies = materialise(counted.where("n > 1 and kept is not null").select(F.col("key").alias("copied"), "kept"), "warc-copies")
    few = copies.count() <= BROADCAST_COPIES
    joined = keyed.join(F.broadcast(copies) if few else copies, F.col("key") == F.col("copied"), "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))


MANIFEST = "path string, records long, bytes long"


def write(plan: DataFrame, folder: str, dictionary: bytes, roll: int = ROLL) -> DataFrame:
    """Write the records of ``planned`` as archives in ``folder`` (a URI that every executor reaches); their manifest.

    An archive is renamed when whole, and each attempt at a task has names of its own: the manifest, which only a successful
    attempt's rows enter, never mixes archives of two attempts whose rows came in different orders.
    """
    shared = plan.sparkSession.sparkContext.broadcast(dictionary)

    def put(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        known = shared.value
        packed = zstandard.ZstdCompressionDict(known) if known else None
        if packed:
            packed.precompute_compress(level=LEVEL)
        context = zstandard.ZstdCompressor(level=LEVEL, dict_data=packed, write_checksum=True, write_content_size=True)
        out, scratch, number, held, size, done = None, "", 0, 0, 0, []

        def close():
            nonlocal out, number, held
            if out is not None:
                out.close()
                task = TaskContext.get()
                final = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
                store.move(scratch, final)
                done.append((f"{folder}/{final.rsplit('/', 1)[1]}", held, size))
                out, number, held = None, number + 1, 0

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "record_type", "refers_to")]
            for page_id, url, html, kind, refers_to in zip(*columns):
                if out is None:
                    scratch = f"{root}/.{os.urandom(8).hex()}"
                    out = store.open_output_stream(scratch, compression=None)
                    out.write(start := preamble(known))
                    size = len(start)
                frame = context.compress(encode(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), kind.as_py() == "revisit"))
                out.write(frame)
                held, size = held + 1, size + len(frame)
                if size >= roll:
                    close()
        close()
        paths, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return plan.mapInArrow(put, MANIFEST)


FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives named in the column ``path``, validated: page_id, url, payload_bytes and payload_digest
    (of the full payload), record_type, refers_to, and the payload bytes it holds (none for a revisit, or if not wanted).
    """

    def get(batches):
        from pyarrow import fs

        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows):
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, file = fs.FileSystem.from_uri(path)
                with store.open_input_stream(file, compression=None) as stream:
                    rows, held = [], 0
                    for at, record in records(stream, path):
                        size, digest, payload = payload_of(record, at)
                        told = record.headers
                        refers_to = page_of(told["warc-refers-to"]) if record.kind == "revisit" else None
                        rows.append((page_of(told["warc-record-id"]), told.get("warc-target-uri"), size, digest, record.kind, refers_to, payload if payloads else None))
                        held += len(payload) * payloads
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    return archives.select("path").mapInArrow(get, FOUND)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Plan and write the pages to ``folder`` (by default a new one in the shared folder); the written manifest."""
    folder = folder or f"{shared_dir(spark)}/docsense/warc-{uuid.uuid4().hex}"
    return materialise(write(planned(pages), folder, dictionary_of(pages)), "warc-manifest")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The pages written as archives and read back, an archive a task, without their payloads."""
    manifest = archive(spark, pages)
    found = read(manifest.repartition(max(1, manifest.count())), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
