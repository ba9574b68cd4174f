"""WARC archives in seekable Zstandard bundles.

A bundle (``.warc.zst``) is a row of independent Zstandard frames, each holding a group of
records, then a skippable frame with the seek table: compressed and plain size of every
frame, frame count, magic number. The index maps a record id to its bundle, the offset of its frame
and the offset of the record inside the frame, so one record costs one frame.

Every task writes its own bundles, at most ``BUNDLE_BYTES`` of payload each, under a name with the
task attempt in it; the index is written as Parquet by the job and names only the bundles of
successful attempts. A lost executor costs its task; what a failed attempt left is not in the index
and is never read. ``pyarrow.fs`` writes the bundles and reads them back inside the tasks.

Revisits: of records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is the
response, the others refer to it and hold no payload. Equality is SHA-1 plus length. The
largest id per digest is aggregated map-side, so a hot page is no hot task, and the join back is
one Spark can split.

Defined results: a null payload is empty; a null url is an empty target; rows with a null id are
responses and never referred to; rows that repeat the winning id and payload are all responses. Extra columns
are not read. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from io import BytesIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import shared_dir

MIN_REVISIT = 1000
FRAME_BYTES = 256 * 1024         # plain bytes of a frame before it is closed
BUNDLE_BYTES = 64 * 1024 * 1024  # plain bytes of a bundle before it is closed
LEVEL = 3

# Fixed values of the formats: WARC line ends, Zstandard skippable frame and seek table magic.
CRLF = b"\r\n"
SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
NO_ID = "none"

INDEX = "page_id long, bundle string, frame_offset long, frame_size long, record_offset long, record_size long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_bytes(page_id, url: str, kind: str, refers_to, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but the digest and length of the full one."""
    body = payload if kind == "response" else b""
    urn = "<urn:page:{}>".format
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn(NO_ID if page_id is None else page_id)),
            ("WARC-Target-URI", " ".join(url.split())), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("Content-Type", "text/html"), ("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(body)))]
    if kind == "revisit":
        head += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in head), b"", b""]
    return CRLF.join(lines) + body + CRLF + CRLF


def parse_records(plain: bytes):
    """Yield (offset, size, headers, body) of the records in a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(CRLF + CRLF, at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        body = end + 4
        stop = body + int(head["Content-Length"])
        yield at, stop + 4 - at, head, plain[body:stop]
        at = stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, p) for c, p in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    start = len(bundle) - 9 - 8 * n
    out, at = [], 0
    for i in range(n):
        c, p = struct.unpack_from("<II", bundle, start + 8 * i)
        out.append((at, c, p))
        at += c
    return out


class BundleWriter:
    """Collects records into frames and frames into bundles; ``index`` has the rows of closed frames."""

    def __init__(self, folder: str, name: str, frame_bytes: int, bundle_bytes: int):
        from pyarrow import fs
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.frame_bytes, self.bundle_bytes = name, frame_bytes, bundle_bytes
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.number, self.out, self.index = 0, None, []
        self._open_frame()

    def _open_frame(self) -> None:
        self.plain, self.pending = BytesIO(), []

    def add(self, page_id, record: bytes) -> None:
        self.pending.append((page_id, self.plain.tell(), len(record)))
        self.plain.write(record)
        if self.plain.tell() >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.pending:
            return
        if self.out is None:
            self.bundle = f"{self.name}-{self.number:05d}.warc.zst"
            self.number += 1
            self.out, self.at, self.held, self.frames = self.fs.open_output_stream(f"{self.folder}/{self.bundle}", compression=None), 0, 0, []
        data = self.plain.getvalue()
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.index += [(i, self.bundle, self.at, len(packed), o, n) for i, o, n in self.pending]
        self.at, self.held = self.at + len(packed), self.held + len(data)
        self._open_frame()
        if self.held >= self.bundle_bytes:
            self.close_bundle()

    def close_bundle(self) -> None:
        self.close_frame()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    names = [c.split()[0] for c in INDEX.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)))

    def run(batches):
        task = TaskContext.get()
        writer = BundleWriter(folder, f"part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}", frame_bytes, bundle_bytes)

        def rows():
            out, writer.index = writer.index, []
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "kind", "refers_to", "payload", "digest")]
            for i in range(b.num_rows):
                page, url, kind, ref, payload, digest = (c[i].as_py() for c in columns)
                writer.add(page, record_bytes(page, url, kind, ref, payload, digest))
            if writer.index:
                yield rows()
        writer.close_bundle()
        if writer.index:
            yield rows()
    return run


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
                  min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), digest, kind, refers_to for every row."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    src = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
                       body.alias("payload"))
    src = src.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    winners = (src.filter((F.col("size") >= min_revisit) & F.col("page_id").isNotNull())
               .groupBy("digest", "size").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    joined = src.join(winners, ["digest", "size"], "left")
    revisit = F.col("winner").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("winner"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
                         F.when(revisit, F.col("winner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                   **columns) -> tuple[str, DataFrame]:
    """Write the bundles and their index. Returns (folder, index); bundles lie in ``folder``/data.

    ``folder`` must be one that all executors share; by default a new one under the cluster's
    ``spark.checkpoint.dir``.
    """
    spark = pages.sparkSession
    folder = (folder or shared_dir(spark, "warc")).rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    uri = file_uri(folder)
    index = with_revisits(pages, **columns).mapInArrow(_write(f"{uri}/data", frame_bytes, bundle_bytes), INDEX)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index")


def file_uri(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def _read(uri: str):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)))

    def urn(value):
        name = value.removeprefix("<urn:page:").removesuffix(">")
        return None if name == NO_ID else int(name)

    def run(batches):
        from pyarrow import fs
        files, root = fs.FileSystem.from_uri(uri)
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for name in b.column("bundle").to_pylist():
                with files.open_input_file(f"{root}/{name}") as f:
                    bundle = f.read()            # at most about BUNDLE_BYTES
                for at, size, _ in read_seek_table(bundle):
                    rows = []
                    for _, _, head, body in parse_records(unzip.decompress(bundle[at:at + size])):
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if head["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                        ref = head.get("WARC-Refers-To")
                        rows.append((urn(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], ref and urn(ref),
                                     int(head["X-Payload-Length"]), digest, body if head["WARC-Type"] == "response" else None))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    return run


def read_archives(folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, payloads checked against their digests.

    Only the bundle names are shuffled; each task opens its bundles itself.
    """
    return index.select("bundle").distinct().mapInArrow(_read(f"{file_uri(folder)}/data"), RECORDS)


def read_one(folder: str, entry) -> bytes:
    """The record of one index row: seeks to its frame and decompresses that alone."""
    from pyarrow import fs
    files, root = fs.FileSystem.from_uri(file_uri(folder))
    with files.open_input_file(f"{root}/data/{entry['bundle']}") as f:
        f.seek(entry["frame_offset"])
        plain = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_size"]))
    return plain[entry["record_offset"]:entry["record_offset"] + entry["record_size"]]
