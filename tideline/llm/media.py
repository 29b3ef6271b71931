"""Media columns: payloads as 8-bit images in archives, read back by a Spark data source.

Texts become greyscale PNG images, 64 samples a row, in zip archives of bounded size in a folder that Python can
open on every machine (any address pyarrow.fs knows), beside a manifest of their names and sizes. The data source plans
byte ranges over the archives of the manifest (of all in the folder, where there is none): the driver never opens one; a
task reads an archive's directory, takes the members that begin in its range, and streams them as Arrow batches. A member that fails is read again on its own from its offset; after the
last try it gives a row with `error` set instead of media.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import warnings
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The planner's and the workers' processes get these classes by value, so that they need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 64
#: Bytes of an archive; of a range, at least; and ranges at most, beyond which they are longer.
ARCHIVE_BYTES, RANGE_BYTES, RANGES = 256 << 20, 16 << 20, 1 << 16
MANIFEST = "manifest.jsonl"
BATCH_BYTES = 4 << 20
TRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of WIDTH."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def to_png(data: bytes) -> bytes:
    """The padded data as samples of an image; its length without padding stands in a text chunk."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"length\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples of an image that to_png() made, and the length without padding. ValueError where a chunk is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG image")
    at, body, length = 8, [], 0
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + data)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IDAT":
            body.append(data)
        elif kind == b"tEXt":
            length = int(data.partition(b"\0")[2])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filter is used")
    return lines[:, 1:].tobytes(), length


class _Sink:
    """What zipfile needs of a stream that only goes forward: members are written through, none is held."""

    def __init__(self, out):
        self.out, self.size = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_archives(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes the texts of docs (doc_id, text) as images into zip archives in the folder `path`, and a manifest; returns the number of archives.

    A null text counts as empty. A task streams an archive to a place aside and then moves it, under a name made of the
    partition's and the archive's number: a task that runs again replaces what an earlier try left. The manifest (a line
    of name and size for each archive) is written when all are there.
    """
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(folder)

    def run(it):
        fs, folder = pafs.FileSystem.from_uri(path)
        task, count, made = TaskContext.get(), 0, []
        sink = out = None

        def close():
            nonlocal sink, out
            out.close()
            sink.out.close()
            name = f"part-{task.partitionId():06d}-{len(made):04d}.zip"
            fs.move(f"{folder}/_{task.taskAttemptId()}-{len(made)}", f"{folder}/{name}")
            made.append((name, sink.size))
            sink = out = None

        for batch in it:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    sink = _Sink(fs.open_output_stream(f"{folder}/_{task.taskAttemptId()}-{len(made)}"))
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                out.writestr(zipfile.ZipInfo(f"{count:08d}_{key}.png"), to_png(data))
                count += 1
                if sink.size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.string()), pa.array([b for _, b in made], pa.int64())], ["name", "bytes"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "name string, bytes long").collect()  # a row for each archive
    with fs.open_output_stream(f"{folder}/{MANIFEST}") as f:
        f.write("".join(json.dumps(list(r)) + "\n" for r in sorted(made)).encode())
    return len(made)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def read_member(file, offset: int, size: int, crc: int) -> bytes:
    """A stored member from the offset of its local header; ValueError if its checksum differs."""
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(offset + 30 + name + extra)
    media = file.read(size)
    if len(media) != size or zlib.crc32(media) != crc:
        raise ValueError("member is damaged")
    return media


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self):
        fs, folder = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{folder}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
                files = [(f"{folder}/{name}", size) for name, size in map(json.loads, f.read().splitlines())]
        else:
            files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and f.base_name.endswith(".zip"))
        step = max(self.range_bytes, sum(size for _, size in files) // RANGES)
        return [ByteRange(name, at, at + step) for name, size in files for at in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if part.start <= m.header_offset < part.end]
        file, rows, held = fs.open_input_file(part.path), [], 0
        for m in members:
            media = error = None
            for _ in range(self.tries):
                try:
                    media, error = read_member(file, m.header_offset, m.file_size, m.CRC), None
                    break
                except (OSError, ValueError, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                    file.close()
                    file = fs.open_input_file(part.path)
            rows.append((part.path, m.header_offset, m.filename, media, error))
            held += len(media or b"")
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield self._batch(rows)
                rows, held = [], 0
        file.close()
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        a, o, n, m, e = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(o, pa.int64()), pa.array(n, pa.string()), pa.array(m, pa.binary()), pa.array(e, pa.string())], ["archive", "offset", "name", "media", "error"])


class ArchiveSource(DataSource):
    """format("tideline_archive"): members of the zip archives of the folder in option `path`; options rangeBytes and tries."""

    @classmethod
    def name(cls):
        return "tideline_archive"

    def schema(self):
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema):
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """archive, offset, name, media and error of every member."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        spark.dataSource.register(ArchiveSource)
    return spark.read.format("tideline_archive").option("path", path).options(**options).load()


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples, the share of zeros, and the counts of eight equal bins."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    n, s, q = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    return f"mean={s / n:.6f};std={max(0.0, q / n - (s / n) ** 2) ** 0.5:.6f};zero={int((x == 0).sum()) / n:.6f};bins={','.join(map(str, bins.tolist()))}"


def media_features(members: DataFrame) -> DataFrame:
    """What the stored images hold: doc_id (from the member's name; null if it was null), n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A member whose media could not be read, or not decoded, fails the query: no row is left out.
    """

    def run(it):
        for b in it:
            rows = []
            for name, media, error in zip(b.column("name").to_pylist(), b.column("media").to_pylist(), b.column("error").to_pylist(), strict=True):
                if error:
                    raise OSError(f"{name}: {error}")
                payload, length = from_png(media)
                key = name.rpartition("_")[2][:-4]
                rows.append((None if key == "None" else int(key), length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return members.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
