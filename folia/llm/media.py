"""Media columns: archives of members as a Spark data source, and audio made of and turned back to bytes."""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from folia.llm.common import row_slices, scratch_path

#: Payload alignment in bytes, and sample rate written to headers.
BLOCK, RATE = 64, 8000
MEMBER_SCHEMA = "archive string, member string, offset long, media binary, error string"


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM in a RIFF container, one sample for each byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk; raises ValueError for anything but 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            if form is None or (form[0], form[1], form[5]) != (1, 1, 8) or at + 8 + size > len(media):
                raise ValueError("not whole 8-bit mono PCM")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or a plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


@dataclass
class ByteRange(InputPartition):
    """Members of one archive whose local headers start in [start, end)."""

    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class ArchiveSource(DataSource):
    """Directories of ZIP archives as rows (archive, member, offset, media, error); format("archive").

    Read options: path (directories, comma-separated), splitBytes (64 MB: archive bytes a
    partition), batchBytes (4 MB: payload bytes an Arrow batch), retries (3: reads of one
    member), onError ("fail", or "report" to give a row with null media and the error).
    An archive that cannot be opened, or has no table of contents, is tried as often; with
    "report" it gives one row with its name and the error. Write options: path, archiveBytes
    (256 MB), archiveMembers (50 000), level (1); written rows are (member string, media
    binary). Appending adds archives beside those that are there; overwriting removes those.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(dict(self.options), overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.split, self.batch = int(options.get("splitbytes", 64 << 20)), int(options.get("batchbytes", 4 << 20))
        self.retries, self.report = int(options.get("retries", 3)), options.get("onerror", "fail") == "report"

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from a listing alone: tables of contents are read by the tasks."""
        out = []
        for path in self.paths:
            fs, inner = filesystem(path)
            for f in sorted(fs.get_file_info(pafs.FileSelector(inner)), key=lambda f: f.path):
                if f.is_file and f.base_name.endswith(".zip") and f.base_name[0] not in "._":
                    name = f"{path.rstrip('/')}/{f.base_name}"
                    out += [ByteRange(name, at, min(at + self.split, f.size)) for at in range(0, max(1, f.size), self.split)]
        return out

    def member(self, fs, path: str, info: zipfile.ZipInfo, held: dict) -> bytes:
        """Read one member at its offset. A failed read opens the archive anew and tries this member alone again."""
        for attempt in range(self.retries):
            try:
                if "file" not in held:
                    held["file"] = fs.open_input_file(path)
                head = held["file"].read_at(30, info.header_offset)
                if head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {info.header_offset}")
                name, extra = struct.unpack_from("<HH", head, 26)
                data = held["file"].read_at(info.compress_size, info.header_offset + 30 + name + extra)
                if info.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompress(data, -15)
                elif info.compress_type != zipfile.ZIP_STORED:
                    raise NotImplementedError(f"compression {info.compress_type}")
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise OSError(f"member at {info.header_offset} is damaged")
                return data
            except (OSError, zlib.error):
                held.pop("file", None)
                if attempt + 1 == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise OSError("no attempts")

    def contents(self, fs, path: str) -> list[zipfile.ZipInfo]:
        """The members of an archive, by its table of contents; a failed read is tried again."""
        for attempt in range(self.retries):
            try:
                with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    return z.infolist()
            except (OSError, zipfile.BadZipFile):
                if attempt + 1 == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise OSError("no attempts")

    def read(self, partition: ByteRange | None):
        if partition is None:  # no archives at all
            return
        rows, size, held = [], 0, {}
        try:
            fs, path = filesystem(partition.archive)
            infos = [i for i in self.contents(fs, path) if partition.start <= i.header_offset < partition.end]
        except (OSError, zipfile.BadZipFile) as e:
            if not self.report:
                raise
            # every range of the archive fails: the first one says so
            infos = []
            if partition.start == 0:
                rows.append((partition.archive, None, None, None, f"{type(e).__name__}: {e}"))
        for info in sorted(infos, key=lambda i: i.header_offset):
            try:
                media, error = self.member(fs, path, info, held), None
            except (OSError, zlib.error, NotImplementedError) as e:
                if not self.report:
                    raise
                media, error = None, str(e)
            rows.append((partition.archive, info.filename, info.header_offset, media, error))
            size += len(media or b"")
            if size >= self.batch:
                yield self.rows(rows)
                rows, size = [], 0
        if rows:
            yield self.rows(rows)

    @staticmethod
    def rows(rows: list) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "member", "offset", "media", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.bytes, self.members, self.level = int(options.get("archivebytes", 256 << 20)), int(options.get("archivemembers", 50_000)), int(options.get("level", 1))

    def write(self, iterator) -> Written:
        """Archives under temporary names, unique to the attempt; commit gives those of the attempts that count their names, unique to the job."""
        from pyspark import TaskContext

        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        files, task, z, sink, size = [], TaskContext.get().partitionId(), None, None, 0
        for batch in iterator:
            for name, media in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
                if z is None or size >= self.bytes or len(z.filelist) >= self.members:
                    if z is not None:
                        z.close()
                        sink.close()
                    temporary = f"_{self.job}-{uuid.uuid4().hex}"
                    files.append((temporary, f"part-{self.job}-{task:06d}-{len(files):04d}.zip"))
                    sink = fs.open_output_stream(f"{inner}/{temporary}")
                    z, size = zipfile.ZipFile(_Out(sink), "w", zipfile.ZIP_DEFLATED, compresslevel=self.level), 0
                z.writestr(zipfile.ZipInfo(name), data := media.as_buffer().to_pybytes(), zipfile.ZIP_DEFLATED, self.level)
                size += len(data)
        if z is not None:
            z.close()
            sink.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        before = [f for f in fs.get_file_info(pafs.FileSelector(inner)) if f.is_file and f.base_name.endswith(".zip")]
        for m in messages:
            for temporary, name in m.files if m else ():
                fs.move(f"{inner}/{temporary}", f"{inner}/{name}")
        for f in before if self.overwrite else ():
            fs.delete_file(f.path)
        self.clear(fs, inner)

    def abort(self, messages) -> None:
        fs, inner = filesystem(self.path)
        self.clear(fs, inner)

    def clear(self, fs, inner: str) -> None:
        """Remove what attempts of this job that failed or came second have left."""
        for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                fs.delete_file(f.path)


class _Out(io.RawIOBase):
    """A write-only stream for zipfile, which then writes sizes behind the data."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(data)
        return len(data)


def features(payload: bytes) -> str:
    """Count, mean, root mean square and mid-line crossings of the samples, in whole numbers (thousandths for the mean and the root)."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"samples={len(x)};mean={int(x.sum()) * 1000 // len(x)};rms={isqrt(int((x * x).sum()) * 1_000_000 // len(x))};crossings={crossings}"


def padded(text: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of BLOCK."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def write_media(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store every text as a WAV member of archives under path, named by bytes of text and id."""

    def encode(batches):
        for whole in batches:
            for b in row_slices(whole):
                names, media = [], []
                for id_, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    names.append(f"{'null' if id_ is None else id_}.{len(data)}.wav")
                    media.append(to_wav(padded(data)))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], names=["member", "media"])

    df.sparkSession.dataSource.register(ArchiveSource)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.mapInArrow(encode, "member string, media binary").write.format("archive").mode("append").save(path)


def read_features(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read archives of write_media back and compute what the stored bytes hold."""

    def decode(batches):
        for b in batches:
            out = []
            for name, media in zip(b.column("member").to_pylist(), b.column("media"), strict=True):
                id_, n, _ = name.split(".")
                media = media.as_buffer().to_pybytes()
                payload = from_wav(media)
                sha, crc = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:])
                out.append((None if id_ == "null" else int(id_), int(n), len(payload), sha, crc, len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archive").load(path).select("member", "media")
    out = rows.mapInArrow(decode, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)


def media_features(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as 8-bit audio in archives of the shared folder, read it back, and describe it.

    The payload is the UTF-8 text and zero bytes up to a positive multiple of 64. Archives are
    written and read by the `archive` data source; tasks get byte ranges of archives, and a
    member that cannot be read is tried again on its own, by its offset.

    Returns a row for each row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    last 64 payload bytes), media_bytes, media_sha256 (of the WAV file), feature. Null text
    counts as empty: 64 zero bytes. Repeated rows are members of their own; a null id stays
    null. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    path = scratch_path(df.sparkSession, "media")
    write_media(df, path, id_col=id_col, text_col=text_col)
    return read_features(df.sparkSession, path, id_col)
