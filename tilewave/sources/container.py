"""Packet containers as a Spark data source, and raw audio streams.

Layout, little-endian without padding beyond two bytes: a header (magic, header size, version, stream count), a
descriptor per stream, then packets (magic, stream id, stream type, timestamp in microseconds, payload size, payload).

    spark.dataSource.register(ContainerSource)
    spark.read.format("packets").load(path)                          # packets; drop payload and it isn't read
    spark.read.format("packets").option("table", "streams").load(path)
    df.write.format("packets").option("streams", json).mode("append").save(path)    # one part file per partition; mode overwrite replaces
    spark.read.format("packets").option("pushdown", "true").load(path).where("ts_us < 5000000 and stream_id = 1")    # seeks by index
    payloads_at(index)                                                # (file, payload_at, size): payloads read by position
    spark.readStream.format("packets").option("maxFilesPerTrigger", 4).option("maxPacketsPerTrigger", 100000).option("progress", file).load(path)

A path is a file or a folder of part files; each file is one read partition. The reader seeks past payloads
if the option payload is "false" (an index scan with payload_at instead). Files are opened where the task runs, so
the path must be one that all executors mount.

With the option damaged=skip, stretches that are no packets come as rows of stream -1 with their size and place, and reading goes on
at the next header that can be one.

The sink writes a hidden index beside each part file: for each BLOCK packets, where they begin, their times and streams. With the
option pushdown (and spark.sql.python.filterPushdown.enabled), comparisons of file, seq, stream_id, stream_type, ts_us and size with
constants are met by the reader: it skips blocks by the index, where there is one, and else payloads by their headers.
"""

from __future__ import annotations

import glob
import json
import math
import os
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

#: Defaults of the options magic, packet_magic and audio_magic: files of other writers have their own.
MAGIC, PACKET_MAGIC, AUDIO_MAGIC, VERSION = b"TWPC", b"TP", b"TWAS", 1
HEADER, DESCRIPTOR, PACKET = struct.Struct("<4sIBB"), struct.Struct("<BBHHfIBBBx"), struct.Struct("<2sBBQI")
VIDEO, AUDIO = 0, 1
PACKETS_SCHEMA = "file string, seq long, stream_id int, stream_type int, ts_us long, size long, payload_at long, payload binary"
STREAMS_SCHEMA = "file string, stream_id int, stream_type int, width int, height int, frame_rate float, sample_rate long, channels int, bit_depth int, quality int"


@dataclass
class Stream:
    """Video fields are 0 for audio, and the other way round."""

    stream_type: int
    width: int = 0
    height: int = 0
    frame_rate: float = 0.0
    sample_rate: int = 0
    channels: int = 0
    bit_depth: int = 0
    quality: int = 0


def write_header(out, streams: list[Stream], magic: bytes = MAGIC) -> None:
    """Ids are given in order from 0."""
    out.write(HEADER.pack(magic, HEADER.size + len(streams) * DESCRIPTOR.size, VERSION, len(streams)))
    for i, s in enumerate(streams):
        out.write(DESCRIPTOR.pack(s.stream_type, i, s.width, s.height, s.frame_rate, s.sample_rate, s.channels, s.bit_depth, s.quality))


def write_packet(out, stream_id: int, stream_type: int, ts_us: int, payload: bytes, magic: bytes = PACKET_MAGIC) -> None:
    if not payload:
        raise ValueError("a packet needs a payload")
    out.write(PACKET.pack(magic, stream_id, stream_type, ts_us, len(payload)))
    out.write(payload)


def read_streams(src, magic: bytes = MAGIC) -> list[tuple[int, Stream]]:
    found, size, version, count = HEADER.unpack(src.read(HEADER.size))
    if found != magic or version != VERSION or size != HEADER.size + count * DESCRIPTOR.size:
        raise ValueError("not a packet container")
    out = []
    for _ in range(count):
        kind, i, width, height, rate, sample_rate, channels, depth, quality = DESCRIPTOR.unpack(src.read(DESCRIPTOR.size))
        out.append((i, Stream(kind, width, height, rate, sample_rate, channels, depth, quality)))
    return out


def read_packets(src, payload: bool = True, magic: bytes = PACKET_MAGIC, seq: int = 0, stop: int | None = None, wanted: Callable[[int, int, int, int, int], bool] | None = None) -> Iterator[tuple[int, int, int, int, int, int, bytes | None]]:
    """(seq, stream_id, stream_type, ts_us, size, payload_at, payload); the file is at packet seq. wanted: by the first five."""
    while (stop is None or seq < stop) and len(head := src.read(PACKET.size)) == PACKET.size:
        found, stream_id, kind, ts, size = PACKET.unpack(head)
        if found != magic:
            raise ValueError(f"no packet at {src.tell() - PACKET.size}")
        at = src.tell()
        if wanted and not wanted(seq, stream_id, kind, ts, size):
            src.seek(size, 1)
        else:
            data = src.read(size) if payload else None
            if payload and len(data) < size:
                raise ValueError("the last packet is cut off")
            if not payload:
                src.seek(size, 1)
            yield seq, stream_id, kind, ts, size, at, data
        seq += 1


def read_damaged(src, size: int, ids: dict[int, int], magic: bytes = PACKET_MAGIC, piece: int = 1 << 16) -> Iterator[tuple[int, int, int, int, int, int, bytes | None]]:
    """The rows of read_packets for what is whole, and for each stretch that isn't a row with stream -1, its size and place. A header counts
    if its stream is described with its type, and its payload ends inside the file.

    ids: type by stream id. size: bytes of the file.
    """
    seq, at, lost = 0, src.tell(), None

    def header(place: int) -> tuple[int, int, int, int] | None:
        src.seek(place)
        head = src.read(PACKET.size)
        if len(head) < PACKET.size:
            return None
        found, stream_id, kind, ts, n = PACKET.unpack(head)
        return (stream_id, kind, ts, n) if found == magic and ids.get(stream_id) == kind and 0 < n <= size - place - PACKET.size else None

    while at < size:
        if (head := header(at)) is not None:
            if lost is not None:
                yield -1, -1, -1, None, at - lost, lost, None
                lost = None
            src.seek(at + PACKET.size)
            yield seq, *head, at + PACKET.size, src.read(head[3])
            seq, at = seq + 1, at + PACKET.size + head[3]
            continue
        lost = at if lost is None else lost
        # the next magic, by pieces that overlap by its length
        at += 1
        while at < size:
            src.seek(at)
            found = src.read(piece).find(magic)
            if found >= 0:
                at += found
                break
            at += piece - len(magic) + 1
        at = min(at, size)
    if lost is not None:
        yield -1, -1, -1, None, size - lost, lost, None


#: Packets that a line of an index stands for: first seq, place, packets, least and greatest time, streams as bits.
BLOCK, LINE = 64, struct.Struct("<QQIQQ32s")


class IndexWriter:
    def __init__(self) -> None:
        self.lines: list[tuple[int, int, int, int, int, int]] = []

    def add(self, seq: int, place: int, stream_id: int, ts: int) -> None:
        if seq % BLOCK == 0:
            self.lines.append((seq, place, 0, ts, ts, 0))
        first, start, n, low, high, streams = self.lines[-1]
        self.lines[-1] = (first, start, n + 1, min(low, ts), max(high, ts), streams | 1 << stream_id)

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            for *line, streams in self.lines:
                f.write(LINE.pack(*line, streams.to_bytes(32, "little")))


def index_path(path: str) -> str:
    return os.path.join(os.path.dirname(path), "_index-" + os.path.basename(path).lstrip("."))


def read_index(path: str) -> list[tuple[int, int, int, int, int, int]] | None:
    """The lines of a part file's index, if it has one."""
    if not os.path.exists(index_path(path)):
        return None
    with opened(index_path(path)) as f:
        return [(*line, int.from_bytes(streams, "little")) for *line, streams in LINE.iter_unpack(f.read())]


class Wanted:
    """Comparisons with constants, as ranges and sets of values by column."""

    COLUMNS = ("seq", "stream_id", "stream_type", "ts_us", "size")

    def __init__(self) -> None:
        self.ranges: dict[str, tuple[float, float]] = {}
        self.sets: dict[str, set] = {}

    def take(self, f: Filter) -> bool:
        """Whether the filter is met from now on."""
        name = ".".join(getattr(f, "attribute", ()))
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        if name not in (*self.COLUMNS, "file") or any(v is None for v in values):
            return False
        if isinstance(f, (EqualTo, In)):
            self.sets[name] = self.sets[name] & set(values) if name in self.sets else set(values)
            return True
        if name == "file" or not isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            return False
        low, high = self.ranges.get(name, (-math.inf, math.inf))
        v = values[0]
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, v + isinstance(f, GreaterThan))
        else:
            high = min(high, v - isinstance(f, LessThan))
        self.ranges[name] = (low, high)
        return True

    def fits(self, name: str, value) -> bool:
        low, high = self.ranges.get(name, (-math.inf, math.inf))
        return (name not in self.sets or value in self.sets[name]) and (name == "file" or low <= value <= high)

    def packet(self, *values: int) -> bool:
        return all(self.fits(n, v) for n, v in zip(self.COLUMNS, values))

    def _between(self, name: str, low: int, high: int) -> bool:
        a, b = self.ranges.get(name, (-math.inf, math.inf))
        return a <= high and low <= b and (name not in self.sets or any(low <= v <= high for v in self.sets[name]))

    def block(self, line: tuple[int, int, int, int, int, int]) -> bool:
        first, _, n, low, high, streams = line
        return self._between("seq", first, first + n - 1) and self._between("ts_us", low, high) and any(streams >> i & 1 and self.fits("stream_id", i) for i in range(streams.bit_length()))


def opened(path: str) -> BinaryIO:
    return open(path, "rb", 4096)


def read_payload(path: str, at: int, size: int) -> bytes:
    with opened(path) as f:
        f.seek(at)
        return f.read(size)


def payloads_at(index: DataFrame) -> DataFrame:
    """index with the column payload, read from (file, payload_at, size); the rows of a partition are read in the order of their places."""
    rows = index.drop("payload").sortWithinPartitions("file", "payload_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            found = []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "payload_at", "size"))):
                if file != path:
                    if f:
                        f.close()
                    path, f = file, opened(file)
                f.seek(at)
                found.append(f.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "payload"])
        if f:
            f.close()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("payload", BinaryType())]))


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    return sorted(p for p in glob.glob(f"{path}/*") if not os.path.basename(p).startswith(("_", "."))) if os.path.isdir(path) else [path]


def magics(options: dict) -> tuple[bytes, bytes]:
    return options.get("magic", MAGIC.decode()).encode(), options.get("packet_magic", PACKET_MAGIC.decode()).encode()


class FilePartition(InputPartition):
    """Packets seq up to stop of a file, the first of them at place; place 0: behind the header."""

    def __init__(self, path: str, seq: int = 0, place: int = 0, stop: int | None = None):
        self.path, self.seq, self.place, self.stop = path, seq, place, stop


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = files_of(options["path"])
        self.streams, self.payload = options.get("table", "packets") == "streams", options.get("payload", "true") != "false"
        self.magics, self.damaged = magics(options), options.get("damaged") == "skip"
        self.wanted = Wanted()

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f) for f in self.files if self.wanted.fits("file", f)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with opened(partition.path) as f:
            streams = read_streams(f, self.magics[0])
            if self.streams:
                for i, s in streams:
                    yield (partition.path, i, s.stream_type, s.width, s.height, s.frame_rate, s.sample_rate, s.channels, s.bit_depth, s.quality)
                return
            if self.damaged:
                for row in read_damaged(f, os.path.getsize(partition.path), {i: s.stream_type for i, s in streams}, self.magics[1]):
                    yield (partition.path, *row)
                return
            some = self.wanted.packet if self.wanted.ranges or self.wanted.sets else None
            lines = read_index(partition.path) if some else None
            for first, place, n in [(line[0], line[1], line[2]) for line in lines if self.wanted.block(line)] if lines is not None else [(0, f.tell(), None)]:
                f.seek(place)
                for row in read_packets(f, self.payload, self.magics[1], first, None if n is None else first + n, some):
                    yield (partition.path, *row)


class PushdownReader(ContainerReader):
    """A class of its own, since Spark refuses a reader with pushFilters where its pushdown is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.streams or self.damaged or not self.wanted.take(f):
                yield f


class ContainerStreamReader(DataSourceStreamReader):
    """New files of a folder. An offset holds the names of the files taken, so that a file counts once, whatever its name, and how far
    the file at hand was taken.

    maxFilesPerTrigger and maxPacketsPerTrigger bound what a batch gets. Spark asks for the latest offset without saying where the query
    stands, so the option progress must then name a file, one for each query, that keeps what was handed out last. A trigger for what is
    available now asks for one offset only, so bounded streams are drained by processAllAvailable().
    """

    def __init__(self, options: dict):
        self.path, self.magics = options["path"], magics(options)
        self.max_files, self.max_packets = (int(x) if (x := options.get(k)) else None for k in ("maxfilespertrigger", "maxpacketspertrigger"))
        self.bounded, self.progress = self.max_files is not None or self.max_packets is not None, options.get("progress")
        if self.bounded and not self.progress:
            raise ValueError("a bounded stream needs the option progress")

    def initialOffset(self) -> dict:
        return {"files": [], "part": "", "seq": 0, "place": 0}

    def latestOffset(self) -> dict:
        files = files_of(self.path)
        if not self.bounded:
            return {**self.initialOffset(), "files": files}
        at = self.initialOffset()
        if os.path.exists(self.progress):
            with open(self.progress) as f:
                at = json.load(f)
        at = self._admitted(at, files)
        with open(self.progress + ".new", "w") as f:
            json.dump(at, f)
        os.replace(self.progress + ".new", self.progress)
        return at

    def _admitted(self, start: dict, files: list[str]) -> dict:
        done, (part, seq, place) = list(start["files"]), (start["part"], start["seq"], start["place"])
        left, packets, seen = self.max_files, self.max_packets, set(done)
        for file in ([part] if part else []) + [f for f in files if f not in seen and f != part]:
            if left == 0 or packets == 0:
                break
            left = None if left is None else left - 1
            if file != part:
                part, seq, place = file, 0, 0
            if packets is not None:
                stop = seq + packets
                seq, place, more = self._advanced(file, seq, place, stop)
                packets = stop - seq
                if more:
                    break
            done.append(file)
            part, seq, place = "", 0, 0
        return {"files": done, "part": part, "seq": seq, "place": place}

    def _advanced(self, file: str, seq: int, place: int, stop: int) -> tuple[int, int, bool]:
        """(packets, place, whether there are more) from seq on, up to stop, by headers alone."""
        with opened(file) as f:
            read_streams(f, self.magics[0])
            f.seek(place or f.tell())
            place = f.tell()
            for n, *_, size, at, _ in read_packets(f, False, self.magics[1], seq, stop):
                seq, place = n + 1, at + size
            return seq, place, len(f.read(PACKET.size)) == PACKET.size

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        seen, out = set(start["files"]), []
        for file in [f for f in end["files"] if f not in seen] + ([end["part"]] if end["part"] else []):
            seq, place = (start["seq"], start["place"]) if file == start["part"] else (0, 0)
            stop = end["seq"] if file == end["part"] else None
            if stop is None or stop > seq:
                out.append(FilePartition(file, seq, place, stop))
        return out

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with opened(partition.path) as f:
            read_streams(f, self.magics[0])
            f.seek(partition.place or f.tell())
            for row in read_packets(f, True, self.magics[1], partition.seq, partition.stop):
                yield (partition.path, *row)


@dataclass
class Written(WriterCommitMessage):
    file: str


class ContainerWriter(DataSourceWriter):
    """Rows (stream_id, stream_type, ts_us, payload) in the order they come. Each task writes a hidden file; the commit gives the
    files of the tasks that count their names, in the order of commits, and takes those of earlier writes away if they are overwritten."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://").removeprefix("file:"), overwrite
        self.streams, self.magics = [Stream(**s) for s in json.loads(options["streams"])], magics(options)

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        part = f"{self.path}/.part-{uuid.uuid4().hex}"
        index = IndexWriter()
        with open(part, "wb") as f:
            write_header(f, self.streams, self.magics[0])
            for seq, r in enumerate(rows):
                index.add(seq, f.tell(), r.stream_id, r.ts_us)
                write_packet(f, r.stream_id, r.stream_type, r.ts_us, bytes(r.payload), self.magics[1])
        index.write(index_path(part))
        return Written(part)

    def commit(self, messages) -> None:
        old = files_of(self.path) if self.overwrite and os.path.isdir(self.path) else []
        for m in messages:
            if m:
                name = f"{self.path}/part-{time.time_ns():020d}-{os.path.basename(m.file).removeprefix('.part-')}"
                os.rename(index_path(m.file), index_path(name))
                os.rename(m.file, name)
        for f in old:
            remove(f)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.file):
                remove(m.file)


def remove(path: str) -> None:
    """A part file, and its index."""
    os.remove(path)
    if os.path.exists(index_path(path)):
        os.remove(index_path(path))


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return STREAMS_SCHEMA if self.options.get("table") == "streams" else PACKETS_SCHEMA

    def reader(self, schema: StructType) -> ContainerReader:
        return (PushdownReader if self.options.get("pushdown") == "true" else ContainerReader)(dict(self.options))

    def streamReader(self, schema: StructType) -> ContainerStreamReader:
        return ContainerStreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options), overwrite)


# ---- raw audio streams: a header, then frames of (size, payload) --------------------------------------------

AUDIO_HEADER = struct.Struct("<4sIIBBB")


def write_audio(out, sample_rate: int, channels: int, bit_depth: int, quality: int, frames: list[bytes], magic: bytes = AUDIO_MAGIC) -> None:
    out.write(AUDIO_HEADER.pack(magic, AUDIO_HEADER.size, sample_rate, channels, bit_depth, quality))
    for frame in frames:
        out.write(struct.pack("<I", len(frame)) + frame)


def read_audio(src, magic: bytes = AUDIO_MAGIC) -> tuple[dict, list[bytes]]:
    found, size, rate, channels, depth, quality = AUDIO_HEADER.unpack(src.read(AUDIO_HEADER.size))
    if found != magic or size != AUDIO_HEADER.size:
        raise ValueError("not a raw audio stream")
    frames = []
    while len(head := src.read(4)) == 4:
        (n,) = struct.unpack("<I", head)
        frames.append(src.read(n))
    return {"sample_rate": rate, "channels": channels, "bit_depth": depth, "quality": quality}, frames
