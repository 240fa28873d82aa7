"""Raw audio streams as a Spark data source: a header, then frames of a size and a payload.

    spark.dataSource.register(AudioSource)
    spark.read.format("audio_frames").load(path)         # file, nth, payload_at, size, payload, and the header's fields
    df.write.format("audio_frames").option("sample_rate", 44100).option("channels", 2).mode("append").save(path)

The sink takes rows (payload) in the order they come, one file for each partition. Reading with the option payload=false seeks past payloads.
Files are opened where tasks run, as those of the packet source.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tilewave.sources.container import AUDIO_HEADER, AUDIO_MAGIC, FilePartition, Written, files_of, opened

FIELDS = {"sample_rate": 44_100, "channels": 1, "bit_depth": 16, "quality": 8}
SCHEMA = "file string, nth long, payload_at long, size long, payload binary, sample_rate long, channels int, bit_depth int, quality int"


class AudioReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.payload = files_of(options["path"]), options.get("payload", "true") != "false"
        self.magic = options.get("magic", AUDIO_MAGIC.decode()).encode()

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f) for f in self.files]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with opened(partition.path) as f:
            found, size, *fields = AUDIO_HEADER.unpack(f.read(AUDIO_HEADER.size))
            if found != self.magic or size != AUDIO_HEADER.size:
                raise ValueError(f"not a raw audio stream: {partition.path}")
            nth = 0
            while len(head := f.read(4)) == 4:
                (n,), at = struct.unpack("<I", head), f.tell()
                data = f.read(n) if self.payload else None
                if self.payload and len(data) < n:
                    raise ValueError(f"the last frame is cut off: {partition.path}")
                if not self.payload:
                    f.seek(n, 1)
                yield (partition.path, nth, at, n, data, *fields)
                nth += 1


class AudioWriter(DataSourceWriter):
    """Hidden files until the commit, which names those of the tasks that count, in the order of commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://").removeprefix("file:"), overwrite
        self.fields = [int(options.get(k, v)) for k, v in FIELDS.items()]
        self.magic = options.get("magic", AUDIO_MAGIC.decode()).encode()

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        part = f"{self.path}/.part-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(AUDIO_HEADER.pack(self.magic, AUDIO_HEADER.size, *self.fields))
            for r in rows:
                data = bytes(r.payload)
                f.write(struct.pack("<I", len(data)) + data)
        return Written(part)

    def commit(self, messages) -> None:
        old = files_of(self.path) if self.overwrite and os.path.isdir(self.path) else []
        for m in messages:
            if m:
                os.rename(m.file, f"{self.path}/part-{time.time_ns():020d}-{os.path.basename(m.file).removeprefix('.part-')}")
        for f in old:
            os.remove(f)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.file):
                os.remove(m.file)


class AudioSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> AudioReader:
        return AudioReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> AudioWriter:
        return AudioWriter(dict(self.options), overwrite)
