"""Event frames in files as a source of Spark, for batches and streams.

The files of a folder, in order of their names, are one stream of bytes in which frames end with a blank line; a frame may
begin in one file and end in a later one, as a log that is cut by size has it. An offset is a place in that stream just
behind a frame, so a frame that is still being written waits for its end. Partitions are stretches of bytes: a reader
skips the frame that is under way where its stretch begins and reads on past its end until the last frame that began in
it is whole, so no frame is lost or read twice wherever cuts fall.

    spark.dataSource.register(EventFrames)
    spark.readStream.format("event_frames").load(folder)

Files are read by ``pyarrow.fs``, which takes local paths and addresses of shared stores.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "event string, id string, data string"
END = b"\n\n"
#: Bytes of a partition, and of what is read at a time.
STRETCH, CHUNK = 32 << 20, 1 << 20


class Stretch(InputPartition):
    """Bytes from ``start`` to ``end`` of the stream; ``last`` is where the whole frames end."""

    def __init__(self, start: int, end: int, last: int):
        self.start, self.end, self.last = start, end, last


class Bytes:
    """The files of a folder as one stream. What a file holds when the stream has gone past it does not change."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        found = self.files.get_file_info(fs.FileSelector(path))
        own = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        self.names = [n for n, _ in own]
        self.starts, total = [], 0
        for _, size in own:
            self.starts.append(total)
            total += size
        self.size = total

    def read(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``start``, over as many files as it takes."""
        out, at = [], start
        end = min(self.size, start + n)
        while at < end:
            k = bisect.bisect_right(self.starts, at) - 1
            stop = self.starts[k + 1] if k + 1 < len(self.starts) else self.size
            with self.files.open_input_file(self.names[k]) as f:
                f.seek(at - self.starts[k])
                got = f.read(min(end, stop) - at)
            out.append(got)
            at += len(got)
        return b"".join(out)

    def last_end(self, low: int) -> int:
        """The end of the last whole frame behind ``low``, or ``low``; reads backwards from the end."""
        high = self.size
        while high > low:
            start = max(low, high - CHUNK)
            found = self.read(start, high - start + 1).rfind(END)
            if found >= 0:
                return start + found + len(END)
            high = start
        return low


def rows_of(frame: bytes):
    """event, id, data of a frame: data lines are joined, comments and frames without data skipped."""
    held: dict[str, list[str]] = {}
    for line in frame.decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if name and colon:
            held.setdefault(name, []).append(value.removeprefix(" "))
    if "data" in held:
        yield tuple((held[k][-1] if k != "data" else "\n".join(held[k])) if k in held else None for k in ("event", "id", "data"))


class _Reading:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.stretch = int(options.get("stretch", STRETCH))

    def stretches(self, start: int, end: int) -> list[Stretch]:
        return [Stretch(a, min(a + self.stretch, end), end) for a in range(start, end, self.stretch)]

    def read(self, partition: Stretch):
        """The frames that begin in the stretch: behind a blank line that ends in it, or at the beginning of the stream."""
        own = Bytes(self.folder)
        begin = max(0, partition.start - len(END))
        at, held = begin, b""
        open_ = partition.start == 0 or own.read(begin, len(END)) == END  # a frame begins just here
        if open_:
            at = partition.start
        here = at  # where ``held`` begins in the stream
        while here < partition.last:
            cut = held.find(END)
            if cut < 0:
                if at >= partition.last:
                    return
                more = own.read(at, min(CHUNK, partition.last - at))
                held, at = held + more, at + len(more)
                continue
            if open_:
                yield from rows_of(held[:cut])
            open_ = True
            held, here = held[cut + len(END) :], here + cut + len(END)
            if here >= partition.end:
                return


class FrameReader(_Reading, DataSourceReader):
    def partitions(self):
        return self.stretches(0, Bytes(self.folder).last_end(0)) or [Stretch(0, 0, 0)]


class FrameStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": Bytes(self.folder).last_end(getattr(self, "seen", 0))}

    def partitions(self, start: dict, end: dict):
        return self.stretches(start["at"], end["at"])

    def commit(self, end: dict) -> None:
        self.seen = end["at"]


class EventFrames(DataSource):
    """Format ``event_frames``: event, id and data of each frame. Options: path, and stretch, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "event_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameStream(self.options)


def frame(data: dict, event: str | None = None, id: str | None = None) -> bytes:
    """One frame, for writers."""
    lines = [f"{k}: {v}" for k, v in (("event", event), ("id", id)) if v is not None]
    return ("\n".join([*lines, f"data: {json.dumps(data)}"]) + "\n\n").encode()
