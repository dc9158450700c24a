"""Lines appended to growing files as a stream: the offset is how many bytes of each file have been read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from runlens.sources.files import file_system

# Bytes that one task reads of a file, and that one step of it holds.
SHARE = 64 << 20
STEP = 1 << 20
SCHEMA = "path string, place long, value string"


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin in [begin, end)."""

    path: str
    begin: int
    end: int
    first: int  # where the new part of the file begins: at a line's begin
    limit: int  # where it ends: after a line's end


def whole_lines(system: fs.FileSystem, path: str, size: int) -> int:
    """Bytes of the file up to the end of its last whole line among the first ``size`` bytes."""
    with system.open_input_file(path) as file:
        end = size
        while end > 0:
            begin = max(0, end - STEP)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str = "", share: int = SHARE):
        self.path, self.suffix, self.share = path, suffix, share
        self.sizes: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole lines of each file; a line still being written waits for its end. Only files that grew are opened."""
        system, root = file_system(self.path)
        for file in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            hidden = any(part[:1] in "._" for part in file.path[len(root) :].split("/") if part)
            if file.is_file and not hidden and file.path.endswith(self.suffix):
                if self.sizes.get(file.path, (None, 0))[0] != file.size:
                    self.sizes[file.path] = (file.size, whole_lines(system, file.path, file.size))
        return {path: lines for path, (_, lines) in self.sizes.items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, limit in sorted(end.items()):
            first = start.get(path, 0)
            if limit < first:  # the file was begun anew
                first = 0
            out += [Stretch(path, b, min(b + self.share, limit), first, limit) for b in range(first, limit, self.share)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """Only bytes from the stretch on, and the end of the line that reaches beyond it, are read."""
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as file:
            at, rest = partition.begin, b""
            if at > partition.first:
                # The line before belongs to the stretch before, if this stretch begins inside it.
                at -= 1
                file.seek(at)
                skipping = True
            else:
                file.seek(at)
                skipping = False
            begin = at
            while at < partition.limit and begin < partition.end:
                block = file.read(min(STEP, partition.limit - at))
                if not block:
                    break
                at += len(block)
                data = rest + block
                if skipping:
                    cut = data.find(b"\n") + 1
                    if not cut:
                        begin, rest = at, b""
                        continue
                    begin, data, skipping = begin + cut, data[cut:], False
                *lines, rest = data.split(b"\n")
                places, values = [], []
                for line in lines:
                    if begin >= partition.end:
                        break
                    places.append(begin)
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    begin += len(line) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())],
                    ["path", "place", "value"],
                )


class Tail(DataSource):
    """``spark.readStream.format("tail").load(path)``: path, place (byte) and text of every line, each once."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("share", SHARE)))


def tail(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """A stream of the lines of all files below ``path``, also those appended later; empty if there is none yet.

    What a checkpoint has taken in is not read again, not even opened, unless the file grew. A file that became shorter
    counts as a new one.
    """
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("suffix", suffix).load(path)
