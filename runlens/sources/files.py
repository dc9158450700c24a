"""Files by name: a writer that gives each file its rows and its name, and a listing of folders, both in tasks.

Paths are those that pyarrow's file systems know: shared folders, ``file:``, ``hdfs:``, ``s3:`` and the like.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from runlens.session import keep


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path inside it; ``file:`` may have any number of slashes."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFilesWriter(DataSourceArrowWriter):
    """Writes rows (file, value): the lines of each file below the target, a file with no line from a null value.

    All rows of a file come to one task one after the other. A file is written aside, gets its name in a staged copy of
    the tree when it is complete, and the whole tree gets the target's name when all tasks are done. So a task that runs
    again writes the same files again, and a job that fails leaves nothing at the target.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, staged = file_system(self.staged)
        out, name, files = None, None, 0
        aside = f"{staged}/parts/{uuid.uuid4().hex}"
        system.create_dir(f"{staged}/parts", recursive=True)

        def finish() -> int:
            if name is None:
                return 0
            out.close()
            target = f"{staged}/tree/{name}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            system.move(aside, target)
            return 1

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                file = batch.column("file")
                same = pc.equal(file[1:], file[:-1]).to_pylist()
                bounds = [0, *(i + 1 for i, s in enumerate(same) if not s), batch.num_rows]
                for low, high in zip(bounds[:-1], bounds[1:]):
                    if file[low].as_py() != name:
                        files += finish()
                        name = file[low].as_py()
                        out = system.open_output_stream(aside)
                    lines = [v for v in batch.column("value")[low:high].to_pylist() if v is not None]
                    if lines:
                        out.write(("\n".join(lines) + "\n").encode())
            files += finish()
            name = None
        finally:
            if name is not None and out is not None:  # a file that was not finished
                out.close()
                system.delete_file(aside)
        return Written(files)

    def _drop(self) -> None:
        system, staged = file_system(self.staged)
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, target = file_system(self.path)
        _, staged = file_system(self.staged)
        there = system.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self._drop()
            raise FileExistsError(target)
        system.create_dir(f"{staged}/tree", recursive=True)
        if there:
            system.delete_dir(target)
        system.move(f"{staged}/tree", target)
        self._drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop()


class NamedFiles(DataSource):
    """``df.write.format("named_files").save(path)`` for rows (file string, value string)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``lines`` (file, seq, value) as the files of a new tree at ``path``, each one's lines in the order of seq.

    A row with a null value gives its file no line, so a file of such rows alone is empty. A tree that is there already
    is an error, or replaced with ``mode`` overwrite. A file may have any number of lines: they stream through its task.
    """
    lines.sparkSession.dataSource.register(NamedFiles)
    ordered = lines.repartition("file").sortWithinPartitions("file", "seq").select("file", "value")
    ordered.write.format("named_files").mode(mode).save(path)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each folder holds, folders and files."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            system, inside = file_system(folder)
            prefix = folder[: len(folder) - len(inside)] if folder.endswith(inside) else ""
            found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
            for at in range(0, len(found), 10_000):
                some = found[at : at + 10_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array([prefix + f.path for f in some], pa.string()),
                        "length": pa.array([f.size if f.is_file else None for f in some], pa.int64()),
                    }
                )


def list_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """``path, length`` of all files below ``root`` whose name ends in ``suffix``, empty ones too.

    Folders are listed by tasks, one level of the tree after the other; the driver sees no path, and the number of
    rounds is the depth of the tree. Names that begin with a dot or an underscore are passed over, folders as well.
    """
    folders = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    files = None
    visible = ~F.element_at(F.split("path", "/"), -1).rlike("^[._]")
    while True:
        # Folders spread over the tasks: they may hold very different numbers of files.
        found = keep(folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_entries, "path string, length long").where(visible), "listed")
        own = found.where(F.col("length").isNotNull() & F.col("path").endswith(suffix))
        files = own if files is None else files.unionByName(own)
        folders = found.where("length is null").select("path")
        if folders.isEmpty():
            return files
