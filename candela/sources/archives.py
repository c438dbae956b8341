"""ZIP archives as a data source: lines of their members, read by ranges, many tasks for one archive."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, member string, line long, text string, problem string"
#: Compressed bytes of members that one task reads, if they are more than one member.
PACK_BYTES = 32 << 20
#: Rows of one batch.
ROWS = 10_000


def _opened(path: str):
    """(file system, path in it); fsspec is not needed, and any store that Arrow knows may be read."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Members(InputPartition):
    """Members that one task reads: (archive, names)."""

    archives: list[tuple[str, list[str]]]


class ZipLinesReader(DataSourceReader):
    """Partitions are packs of members by compressed size.

    Planning reads the archives' directories, at their ends, and no member.
    A task opens an archive by ranges and reads its own members' bytes, in one
    stream each; of a member only one line and one batch are held.
    """

    def __init__(self, path: str, suffix: str, pack_bytes: int):
        self.path, self.suffix, self.pack_bytes = path, suffix, pack_bytes

    def _archives(self) -> list[str]:
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [self.path]
        found = [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".zip")]
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return sorted(prefix + p for p in found)

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        room = 0
        for archive in self._archives():
            system, path = _opened(archive)
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for info in sorted(z.infolist(), key=lambda i: i.header_offset):
                    if info.is_dir() or not info.filename.endswith(self.suffix):
                        continue
                    if not out or info.compress_size > room:
                        out.append(Members([]))
                        room = self.pack_bytes
                    if not out[-1].archives or out[-1].archives[-1][0] != archive:
                        out[-1].archives.append((archive, []))
                    out[-1].archives[-1][1].append(info.filename)
                    room -= info.compress_size
        return out or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "line", "text", "problem"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for archive, members in partition.archives:
            system, path = _opened(archive)
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for name in members:
                    rows: list[tuple] = []
                    at = 0
                    try:
                        with z.open(name) as lines:
                            for raw in lines:
                                body = raw.rstrip(b"\r\n")
                                try:
                                    rows.append((archive, name, at, body.decode("utf-8"), None))
                                except UnicodeDecodeError:
                                    rows.append((archive, name, at, body.decode("utf-8", "replace"), "line is not UTF-8"))
                                at += 1
                                if len(rows) == ROWS:
                                    yield told(rows)
                                    rows = []
                    except (zipfile.BadZipFile, EOFError, OSError, RuntimeError) as error:
                        # What was read stays; the rest of a damaged or locked member is told.
                        rows.append((archive, name, at, None, f"member can't be read on: {type(error).__name__}"))
                    if rows:
                        yield told(rows)


class ZipLines(DataSource):
    """spark.read.format("zip_lines").load(path): options suffix (of members) and packBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipLinesReader:
        return ZipLinesReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("packbytes", PACK_BYTES)))


def archive_lines(spark: SparkSession, path: str, suffix: str = "", pack_bytes: int = PACK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, member, line, text) of all members of one archive or a folder's, and (path, member, line, text, problem) of what is damaged."""
    spark.dataSource.register(ZipLines)
    rows = spark.read.format("zip_lines").option("suffix", suffix).option("packBytes", str(pack_bytes)).load(path)
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL")


def _zipped(folder: str, per_member: int):
    """Sorted rows (archive, text) as archives in a folder, a member for each so many lines; one row a member is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        now, made, member, n, z, out = None, [], None, 0, None, None

        def closed():
            if z is not None:
                if member is not None:
                    member.close()
                z.close()
                out.close()

        for batch in batches:
            for archive, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive != now:
                    closed()
                    now, n, member = archive, 0, None
                    out = system.open_output_stream(f"{root}/{archive}.zip")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if n % per_member == 0:
                    if member is not None:
                        member.close()
                    name = f"part-{n // per_member:05d}.ndjson"
                    member = z.open(name, "w")
                    made.append((archive, name))
                member.write(text.encode() + b"\n")
                n += 1
        closed()
        columns = list(zip(*made)) if made else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["archive", "member"])

    return run


def write_archives(rows: DataFrame, archive: str, order: str, text: str, folder: str, per_member: int = 1000) -> DataFrame:
    """Write rows as lines of ZIP archives, one for each value of archive; (archive, member) of what was written.

    The folder must be shared by all tasks and exist. A task that is run again
    writes the same files over.
    """
    own = rows.select(rows[archive].cast("string").alias("archive"), rows[text].alias("text"), rows[order].alias("order"))
    return own.repartition("archive").sortWithinPartitions("archive", "order").select("archive", "text").mapInArrow(_zipped(folder, per_member), "archive string, member string")
