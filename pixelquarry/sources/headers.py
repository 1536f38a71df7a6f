"""A data source of image sizes that reads the heads of files, in batch and as a stream.

    spark.dataSource.register(ImageHeaders)
    spark.read.format("image_headers").option("path", root).load()

A partition is a share of the files; of each, ``HEAD`` bytes are read, and more only while a JPEG's size lies further
behind, up to ``option("most")``.  Folders are listed and files opened by Arrow's file systems (local disk, HDFS, S3, GCS), so
executors read them where they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import IMAGE_SUFFIXES, image_size

HEAD = 4096


def _listed(root: str, names: tuple[str, ...]) -> tuple[fs.FileSystem, list[tuple[str, int, int]]]:
    """(path, length, time in ns) of all files below a root with one of the suffixes, in the order of time and path."""
    where, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    found = where.get_file_info(fs.FileSelector(path, recursive=True))
    rows = [(f.path, f.size, f.mtime_ns or 0) for f in found if f.is_file and f.path.lower().endswith(names)]
    return where, sorted(rows, key=lambda r: (r[2], r[0]))


def head_size(where: fs.FileSystem, path: str, most: int) -> tuple[int | None, int | None, str | None, int]:
    """Width, height, error and the bytes read of one file."""
    try:
        with where.open_input_file(path) as f:
            data, step = b"", HEAD
            while True:
                more = f.read_at(step, len(data))
                data += more
                size = image_size(data)
                if size and size[0] > 0 and size[1] > 0:
                    return size[0], size[1], None, len(data)
                if len(more) < step or len(data) >= most:
                    return None, None, "not an image", len(data)
                step = min(4 * step, most - len(data))
    except OSError as e:
        return None, None, f"not to be read: {type(e).__name__}", 0


def _rows(where: fs.FileSystem, files: list[tuple[str, int, int]], most: int) -> Iterator[tuple]:
    for path, length, _ in files:
        width, height, error, read = head_size(where, path, most)
        yield path, length, width, height, error, read


@dataclass
class Share(InputPartition):
    files: list


class ImageHeaders(DataSource):
    """Options: path; most (bytes read of a file at most, 1 MiB); parts (partitions at most, 64)."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "path string, length long, width long, height long, error string, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.most, self.parts = options["path"], int(options.get("most", 1 << 20)), int(options.get("parts", 64))

    def partitions(self) -> list[Share]:
        files = _listed(self.root, IMAGE_SUFFIXES)[1]
        n = max(1, min(self.parts, len(files)))
        return [Share(files[k::n]) for k in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        where = _listed_fs(self.root)
        yield from _rows(where, partition.files, self.most)


def _listed_fs(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()


class _Stream(DataSourceStreamReader):
    """New files since the last batch, by time and path; a file that is written again comes again.  The driver lists, the
    tasks read."""

    def __init__(self, options):
        self.root, self.most, self.parts = options["path"], int(options.get("most", 1 << 20)), int(options.get("parts", 64))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.root, IMAGE_SUFFIXES)[1]
        return {"time": files[-1][2], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        begin, until = ((o["time"], o["path"]) for o in (start, end))
        files = [f for f in _listed(self.root, IMAGE_SUFFIXES)[1] if begin < (f[2], f[0]) <= until]
        n = max(1, min(self.parts, len(files)))
        return [Share(files[k::n]) for k in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        yield from _rows(_listed_fs(self.root), partition.files, self.most)

    def commit(self, end: dict) -> None:
        pass
