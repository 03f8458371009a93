"""Image tiles as a Spark data source that reads little of each archive: its directory, headers and small arrays, by seeks.

Folders are found by the driver, files by tasks: a folder ``<site>/<split>`` is dealt by file name to ``parts`` tasks, which list
it and open their own share.  Filters on ``split`` and ``site_id`` (equal to, or in a list) leave other folders unlisted.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tessera.schemas import IMAGE_TILES

SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")
FIELDS = [x.split()[0] for x in IMAGE_TILES.split(", ")]


def seekable(uri: str) -> bool:
    """Whether files under this place can be opened by Python workers, and read in parts."""
    return uri.split(":", 1)[0] in SCHEMES


def place(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before a path there in Spark's names)."""
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    found, path = fs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))
    return found, path, uri[: len(uri) - len(path)] if uri.endswith(path) else f"{scheme}://"


class Counted(io.RawIOBase):
    """A file that counts the bytes read of it."""

    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read(self, size: int = -1) -> bytes:
        out = self.file.read() if size is None or size < 0 else self.file.read(size)
        self.bytes += len(out)
        return out

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True


def opened(uri: str) -> Counted:
    system, path, _ = place(uri)
    return Counted(system.open_input_file(path))


def stored_shape(archive: zipfile.ZipFile, name: str) -> tuple[int, ...]:
    """An array's shape by its header; its values aren't inflated."""
    if f"{name}.npy" not in archive.namelist():
        raise KeyError(name)
    with archive.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]


def stored_array(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    """One array of an archive; the others aren't read."""
    if f"{name}.npy" not in archive.namelist():
        raise KeyError(name)
    with archive.open(f"{name}.npy") as f:
        return np.lib.format.read_array(f)


def tile_header(file) -> dict:
    """Size, reference system, geotransform and box of an image tile; raises where one can't be read."""
    with zipfile.ZipFile(file) as z:
        h, w = stored_shape(z, "RED")
        gt, srid = stored_array(z, "GEO_TRANSFORM").ravel().astype(float), int(np.ravel(stored_array(z, "SRID"))[0])
    row = {"w": int(w), "h": int(h), "srid": srid, "geo_transform": gt.tolist()}
    return row | {k: float(v) for k, v in (("xmin", gt[2]), ("ymax", gt[5]), ("xmax", gt[2] + w * gt[0]), ("ymin", gt[5] + h * gt[4]))}


FAULTS = (KeyError, ValueError, OSError, IndexError, zipfile.BadZipFile, zlib.error)


def told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:200]


def site_of(folder: str) -> str:
    """The site id of a folder ``.../<site>/<split>``, by the rule of :func:`tessera.functions.names.site_id`."""
    return re.sub("^_+|_+$", "", re.sub("[^0-9A-Za-z]+", "_", folder.split("/")[-2]))


class Share(InputPartition):
    def __init__(self, folder: str, part: int, parts: int):
        self.folder, self.part, self.parts = folder, part, parts


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.splits = options["path"], options.get("splits", "train,val").split(",")
        self.parts = int(options.get("parts", 8))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if name in ("split", "site_id"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            yield f  # Spark looks at the rows again; here they only spare listings

    def folders(self) -> list[str]:
        system, path, _ = place(self.root)
        splits = [s for s in self.splits if s in self.wanted.get("split", self.splits)]
        found, todo = [], [path.rstrip("/")]
        while todo:
            for x in system.get_file_info(fs.FileSelector(todo.pop())):
                if x.type != fs.FileType.Directory:
                    continue
                if x.base_name in splits:
                    if site_of(x.path) in self.wanted.get("site_id", {site_of(x.path)}):
                        found.append(x.path)
                elif x.base_name not in self.splits:
                    todo.append(x.path)
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        return [Share(f, i, self.parts) for f in self.folders() for i in range(self.parts)]

    def read(self, partition: Share) -> Iterator[tuple]:
        if partition is None:  # there is no folder
            return
        system, _, before = place(self.root)
        for x in system.get_file_info(fs.FileSelector(partition.folder)):
            name = x.base_name
            if x.type != fs.FileType.File or not name.endswith(".npz") or zlib.crc32(name.encode()) % partition.parts != partition.part:
                continue
            row = dict.fromkeys(FIELDS) | {"site_id": site_of(partition.folder), "tile": name.removesuffix(".npz"), "split": posixpath.basename(partition.folder), "path": before + x.path}
            file = Counted(system.open_input_file(x.path))
            try:
                row |= tile_header(file)
            except FAULTS as e:
                row["problem"] = told(e)
            yield (*row.values(), file.bytes)


class TileSource(DataSource):
    """``spark.read.format("npz_tiles").load(root)``; options: ``splits`` (names, by commas), ``parts`` (tasks a folder)."""

    @classmethod
    def name(cls) -> str:
        return "npz_tiles"

    def schema(self) -> str:
        return f"{IMAGE_TILES}, bytes_read bigint"

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)
