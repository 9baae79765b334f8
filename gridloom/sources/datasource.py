"""Image files as Spark data sources: ``ppm``, ``png`` and ``bmp``.

``spark.read.format("ppm").load(path)`` gives planes; small files share a
partition. With the option ``tile`` a PPM file gives tiles instead, a partition for
each line of tiles, which reads only its own lines of the file: no row and no
task has a whole plane. Lines of small files share a partition too. ``write`` takes interleaved images; tasks write into a
folder of their own, a job's commit moves the files to their names, and
its abort leaves nothing. Paths are local ones or URIs that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .images import decode, encode, fitted

#: Partitions that small files are dealt over at least, and the most files and bytes that share one.
SPREAD, TOGETHER, TOGETHER_BYTES = 64, 256, 16 << 20
#: Samples of a batch that a reader gives at most, unless one row has more.
BATCH_SAMPLES = 1 << 18

PLANES = "image_id string, c int, w int, h int, v array<double>"
TILES = "image_id string, c int, ty int, tx int, w int, h int, v array<double>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)  # as Spark writes local paths
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(store: fs.FileSystem, name: str) -> tuple[int, int, int]:
    """Width, height and where samples start of a binary PPM of 8 bits."""
    with store.open_input_file(name) as f:
        found = re.match(rb"P6(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+255\s", f.read(1 << 16))
        if not found or not int(found[1]) or not int(found[2]):
            raise ValueError(f"{name} is no 8-bit P6 file")
        w, h, start = int(found[1]), int(found[2]), found.end()
        if f.size() < start + 3 * w * h:
            raise ValueError(f"{name} ends early")
    return w, h, start


def together(sizes: list[int]) -> list[range]:
    """Runs of files of these sizes that share a partition: as many as their number and bytes allow."""
    most = max(1, min(TOGETHER, len(sizes) // SPREAD))
    out, start, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and (k - start == most or held + n > TOGETHER_BYTES):
            out.append(range(start, k))
            start, held = k, 0
        held += n
    return [*out, range(start, len(sizes))] if sizes else []


def batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with samples ``v`` as batches of up to ``BATCH_SAMPLES``."""
    held: list[dict] = []
    n = 0
    for r in rows:
        if held and n + len(r["v"]) > BATCH_SAMPLES:
            yield pa.RecordBatch.from_pydict({f.name: pa.array([x[f.name] for x in held], f.type) for f in schema})
            held, n = [], 0
        held.append(r)
        n += len(r["v"])
    if held:
        yield pa.RecordBatch.from_pydict({f.name: pa.array([x[f.name] for x in held], f.type) for f in schema})


@dataclass
class Files(InputPartition):
    """Whole files, or with ``line`` a line of tiles of one file."""

    names: list[str]
    line: int | None = None
    size: tuple[int, int, int] | None = None


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and the names of its files there."""

    folder: str
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, form: str, options: dict):
        self.form, self.path = form, options["path"]
        self.glob, self.side = options.get("pathGlobFilter", f"*.{form}"), options.get("side")
        self.tile = int(options["tile"]) if "tile" in options else None

    def partitions(self) -> list[Files]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and fnmatch.fnmatch(x.base_name, self.glob) and not x.base_name.startswith((".", "_"))]
        found = sorted(found, key=lambda x: x.path)
        out = []
        if self.tile is not None:
            few = len(found) < SPREAD
            for x in found:
                if few or x.size > TOGETHER_BYTES:  # of many small ones a task takes all lines
                    size = header(store, x.path)
                    out += [Files([x.path], line, size) for line in range(-(-size[1] // self.tile))]
            found = [] if few else [x for x in found if x.size <= TOGETHER_BYTES]
        out += [Files([found[k].path for k in part]) for part in together([x.size for x in found])]
        return out or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        kinds = {"image_id": pa.string(), "v": pa.list_(pa.float64())}
        names = [f.split()[0] for f in (PLANES if self.tile is None else TILES).split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.int32())) for n in names])
        rows = self._planes if self.tile is None else self._tiles
        yield from batches((r for name in part.names for r in rows(store, name, part)), schema)

    def _planes(self, store: fs.FileSystem, name: str, part: Files) -> Iterator[dict]:
        with store.open_input_file(name) as f:
            image = decode(f.read())
        image = image if self.side is None else fitted(image, int(self.side))
        h, w, n = image.shape
        for c in range(n):
            yield {"image_id": name, "c": c, "w": w, "h": h, "v": image[:, :, c].reshape(-1).astype(float)}

    def _tiles(self, store: fs.FileSystem, name: str, part: Files) -> Iterator[dict]:
        w, h, start = part.size or header(store, name)
        with store.open_input_file(name) as f:
            for line in range(-(-h // self.tile)) if part.line is None else [part.line]:
                first = line * self.tile
                lines = min(self.tile, h - first)
                f.seek(start + 3 * w * first)
                band = np.frombuffer(f.read(3 * w * lines), np.uint8).reshape(lines, w, 3)
                for c in range(3):
                    for tx, x in enumerate(range(0, w, self.tile)):
                        yield {"image_id": name, "c": c, "ty": line, "tx": tx, "w": w, "h": h, "v": band[:, x : x + self.tile, c].reshape(-1).astype(float)}


class Writer(DataSourceWriter):
    def __init__(self, form: str, options: dict, overwrite: bool):
        self.form, self.path, self.overwrite = form, options["path"], overwrite
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, path = _opened(self.path)
        folder = posixpath.join(path, self.job, uuid.uuid4().hex)
        names: list[str] = []
        for r in rows:
            samples = np.array(r["px"])
            if samples.size and (samples.min() < 0 or samples.max() > 255):
                raise ValueError(f"{r['image_id']} has samples that are no bytes")
            if not names:
                store.create_dir(folder, recursive=True)
            name = f"{posixpath.splitext(posixpath.basename(str(r['image_id'])))[0]}.{self.form}"
            with store.open_output_stream(posixpath.join(folder, name)) as f:
                f.write(encode(samples.astype(np.uint8).reshape(r["h"], r["w"], -1), self.form))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _opened(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(path)):
                if x.is_file and x.base_name.endswith(f".{self.form}"):
                    store.delete_file(x.path)
        for m in messages:
            for name in m.names if m else []:
                store.move(posixpath.join(m.folder, name), posixpath.join(path, name))
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        folder = posixpath.join(path, self.job)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class _Images(DataSource):
    form = ""

    @classmethod
    def name(cls) -> str:
        return cls.form

    def schema(self) -> str:
        return TILES if "tile" in self.options else PLANES

    def reader(self, schema: StructType) -> Reader:
        if "tile" in self.options and self.form != "ppm":
            raise ValueError("only PPM files are read by tiles")
        return Reader(self.form, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.form, dict(self.options), overwrite)


class Ppm(_Images):
    form = "ppm"


class Png(_Images):
    form = "png"


class Bmp(_Images):
    form = "bmp"


def register(spark: SparkSession) -> None:
    """Makes ``ppm``, ``png`` and ``bmp`` known to the session as formats."""
    for source in (Ppm, Png, Bmp):
        spark.dataSource.register(source)
