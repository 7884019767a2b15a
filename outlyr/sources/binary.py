"""Spark data sources for binary maps (CCP4 and MRC) and reflection files (MTZ).

    binary.register(spark)
    spark.read.format("ccp4").option("path", "…/a/x.ccp4").load()                       # path, u, v, w, value
    spark.read.format("mtz").option("path", "…/a/x.mtz").option("columns", "H,K,L,FWT,PHWT").load()

A file is read in partitions that are planned from its header: sections of a map, ranges of reflections. Each partition seeks
to its own part, so no task reads a whole file. Options: ``path`` (one or several, by commas, local or of any file system that Arrow opens),
``dtag`` (one for each path; by default the name of the file's folder), ``rows`` (values of a partition, about a million), and
* for maps ``box``, six numbers u0, v0, w0, u1, v1, w1 of grid indices, ends included: only the sections and rows that it cuts are read;
* for reflections ``columns``: only these are decoded and returned.
Grid indices are those of the cell's axes: a file's own order of axes, and where its box begins, are undone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes and numpy kinds of a map's values, by its mode.
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}
ROWS = 1_000_000


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, at = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return system.open_input_file(at)


@dataclass
class MapHeader:
    """What is needed of the 1024 bytes at a map's begin."""

    order: str
    counts: tuple[int, int, int]
    kind: str
    starts: tuple[int, int, int]
    sampling: tuple[int, int, int]
    cell: tuple[float, ...]
    axes: tuple[int, int, int]
    data: int

    @staticmethod
    def parse(head: bytes) -> MapHeader:
        for order in "<>":
            words = struct.unpack(order + "256i", head)
            if words[3] in MODES and sorted(words[16:19]) == [1, 2, 3]:
                cell = struct.unpack(order + "6f", head[40:64])
                return MapHeader(order, words[0:3], order + MODES[words[3]], words[4:7], words[7:10], cell, words[16:19], 1024 + words[23])
        raise ValueError("no map of mode 0, 1, 2 or 6 with a permutation of axes")


@dataclass
class TableHeader:
    """What is needed of the records at the end of a reflection file."""

    order: str
    labels: list[str]
    rows: int
    cell: tuple[float, ...]

    @staticmethod
    def parse(head: bytes, tail: bytes, order: str) -> TableHeader:
        labels, rows, cell = [], 0, ()
        for k in range(0, len(tail) - 79, 80):
            own = tail[k : k + 80].decode("latin-1").split()
            if not own:
                continue
            if own[0] == "NCOL":
                rows = int(own[2])
            elif own[0] == "CELL":
                cell = tuple(map(float, own[1:7]))
            elif own[0] == "COLUMN":
                labels.append(own[1])
            elif own[0] == "END":
                break
        if not labels:
            raise ValueError("a reflection file without columns")
        return TableHeader(order, labels, rows, cell)


def map_header(path: str) -> MapHeader:
    with _open(path) as f:
        return MapHeader.parse(f.read(1024))


def table_header(path: str) -> TableHeader:
    with _open(path) as f:
        head = f.read(20)
        if head[:4] != b"MTZ ":
            raise ValueError(f"{path} is no reflection file")
        # the first digit of the machine stamp: 4 is little-endian
        order = "<" if head[8] >> 4 == 4 else ">"
        at = struct.unpack(order + "i", head[4:8])[0]
        if at == -1:
            at = struct.unpack(order + "q", head[12:20])[0]
        f.seek(4 * (at - 1))
        return TableHeader.parse(head, f.read(), order)


@dataclass
class Part(InputPartition):
    path: str
    dtag: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        if not self.paths:
            raise ValueError("option path is missing")
        names = [d.strip() for d in options.get("dtag", "").split(",") if d.strip()]
        self.dtags = names or [p.rstrip("/").split("/")[-2] if "/" in p.rstrip("/") else p for p in self.paths]
        if len(self.dtags) != len(self.paths):
            raise ValueError("as many dtags as paths are needed")
        self.rows = int(options.get("rows", ROWS))

    def _parts(self, path: str, dtag: str, begin: int, end: int, each: int) -> list[Part]:
        step = max(self.rows // max(each, 1), 1)
        return [Part(path, dtag, k, min(k + step, end)) for k in range(begin, end, step)]


class MapReader(_Reader):
    """Blocks of a map's sections."""

    def __init__(self, options):
        super().__init__(options)
        box = [int(x) for x in options.get("box", "").split(",") if x.strip()]
        if len(box) not in (0, 6):
            raise ValueError("a box has six numbers")
        self.box = (box[:3], box[3:]) if box else None

    def _range(self, head: MapHeader, k: int) -> tuple[int, int]:
        """Of the file's k-th axis (0 is the fastest) the positions that the box cuts, end excluded."""
        n, start = head.counts[k], head.starts[k]
        if self.box is None:
            return 0, n
        axis = head.axes[k] - 1
        return max(self.box[0][axis] - start, 0), min(self.box[1][axis] - start + 1, n)

    def partitions(self) -> list[Part]:
        out = []
        for path, dtag in zip(self.paths, self.dtags, strict=True):
            head = map_header(path)
            first, last = self._range(head, 2)
            rows, columns = self._range(head, 1), self._range(head, 0)
            if min(rows[1] - rows[0], columns[1] - columns[0]) > 0:
                out += self._parts(path, dtag, first, last, (rows[1] - rows[0]) * (columns[1] - columns[0]))
        return out or [Part(self.paths[0], self.dtags[0], 0, 0)]

    def read(self, partition: Part) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if partition.begin >= partition.end:
            return
        with _open(partition.path) as f:
            head = MapHeader.parse(f.read(1024))
            columns, rows, _ = head.counts
            (c0, c1), (r0, r1) = self._range(head, 0), self._range(head, 1)
            kind = np.dtype(head.kind)
            for s in range(partition.begin, partition.end):
                f.seek(head.data + (s * rows + r0) * columns * kind.itemsize)
                values = np.frombuffer(f.read((r1 - r0) * columns * kind.itemsize), kind).reshape(r1 - r0, columns)[:, c0:c1]
                places = {head.axes[2]: np.full(values.size, s + head.starts[2]), head.axes[1]: np.repeat(np.arange(r0, r1) + head.starts[1], c1 - c0), head.axes[0]: np.tile(np.arange(c0, c1) + head.starts[0], r1 - r0)}
                arrays = [pa.array([partition.dtag] * values.size), *(pa.array(places[k].astype(np.int32)) for k in (1, 2, 3)), pa.array(values.ravel().astype(np.float64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["dtag", "u", "v", "w", "value"])


class TableReader(_Reader):
    """Ranges of a file's reflections."""

    def partitions(self) -> list[Part]:
        out = []
        for path, dtag in zip(self.paths, self.dtags, strict=True):
            head = table_header(path)
            out += self._parts(path, dtag, 0, head.rows, len(head.labels))
        return out or [Part(self.paths[0], self.dtags[0], 0, 0)]

    def read(self, partition: Part) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if partition.begin >= partition.end:
            return
        head = table_header(partition.path)
        with _open(partition.path) as f:
            f.seek(80 + 4 * partition.begin * len(head.labels))
            data = np.frombuffer(f.read(4 * (partition.end - partition.begin) * len(head.labels)), head.order + "f4").reshape(-1, len(head.labels))
        wanted = chosen(self.options, head)
        arrays = [pa.array([partition.dtag] * len(data))]
        for c in wanted:
            values = data[:, head.labels.index(c)]
            arrays.append(pa.array(values.astype(np.int32)) if c in ("H", "K", "L") else pa.array(values.astype(np.float64), mask=np.isnan(values)))
        yield pa.RecordBatch.from_arrays(arrays, names=["dtag", *wanted])


def chosen(options, head: TableHeader) -> list[str]:
    """The columns that are asked for, all by default."""
    names = [c.strip() for c in options.get("columns", "").split(",") if c.strip()] or head.labels
    missing = [c for c in names if c not in head.labels]
    if missing:
        raise ValueError(f"no columns {missing} among {head.labels}")
    return names


class MapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ccp4"

    def schema(self) -> str:
        return "dtag string, u int, v int, w int, value double"

    def reader(self, schema) -> MapReader:
        return MapReader(self.options)


class TableSource(DataSource):
    """The columns are those of the first file; H, K, L are integers, a missing number is null."""

    @classmethod
    def name(cls) -> str:
        return "mtz"

    def schema(self) -> str:
        path = TableReader(self.options).paths[0]
        return ", ".join(["dtag string", *(f"`{c}` {'int' if c in ('H', 'K', 'L') else 'double'}" for c in chosen(self.options, table_header(path)))])

    def reader(self, schema) -> TableReader:
        return TableReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats ``ccp4`` and ``mtz`` known to a session."""
    spark.dataSource.register(MapSource)
    spark.dataSource.register(TableSource)


def reflections(spark: SparkSession, path: str, pairs: tuple[tuple[str, str], ...], **options: str):
    """(dtag, h, k, l, f, phi) of reflection files by the first of ``pairs`` of labels that the first file has; nothing else is decoded."""
    register(spark)
    labels = table_header(path.split(",")[0].strip()).labels
    f, phi = next(((a, b) for a, b in pairs if a in labels and b in labels), (None, None))
    if f is None:
        raise ValueError(f"no known pair of labels among {labels}")
    found = spark.read.format("mtz").options(**options).option("path", path).option("columns", f"H,K,L,{f},{phi}").load()
    return found.toDF("dtag", "h", "k", "l", "f", "phi")


def volume_amplitudes(spark: SparkSession, path: str, **options: str):
    """(dtag, h, k, l, f, phi) of a volume: it is read in blocks of sections and transformed axis by axis."""
    from outlyr.operators.fourier import amplitudes_from_grid

    register(spark)
    head = map_header(path)
    a, b, c = head.cell[:3]
    grid = spark.read.format("ccp4").options(**options).option("path", path).load()
    return amplitudes_from_grid(grid, ["dtag"], head.sampling, a * b * c)
