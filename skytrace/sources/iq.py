"""I/Q captures as a Spark data source: ``spark.read.format("iq")`` gives slices, a partition a chunk of frames.

Options: ``path`` (a file or folder), ``sample_rate``, ``nperseg`` and ``noverlap`` (1024, 512), ``format`` of headerless files
(complex64; cu8 for unsigned bytes) and ``frames`` of a chunk. ``.npy`` files tell their own format; those that aren't a
row of complex or real samples are passed over, as are other suffixes. Filters on ``capture_id`` (=, in) and ``t_idx``
(=, <, <=, >, >=) are pushed (with ``spark.sql.python.filterPushdown.enabled``): other captures aren't opened, and
of long ones only the chunks asked for are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from skytrace.functions import RAW_SUFFIXES

from .scan import FRAMES_PER_CHUNK, SLICES, frame_count, npy_header, open_file, read_frames, sample_bytes

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Slices of an Arrow batch: one of 1024 bins is 8 KB.
BATCH = 512


@dataclass
class Chunk(InputPartition):
    path: str
    capture_id: str
    fmt: str
    offset: int
    lo: int
    hi: int


def _as_uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


class IqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "iq"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema) -> DataSourceReader:
        return IqReader(dict(self.options))


class IqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rate = options["path"], float(options["sample_rate"])
        self.nperseg, self.noverlap = int(options.get("nperseg", 1024)), int(options.get("noverlap", 512))
        self.fmt, self.frames = options.get("format", "complex64"), int(options.get("frames", FRAMES_PER_CHUNK))
        self.captures: set | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what it can; gives back the rest, and any bound on slices, as a chunk holds slices beside it."""
        for f in filters:
            at = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if at == "capture_id" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.captures = own if self.captures is None else self.captures & own
                continue
            if at == "t_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if at == "t_idx" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = f.value + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)
            yield f

    def _files(self) -> Iterator[tuple[str, str, int]]:
        store, where = filesystems.FileSystem.from_uri(_as_uri(self.path))
        info = store.get_file_info(where)
        scheme = _as_uri(self.path).partition("://")[0]
        found = store.get_file_info(filesystems.FileSelector(where, recursive=True)) if info.type == filesystems.FileType.Directory else [info]
        for f in sorted(found, key=lambda f: f.path):
            if f.is_file and f.extension.lower() in (*RAW_SUFFIXES, "npy"):
                yield f"{scheme}://{f.path}", f.base_name, f.size

    def partitions(self) -> list[Chunk]:
        out = []
        for path, name, size in self._files():
            capture, fmt, offset = re.sub(r"\.[^.]*$", "", name), self.fmt, 0
            if self.captures is not None and capture not in self.captures:
                continue
            if name.lower().endswith(".npy"):
                try:
                    with open_file(path) as f:
                        kind, shape, offset, _ = npy_header(f.read(4096))
                except (ValueError, SyntaxError, IndexError, TypeError):
                    continue
                if len(shape) != 1:
                    continue
                fmt = kind.name
            total = frame_count((size - offset) // sample_bytes(fmt), self.nperseg, self.noverlap)
            first, end = self.low // self.frames * self.frames, total if self.high is None else min(total, self.high)
            out += [Chunk(path, capture, fmt, offset, lo, min(lo + self.frames, total)) for lo in range(first, end, self.frames)]
        return out or [Chunk("", "", self.fmt, 0, 0, 0)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        hop = self.nperseg - self.noverlap
        for lo in range(chunk.lo, chunk.hi, BATCH):
            t, db = read_frames(chunk.path, chunk.fmt, chunk.offset, lo, min(lo + BATCH, chunk.hi), self.rate, self.nperseg, self.noverlap)
            bins = pa.ListArray.from_arrays(pa.array(range(0, db.size + 1, self.nperseg), pa.int32()), pa.array(db.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([chunk.capture_id] * len(t)), pa.array(t, pa.int64()), pa.array((t * hop + self.nperseg / 2) / self.rate), bins], ["capture_id", "t_idx", "time_s", "power_db"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.dataSource.register(IqSource)
    spark.conf.set(PUSHDOWN, "true")
