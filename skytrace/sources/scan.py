"""Scans: file manifest, chunked I/Q, .npy and text matrices, sidecars, training sets; framing and power spectra."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytrace.functions import file_kind
from skytrace.operators.order import numbered

EPS = 2.220446049250313e-16
SLICES = "capture_id string, t_idx long, time_s double, power_db array<double>"
#: Frames in one task's chunk; rows of an Arrow batch are kept near it, as a slice is about 8 KB.
FRAMES_PER_CHUNK = 1024
SIDECAR = (
    "satellite_name string, frequency_hz long, sample_rate long, gain double, output_filename string, recording_status string, norad_id long, "
    "scheduled_aos timestamp, scheduled_los timestamp, actual_recording_start timestamp, actual_recording_stop timestamp, pre_buffer_seconds double, "
    "post_buffer_seconds double, recording_duration_seconds double, output_file_size long, expected_file_size long, error_message string, simulated boolean, "
    "device_index int, command array<string>, creation_timestamp timestamp, _corrupt_record string"
)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file: path, file_name, stem, kind, length. Contents aren't read; unknown suffixes have kind 'rejected'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), file_kind(F.col("path")).alias("kind"), "length", "modificationTime")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars as rows; times without a zone are UTC, whatever the session's zone."""
    return spark.read.schema(SIDECAR).option("multiLine", True).option("timeZone", "UTC").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def training_set(spark: SparkSession, path: str) -> DataFrame:
    """As strings, so that validation sees bad cells."""
    return spark.read.csv(path, header=True, inferSchema=False)


def npy_header(raw: bytes) -> tuple[np.dtype, tuple[int, ...], int, bool]:
    """(type, shape, offset of the data, column order) from the first bytes of a .npy file."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    wide = raw[6] >= 2
    size = int.from_bytes(raw[8 : 12 if wide else 10], "little")
    start = 12 if wide else 10
    head = ast.literal_eval(raw[start : start + size].decode("latin-1"))
    return np.dtype(head["descr"]), head["shape"], start + size, head["fortran_order"]


def open_file(path: str):
    """Bytes of a local file or, elsewhere, of whatever file system pyarrow knows by the URI."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    return store.open_input_file(where)


def decode(raw: bytes, kind: str) -> np.ndarray:
    """Bytes to complex samples. cu8: unsigned 8-bit pairs about 127.5; else a NumPy type by name."""
    if kind == "cu8":
        x = (np.frombuffer(raw[: len(raw) // 2 * 2], np.uint8).astype(np.float64) - 127.5) / 127.5
        return x[0::2] + 1j * x[1::2]
    return np.frombuffer(raw, np.dtype(kind))


def sample_bytes(kind: str) -> int:
    return 2 if kind == "cu8" else np.dtype(kind).itemsize


def power_db(samples: np.ndarray, fs: float, nperseg: int, noverlap: int) -> np.ndarray:
    """Two-sided power density in dB of each frame (periodic Hann window, no detrending), by rising frequency."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    if len(samples) < nperseg:
        return np.empty((0, nperseg))
    frames = np.lib.stride_tricks.sliding_window_view(samples, nperseg)[:: nperseg - noverlap]
    p = np.abs(np.fft.fft(frames * w, axis=1)) ** 2 / (fs * (w**2).sum())
    return 10 * np.log10(np.fft.fftshift(p, axes=1) + EPS)


def frame_count(n: int, nperseg: int, noverlap: int) -> int:
    return max(0, (n - noverlap) // (nperseg - noverlap))


def chunks(files: DataFrame, nperseg: int = 1024, noverlap: int = 512, frames: int = FRAMES_PER_CHUNK) -> DataFrame:
    """(path, capture_id, fmt, offset, n) to one row per chunk of whole frames; a frame never spans two chunks."""
    total = F.floor((F.col("n") - noverlap) / (nperseg - noverlap))
    starts = F.sequence(F.lit(0).cast("long"), total - 1, F.lit(frames).cast("long"))
    return files.filter(total > 0).withColumn("lo", F.explode(starts)).withColumn("hi", F.least(F.col("lo") + frames, total))


def read_frames(path: str, fmt: str, offset: int, lo: int, hi: int, fs: float, nperseg: int, noverlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice numbers, power in dB) of frames lo to hi of a file; only their bytes are read."""
    hop, width = nperseg - noverlap, sample_bytes(fmt)
    with open_file(path) as f:
        f.seek(int(offset + lo * hop * width))
        raw = f.read(int(((hi - lo - 1) * hop + nperseg) * width))
    db = power_db(decode(raw, fmt), fs, nperseg, noverlap)
    return np.arange(lo, lo + len(db)), db


def iq_slices(files: DataFrame, fs: float, nperseg: int = 1024, noverlap: int = 512, frames: int = FRAMES_PER_CHUNK) -> DataFrame:
    """Files (path, capture_id, fmt, offset, length) to slices. Each task reads its own byte ranges, with a halo of ``noverlap`` samples."""
    size = F.when(F.col("fmt") == "cu8", 2).when(F.col("fmt") == "complex128", 16).otherwise(8)
    parts = chunks(files.withColumn("n", F.floor((F.col("length") - F.col("offset")) / size)), nperseg, noverlap, frames)
    parts = parts.select("path", "capture_id", "fmt", "offset", "lo", "hi")
    hop = nperseg - noverlap

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                t, db = read_frames(r.path, r.fmt, r.offset, r.lo, r.hi, fs, nperseg, noverlap)
                yield pd.DataFrame({"capture_id": r.capture_id, "t_idx": t, "time_s": (t * hop + nperseg / 2) / fs, "power_db": list(db)})

    return parts.repartition("path", "lo").mapInPandas(read, SLICES)


def npy_files(files: DataFrame) -> DataFrame:
    """Adds fmt, offset, rows, cols, by_column (Fortran order) and verdict (iq, spectrogram or rejected) from the headers of .npy files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    with open_file(path) as f:
                        kind, shape, offset, columns = npy_header(f.read(4096))
                    compl, rank = kind.kind == "c", len(shape)
                    verdict = "iq" if rank == 1 else "spectrogram" if rank == 2 and not compl else "rejected"
                    out.append((kind.name, offset, shape[0] if shape else 0, shape[1] if rank == 2 else 1, bool(columns) and rank == 2, verdict))
                except (ValueError, SyntaxError, IndexError, TypeError):
                    out.append((None, 0, 0, 0, False, "rejected"))
            head = pd.DataFrame(out, columns=["fmt", "offset", "rows", "cols", "by_column", "verdict"])
            yield pd.concat([batch.reset_index(drop=True), head], axis=1)

    schema = T.StructType([*files.schema.fields, *T.StructType.fromDDL("fmt string, offset long, rows long, cols long, by_column boolean, verdict string").fields])
    return files.mapInPandas(read, schema)


def npy_slices(files: DataFrame, rows_per_chunk: int = 4096) -> DataFrame:
    """2-D real .npy files (path, capture_id, fmt, offset, rows, cols, by_column) to slices, by ranges of rows; by column, a range is read from each column."""
    parts = files.filter("rows > 0").withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(rows_per_chunk).cast("long"))))
    parts = parts.withColumn("hi", F.least(F.col("lo") + rows_per_chunk, F.col("rows"))).select("path", "capture_id", "fmt", "offset", "rows", "cols", "by_column", "lo", "hi")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                kind = np.dtype(r.fmt)
                with open_file(r.path) as f:
                    if r.by_column:
                        ranges = []
                        for c in range(int(r.cols)):
                            f.seek(int(r.offset + (c * r.rows + r.lo) * kind.itemsize))
                            ranges.append(np.frombuffer(f.read(int((r.hi - r.lo) * kind.itemsize)), kind))
                        m = np.stack(ranges, axis=1).astype(float)
                    else:
                        f.seek(int(r.offset + r.lo * r.cols * kind.itemsize))
                        m = np.frombuffer(f.read(int((r.hi - r.lo) * r.cols * kind.itemsize)), kind).reshape(-1, int(r.cols)).astype(float)
                t = np.arange(r.lo, r.lo + len(m))
                yield pd.DataFrame({"capture_id": r.capture_id, "t_idx": t, "time_s": t.astype(float), "power_db": list(m)})

    return parts.repartition("path", "lo").mapInPandas(read, SLICES)


def text_matrices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(slices, rejected files) of .csv (commas) and .txt (blanks) matrices; ragged, non-numeric, one-row or one-column files are rejected.

    Files are read in Spark's byte ranges, so a large one is many tasks; rows are numbered within their range and moved on by the
    counts of the ranges before. What follows a # is a comment; lines without anything else are no rows. Spark lists no file of 0 bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cCtT][sSxX][vVtT]").load(folder).select(F.col("_metadata.file_path").alias("path"))
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cCtT][sSxX][vVtT]").text(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("from"), F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", r"#.*|[\r\ufeff]", "")).alias("line"))
    raw = raw.filter(F.trim(F.translate("line", "\t\x0b\x0c", "   ")) != "")
    cells = F.when(F.lower("path").endswith(".csv"), F.split("line", r"\s*,\s*")).otherwise(F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+"))
    number = lambda x: F.when(~x.rlike("[0-9.][dDfF]$"), F.trim(x).try_cast("double"))
    rows = numbered(raw.select("path", "from", "at", F.transform(cells, number).alias("power_db")), ["path"], F.col("from"), ["at"])
    size = F.size("power_db")
    good = (F.count(F.lit(1)) >= 2) & (F.min(size) >= 2) & (F.min(size) == F.max(size)) & F.every(F.forall("power_db", lambda x: x.isNotNull()))
    verdicts = rows.groupBy("path").agg(good.alias("good")).filter("good").select("path")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "").alias("capture_id")
    t = F.col("_n") - 1
    slices = rows.join(verdicts, "path").select(name, t.cast("long").alias("t_idx"), t.cast("double").alias("time_s"), "power_db")
    return slices, files.join(verdicts, "path", "left_anti").select("path", name)


def matrix_axis(sample_rate: float, center_hz: float, n_bins: int) -> tuple[float, float]:
    """(first frequency, step) of a matrix: both ends of the band are bins."""
    return center_hz - sample_rate / 2, sample_rate / max(n_bins - 1, 1)


def fft_axis(sample_rate: float, center_hz: float, nperseg: int) -> tuple[float, float]:
    """(first frequency, step) of a spectrum: the upper end isn't a bin."""
    return center_hz - sample_rate / 2, sample_rate / nperseg
