"""Parquet footers: a model of row groups and column chunks, the strict validator, and answers from statistics."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import ship

# The physical types and codecs that strict mode reads.
PHYSICAL = {"BOOLEAN": 1, "INT32": 4, "INT64": 8, "FLOAT": 4, "DOUBLE": 8, "BYTE_ARRAY": 0}
CODECS = {"UNCOMPRESSED", "SNAPPY"}
#: Stores that pyarrow opens on an executor, by the schemes that Spark knows them by; other stores' footers are read by the driver.
ARROW_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3a": "s3", "s3": "s3", "gs": "gs", "abfss": "abfss"}
#: Up to so many footers are read by the driver itself, as a job for them would take longer.
DRIVER_FILES = 4
#: A row for each column chunk, and one with a null row_group for a file without row groups.
CHUNKS = "file string, row_group int, place int, column string, physical_type string, logical_type string, codec string, num_rows long, compressed_bytes long, null_count long, min_value string, max_value string, min_int long, max_int long"
RANGES = {"tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1), "utinyint": (0, 2**8 - 1), "usmallint": (0, 2**16 - 1), "uint": (0, 2**32 - 1)}


class ScanError(ValueError):
    """A file that strict mode refuses."""


@dataclass(frozen=True)
class Chunk:
    group: int
    column: str
    physical: str
    logical: str
    codec: str
    rows: int
    compressed: int
    offset: int
    required: bool
    low: object
    high: object
    nulls: int | None


@dataclass(frozen=True)
class Footer:
    path: str
    columns: tuple[str, ...]
    group_rows: tuple[int, ...]
    chunks: tuple[Chunk, ...]


class _HadoopTail(io.RawIOBase):
    """A seekable view of a file in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._size = fs.getFileStatus(self._path).getLen()
        self._stream, self._at, self._jvm = fs.open(self._path), 0, spark._jvm

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self._size)[whence]
        return self._at

    def readinto(self, into) -> int:  # noqa: ANN001
        n = min(len(into), self._size - self._at)
        if n <= 0:
            return 0
        self._stream.seek(self._at)
        data = self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, n)
        into[:n] = data
        self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files that a scan of the path reads, as Spark lists them: nested and partitioned folders included, sorted."""
    try:
        found = spark.read.parquet(path).inputFiles()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"IO Error: no such file: {path}") from e
        raise
    return sorted(unquote(f) for f in found)


def _read(path: str, file) -> Footer:  # noqa: ANN001
    meta = pq.ParquetFile(file).metadata
    leaves = [meta.schema.column(i) for i in range(len(meta.schema))]
    chunks = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for i in range(group.num_columns):
            c, leaf = group.column(i), leaves[i]
            s = c.statistics if c.is_stats_set else None
            known = s is not None and s.has_min_max
            nulls = s.null_count if s is not None and s.has_null_count else None
            offset = c.data_page_offset if c.dictionary_page_offset is None else min(c.dictionary_page_offset, c.data_page_offset)
            low, high = (s.min, s.max) if known else (None, None)
            chunks.append(Chunk(g, leaf.path, c.physical_type, str(leaf.logical_type), c.compression, group.num_rows, c.total_compressed_size, offset, leaf.max_definition_level == 0, low, high, nulls))
    rows = tuple(meta.row_group(g).num_rows for g in range(meta.num_row_groups))
    return Footer(path, tuple(leaf.path for leaf in leaves), rows, tuple(chunks))


def read_footer(spark: SparkSession, path: str) -> Footer:
    """The footer of one file, read by the driver; nothing but its last bytes is read."""
    with io.BufferedReader(_HadoopTail(spark, path), 1 << 16) as f:
        return _read(path, f)


def _rows(footer: Footer) -> list[tuple]:
    if not footer.chunks:
        return [(footer.path, *[None] * 13)]
    width, out = len(footer.columns), []
    for i, c in enumerate(footer.chunks):
        whole = isinstance(c.low, int) and not isinstance(c.low, bool) and isinstance(c.high, int)
        text = [None if v is None else str(v) for v in (c.low, c.high)]
        out.append((footer.path, c.group, i % width, c.column, c.physical, c.logical, c.codec, c.rows, c.compressed, c.nulls, *text, c.low if whole else None, c.high if whole else None))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in CHUNKS.split(", "))])
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column chunk of the files of a path; the footers are read by tasks, where more than a few."""
    files = data_files(spark, path)
    schemes = {urlsplit(f).scheme or "file" for f in files}
    if len(files) <= DRIVER_FILES or not schemes <= set(ARROW_SCHEMES):
        return spark.createDataFrame(_table([r for f in files for r in _rows(read_footer(spark, f))]))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for file in b.column("file").to_pylist():
                scheme = urlsplit(file).scheme or "file"
                rest = file.split(":", 1)[1] if ":" in file else file
                if scheme == "file":
                    store, at = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    store, at = fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}:{rest}")
                with store.open_input_file(at) as f:
                    rows = _rows(_read(file, f))
                yield from _table(rows).to_batches()

    width = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(width).mapInArrow(run, CHUNKS)


def validate(spark: SparkSession, path: str) -> None:
    """Strict mode: every chunk, projected or not, is of a known physical type and codec, and every file has a row group."""
    known = F.col("physical_type").isin(*PHYSICAL) & F.col("codec").isin(*CODECS)
    bad = chunk_table(spark, path).where(F.col("row_group").isNull() | ~known).orderBy("file", "row_group", "place").first()
    if bad is None:
        return
    if bad["row_group"] is None:
        raise ScanError(f"Parquet file contains no row groups: {bad['file']}")
    if bad["physical_type"] not in PHYSICAL:
        raise ScanError(f"Parquet physical type {bad['physical_type']} of column {bad['column']} is not supported in strict mode")
    raise ScanError(f"Parquet compression codec {bad['codec']} of column {bad['column']} is not supported in strict mode")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the footers alone."""
    return chunk_table(spark, path).where("place = 0").agg(F.sum("num_rows")).first()[0] or 0


def proves(spark: SparkSession, path: str, column: str, kind: str) -> bool:
    """Whether the statistics of every file prove that all values of an integer column are within `kind`.

    Chunks of nulls alone say nothing; without any chunk of values nothing is proven.
    """
    low, high = RANGES[kind]
    valued = chunk_table(spark, path).where((F.col("column") == column) & (F.col("num_rows") > 0) & ~F.col("null_count").eqNullSafe(F.col("num_rows")))
    fits = F.coalesce((F.col("min_int") >= low) & (F.col("max_int") <= high), F.lit(False))
    return bool(valued.agg(F.every(fits)).first()[0])


def rowgroup_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk of the files of a path."""
    return chunk_table(spark, path).where("row_group is not null").drop("place", "logical_type", "min_int", "max_int")


def footer_agg(spark: SparkSession, path: str, column: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """n_rows, min_value and max_value of an integer column with low <= column <= high, from statistics where they decide.

    Row groups wholly within the bounds are answered by the footer and groups wholly outside are dropped; only
    files with a group that the statistics leave open are scanned, with the filter pushed to their groups.
    """
    bounds = [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)

    def scanned(df: DataFrame) -> DataFrame:
        kept = df.where(reduce(lambda a, b: a & b, bounds, F.col(column).isNotNull()))
        return kept.agg(F.count("*").alias("n_rows"), F.min(column).cast("long").alias("min_value"), F.max(column).cast("long").alias("max_value"))

    untold = F.col("min_int").isNull() | F.col("max_int").isNull() | F.col("null_count").isNull()
    above = F.lit(True) if low is None else F.col("min_int") >= low
    below = F.lit(True) if high is None else F.col("max_int") <= high
    apart = (F.lit(False) if low is None else F.col("max_int") < low) | (F.lit(False) if high is None else F.col("min_int") > high)
    # A chunk of nulls alone has no bounds and adds nothing.
    empty = (F.col("num_rows") == 0) | F.col("null_count").eqNullSafe(F.col("num_rows"))
    state = F.when(empty, "out").when(untold, "open").when(apart, "out").when(above & below, "in").otherwise("open")
    files = chunk_table(spark, path).where(F.col("column") == column).withColumn("state", state).groupBy("file").agg(
        F.bool_or(F.col("state") == "open").alias("open"),
        F.sum(F.expr("if(state = 'in', num_rows - null_count, 0)")).alias("n_rows"),
        F.min(F.expr("if(state = 'in', min_int, null)")).alias("min_value"),
        F.max(F.expr("if(state = 'in', max_int, null)")).alias("max_value"),
    )
    # What is collected are names of files, as the planner holds them for any scan.
    told = files.agg(
        F.count("*").alias("files"),
        F.collect_list(F.expr("if(open, file, null)")).alias("open"),
        F.coalesce(F.sum(F.expr("if(open, 0, n_rows)")), F.lit(0)).alias("n_rows"),
        F.min(F.expr("if(open, null, min_value)")).alias("min_value"),
        F.max(F.expr("if(open, null, max_value)")).alias("max_value"),
    ).first()
    if not told["files"]:
        return scanned(spark.read.parquet(path))  # a column that stands in the folders' names alone
    answered = spark.createDataFrame([(told["n_rows"], told["min_value"], told["max_value"])], "n_rows long, min_value long, max_value long")
    if not told["open"]:
        return answered
    both = answered.unionByName(scanned(spark.read.parquet(*told["open"])))
    return both.agg(F.sum("n_rows").alias("n_rows"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))
