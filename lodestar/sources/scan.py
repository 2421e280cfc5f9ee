"""The Parquet scan: schema from the footer, push-downs left to Catalyst, a strict mode that refuses at planning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.settings import Settings
from lodestar.sources import hosted
from lodestar.sources.footer import RANGES, proves, read_footer, row_count, validate

#: What a call may not be looked for in (a literal, a quoted name, a comment), or a call.
_TOKEN = re.compile(
    r"""'(?:[^'\\]|\\.|'')*' | "(?:[^"\\]|\\.|"")*" | `(?:[^`]|``)*` | --[^\n]* | /\*.*?\*/
    | \b(?P<scan>read_scan)\s*\(\s*'(?P<path>(?:[^']|'')*)'\s*\) | \b(?P<profile>scan_profile)\s*\(\s*\)""",
    re.I | re.S | re.X,
)
_SPARK_TYPE = {"utinyint": "smallint", "usmallint": "int", "uint": "bigint"}
#: Bytes of the integer types.
_WIDTH = {"tinyint": 1, "utinyint": 1, "smallint": 2, "usmallint": 2, "int": 4, "uint": 4, "bigint": 8}


def scan(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The rows of one path; `hosted://name` is looked up in the hosted folder.

    Projection, filters, casts and aggregates above it are pushed down by Catalyst. Strict mode reads the
    footers first and refuses unknown physical types and codecs of any column, read or not, and files
    without row groups. The rows are a multiset: no order is promised.
    """
    if path.startswith(hosted.SCHEME):
        path = hosted.resolve(spark, path)
    if strict:
        validate(spark, path)
    df = spark.read.parquet(path)
    streams = Settings(spark).get("scheduler_num_streams")
    # A set number of streams bounds the scan's tasks; filters and projections still reach the files below it.
    return df.coalesce(streams) if streams else df


def sql(spark: SparkSession, text: str, strict: bool = False) -> DataFrame:
    """SQL in which `read_scan('path')` is a table and `scan_profile()` the last scan's profile.

    A call becomes Spark's own file relation, so all push-downs hold, as they would not through a table function.
    Literals, quoted names and comments are left as they are.
    """
    streams = Settings(spark).get("scheduler_num_streams")

    def table(m: re.Match) -> str:
        if m["profile"]:
            from lodestar.plans.profile import scan_profile

            scan_profile(spark).createOrReplaceTempView("_scan_profile")
            return "_scan_profile"
        if not m["scan"]:
            return m[0]
        path = m["path"].replace("''", "'")
        if path.startswith(hosted.SCHEME):
            path = hosted.resolve(spark, path)
        if strict:
            validate(spark, path)
        relation = "parquet.`" + path.replace("`", "``") + "`"
        return f"(select /*+ coalesce({streams}) */ * from {relation})" if streams else relation

    return spark.sql(_TOKEN.sub(table, text))


def describe(df: DataFrame) -> DataFrame:
    """(column_name, column_type) of a query, as a relation."""
    return df.sparkSession.createDataFrame(df.dtypes or [], "column_name string, column_type string")


def narrow(spark: SparkSession, path: str, column: str, kind: str, settings: Settings | None = None) -> DataFrame:
    """The scan with an integer column cast to a narrower type, where the cast setting is on and every row group proves that it fits.

    Else the scan as it is: a type that isn't narrower, or a cast that isn't proven, is left to the query, where an
    overflow raises.
    """
    df = scan(spark, path)
    if kind not in RANGES:
        raise ValueError(f"unknown integer type {kind}")
    source = dict(df.dtypes)[column]
    if path.startswith(hosted.SCHEME):
        path = hosted.resolve(spark, path)
    wanted = (settings or Settings(spark)).get("cast_pushdown") and source in ("bigint", "int", "smallint") and _WIDTH[kind] < _WIDTH[source]
    if wanted and proves(spark, path, column, kind):
        return df.withColumn(column, F.col(column).cast(_SPARK_TYPE.get(kind, kind)))
    return df


def aggregating_scan(spark: SparkSession, path: str) -> DataFrame:
    """The scan for COUNT, MIN and MAX of whole columns, which Spark's second file reader answers from footers on the executors.

    It lives in a session of its own beside `spark`, as the settings for it would change every other scan's reader.
    """
    if path.startswith(hosted.SCHEME):
        path = hosted.resolve(spark, path)
    beside = spark.newSession()
    beside.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    beside.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return beside.read.parquet(path)


def cardinality(spark: SparkSession, path: str) -> int:
    """Rows by the footers alone."""
    return row_count(spark, path)


def write_table(df: DataFrame, path: str, codec: str = "snappy", rows_per_group: int | None = None, mode: str = "errorifexists") -> None:
    """Write Parquet with a codec and, if asked, row groups of exactly rows_per_group rows.

    Spark's first task writes a file even if it has no rows (of a scan's splits, only those that hold the middle of a
    row group have some). Strict mode refuses such a file, so it goes, unless it is all there is.
    """
    spark = df.sparkSession
    before = set(_matching(spark, path, "part-00000-*"))
    out = df.write.mode(mode).option("compression", codec)
    if rows_per_group:
        out = out.option("parquet.block.row.count.limit", str(rows_per_group))
    out.parquet(path)
    for file in set(_matching(spark, path, "part-00000-*")) - before:
        if not read_footer(spark, file).group_rows and len(_matching(spark, path, "[^_.]*")) > 1:
            where = spark._jvm.org.apache.hadoop.fs.Path(file)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def _matching(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """What lies in a folder, in any store, by a pattern of names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(re.sub(r"([\\{}\[\]*?^])", r"\\\1", path) + "/" + pattern)
    return [f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]


def with_batch_index(df: DataFrame) -> DataFrame:
    """The scan with the place of each row: file, start of its split, row in the file."""
    return df.select("*", F.col("_metadata.file_path").alias("batch_file"), F.col("_metadata.file_block_start").alias("batch_start"), F.col("_metadata.row_index").alias("batch_row"))
