"""What the training-data operators share: staged tables, joins that stand hot keys, components of a graph."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import inspect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import shared_folder, ship, shuffle_width

__all__ = ["KEPT", "attach", "batch_of", "components", "discard", "fresh", "groups_of", "hot_keys", "keep_matching", "drop_matching", "lower_ascii", "new_path", "settle", "settled", "ship", "shuffle_width", "staged", "table", "width_for"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot when it holds more than 1/HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1000
#: Edges of a graph that are no burden for a task, whichever node they share.
SMALL = 20_000
#: Folders that this process has staged and not dropped yet, with their sessions.
_MADE: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate data in the shared folder; it is deleted when the process ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _MADE.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path in list(_MADE):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(path)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends here, and a lost executor costs no more than a reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path in _MADE:
        _delete(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or the first of name_, name__, ... that is no column of `df` (in any case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def width_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Partitions for so many bytes: the session's number, or more where each would get over `each` bytes."""
    return max(shuffle_width(spark), -(-n_bytes // each))


def lower_ascii(text: Column) -> Column:
    """A-Z only; `lower` would also change letters outside ASCII."""
    return F.translate(text, UPPER, LOWER)


def hot_keys(groups: DataFrame, size: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(hot, rest) of one row a key, whose column `size` counts the key's rows out of `total`.

    Keys with over a thousandth of all rows are fewer than a thousand by arithmetic, so they alone may be broadcast.
    """
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    return groups.where(hot), groups.where(~hot)


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int | None = None) -> DataFrame:
    """Inner join of `rows` with one row a key in `groups`, whose column `size` counts the key's rows.

    Hot keys are broadcast; the others are joined by a shuffle in which no key can be large. Stage what is
    dear to compute twice.
    """
    keys = [key] if isinstance(key, str) else key
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    hot, rest = hot_keys(groups, size, total)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(rest, keys))


def keep_matching(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """The rows whose key is in `groups`, with hot keys dealt with as in `attach`."""
    keys = [key] if isinstance(key, str) else key
    hot, rest = hot_keys(groups, size, total)
    few = F.broadcast(hot.select(*keys))
    return rows.join(few, keys, "left_semi").unionByName(rows.join(few, keys, "left_anti").join(rest.select(*keys), keys, "left_semi"))


def drop_matching(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """The rows whose key isn't in `groups`, with hot keys dealt with as in `attach`."""
    keys = [key] if isinstance(key, str) else key
    hot, rest = hot_keys(groups, size, total)
    return rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.select(*keys), keys, "left_anti")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an undirected graph with the smallest node it reaches.

    Alternating large-star and small-star contractions: each is a map-side minimum and a join in which a hub's
    minimum is broadcast, so that its edges stay spread. Each round is staged, and the rounds grow with the
    logarithm of the longest path. Nothing is collected but the number and a checksum of the edges.
    """
    print_of = [F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(v, u))")]
    edges = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = tuple(edges.agg(*print_of).first())
    while before[0]:

        def met(rows: DataFrame, low: DataFrame, total: int, n: int = before[0]) -> DataFrame:
            return rows.join(low, "u") if n <= SMALL else attach(rows, low, "u", "n", total)

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = met(both, low, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pair = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = met(large, low, before[0]).select(F.explode(pair).alias("e")).select("e.*").where("u <> v").distinct()
        next_edges = staged(small, "edges")
        discard(edges)
        edges = next_edges
        after = tuple(edges.agg(*print_of).first())
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(value, slices) of sorted batches; each group's slices must be read before the next group."""
    pending: list = [None, iter(batches), False]

    def pull() -> pa.RecordBatch | None:
        while pending[0] is None or not pending[0].num_rows:
            pending[0] = next(pending[1], None)
            if pending[0] is None:
                return None
        return pending[0]

    def slices(value: int) -> Iterator[pa.RecordBatch]:
        while (b := pull()) is not None:
            column = b.column(key).to_numpy(zero_copy_only=False)
            if column[0] != value:
                return
            n = int(np.searchsorted(column, value, "right"))
            pending[0] = b.slice(n)
            yield b.slice(0, n)

    while (b := pull()) is not None:
        value = b.column(key)[0].as_py()
        yield value, slices(value)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def settle() -> None:
    """Give memory that a Python worker has freed back to the machine: workers outlive their tasks, and executors' memory is shared."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What drops the tables that an operator keeps in a worker between its tasks, by operator.
KEPT: dict[str, Callable[[], None]] = {}


def make_room(owner: str) -> None:
    """A function of the module, as what `settled` returns is pickled with a copy of the globals that it names."""
    for name, drop in KEPT.items():
        if name != owner:
            drop()


def settled(run: Callable, owner: str = "") -> Callable:
    """The same generator or function over Arrow data, after dropping what other operators keep in the worker, and followed by settle()."""

    if inspect.isgeneratorfunction(run):

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make_room(owner)
            yield from run(batches)
            settle()

        return over
    if len(inspect.signature(run).parameters) == 1:

        def one(table: pa.Table) -> pa.Table:
            try:
                make_room(owner)
                return run(table)
            finally:
                settle()

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            make_room(owner)
            return run(left, right)
        finally:
            settle()

    return two
