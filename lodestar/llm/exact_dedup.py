"""Exact deduplication by a tree-merge of sorted digest runs.

Every scan partition sorts its digests into runs, and the runs are dealt to P nodes, a power of two. Then log2(P)
binomial rounds follow: in each, nodes pair up, both cut their runs at the next bit of the digest, and each half
goes to one of the two, which merges what it gets. So after every round a node's run covers half the digests of
before but twice as many nodes' rows; after the last round each run is the whole of one range. A run never grows,
a digest is in it once, and a group that holds a third of all rows is one entry a run.

An entry is verified at every merge: digests are one only if the texts' lengths and a second, independent
checksum agree too. It keeps the extreme identifier, how many rows have that identifier, and the group's size.

Cases: a null text counts as empty; a null doc_id ranks after all others and is kept only if its group has nothing
else; rows that share doc_id and text get the same verdict in `exact_dedup`, and one of them stays in
`drop_exact_copies`; texts of any length are one digest; no rows give no rows; other columns pass by untouched and
may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import attach, discard, drop_matching, fresh, hot_keys, keep_matching, settled, ship, shuffle_width, staged

#: Entries that a node's run is to have, at 72 bytes each; and the fewest nodes.
RUN_ROWS, MIN_NODES = 500_000, 8
#: Rows that a partition sorts at a time.
LEAF_ROWS = 50_000
#: Rounds between two tables that end the lineage.
ROUNDS_A_STAGE = 4
_ENTRY = np.dtype([("digest", "S32"), ("check", "<i8"), ("n_bytes", "<i8"), ("best", "<i8"), ("ties", "<i8"), ("count", "<i8")])
_NONE = np.iinfo(np.int64).min
_KEY = ["text_sha256", "check", "n_bytes"]


def merge(entries: np.ndarray, keep: str) -> np.ndarray:
    """One entry for each verified digest, in order; `entries` are sorted runs one after another, for which the stable sort is a merge."""
    if not len(entries):
        return entries
    entries = entries[np.argsort(entries["digest"], kind="stable")]
    same = entries["digest"][1:] == entries["digest"][:-1]
    agree = (entries["check"][1:] == entries["check"][:-1]) & (entries["n_bytes"][1:] == entries["n_bytes"][:-1])
    if (same & ~agree).any():  # one digest of different texts
        entries = entries[np.lexsort((entries["n_bytes"], entries["check"], entries["digest"]))]
        same = entries["digest"][1:] == entries["digest"][:-1]
        agree = (entries["check"][1:] == entries["check"][:-1]) & (entries["n_bytes"][1:] == entries["n_bytes"][:-1])
    new = np.concatenate([[True], ~(same & agree)])
    starts = np.flatnonzero(new)
    out = entries[starts].copy()
    if keep == "largest":
        best = np.maximum.reduceat(entries["best"], starts)
    else:
        # Null identifiers come last here, too.
        last = np.iinfo(np.int64).max
        best = np.minimum.reduceat(np.where(entries["best"] == _NONE, last, entries["best"]), starts)
        best = np.where(best == last, _NONE, best)
    out["best"] = best
    out["ties"] = np.add.reduceat(np.where(entries["best"] == best[np.cumsum(new) - 1], entries["ties"], 0), starts)
    out["count"] = np.add.reduceat(entries["count"], starts)
    return out


def halves(run: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """A sorted run whose digests agree in their first `bit` bits, cut at the next one."""
    first = np.frombuffer(run["digest"].tobytes(), ">u8")[::4].astype(np.uint64)
    at = int(np.searchsorted(first >> np.uint64(63 - bit) & np.uint64(1), 1))
    return run[:at], run[at:]


_RUN = pa.schema([("node", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
_RUN_DDL = "node int, part int, payload binary"


def _sent(node: int, part: int, run: np.ndarray, bit: int) -> pa.RecordBatch:
    """What a node sends in the round that cuts at `bit`: each half to the node of the pair that goes on with it."""
    rows = [(node >> 1, part << 1 | side, half.tobytes()) for side, half in enumerate(halves(run, bit)) if len(half)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((), (), ()), _RUN, strict=True)], schema=_RUN)


def _met(runs: pa.Table, keep: str) -> np.ndarray:
    return merge(np.concatenate([np.frombuffer(p.as_buffer(), _ENTRY) for p in runs.column("payload")]), keep)


def _leaves(nodes: int, keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId(), [], 0
        for b in batches:
            e = np.zeros(b.num_rows, _ENTRY)
            e["digest"] = np.frombuffer(b"".join(b.column("digest").to_pylist()), "S32")
            e["check"] = b.column("check").to_numpy(zero_copy_only=False)
            e["n_bytes"] = b.column("n_bytes").to_numpy(zero_copy_only=False)
            e["best"] = b.column("doc_id").cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)
            e["ties"] = e["count"] = 1
            held.append(merge(e, keep))
            size += len(held[-1])
            if size >= LEAF_ROWS:
                yield _sent(number % nodes, 0, merge(np.concatenate(held), keep), 0)
                number, held, size = number + 1, [], 0
        if held:
            yield _sent(number % nodes, 0, merge(np.concatenate(held), keep), 0)

    return run


def _round(bit: int, keep: str) -> Callable[[pa.Table], pa.Table]:
    def meet(runs: pa.Table) -> pa.Table:
        node, part = runs.column("node")[0].as_py(), runs.column("part")[0].as_py()
        return pa.Table.from_batches([_sent(node, part, _met(runs, keep), bit)])

    return meet


def _tell(keep: str) -> Callable[[pa.Table], pa.Table]:
    """The last round: the range's entries, row by row."""

    def tell(runs: pa.Table) -> pa.Table:
        e = _met(runs, keep)
        hexed = e["digest"].tobytes().hex()
        best = pa.array(e["best"], pa.int64(), mask=e["best"] == _NONE)
        digests = pa.array([hexed[i : i + 64] for i in range(0, len(hexed), 64)], pa.string())
        return pa.table({"text_sha256": digests, "check": e["check"], "n_bytes": e["n_bytes"], "keep_id": best, "ties": e["ties"], "group_size": e["count"]})

    return tell


def _digests(docs: DataFrame) -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes")]


def exact_groups(docs: DataFrame, keep: str = "largest", run_rows: int = RUN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id and verified digest of every row; keep_id, ties (rows with that id) and group_size of every digest."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    ship(spark)
    rows = staged(docs.select("doc_id", *_digests(docs)), "digests")
    nodes, n_rows = MIN_NODES, rows.count()
    while nodes * run_rows < n_rows:
        nodes *= 2
    rounds = nodes.bit_length() - 1

    runs = rows.select("doc_id", F.unhex("text_sha256").alias("digest"), "check", "n_bytes").mapInArrow(settled(_leaves(nodes, keep)), _RUN_DDL)
    for bit in range(1, rounds):
        runs = _paired(runs, nodes).applyInArrow(settled(_round(bit, keep)), _RUN_DDL)
        if bit % ROUNDS_A_STAGE == 0:
            runs = staged(runs, "runs")
    told = "text_sha256 string, check long, n_bytes long, keep_id long, ties long, group_size long"
    return rows, staged(_paired(runs, nodes).applyInArrow(settled(_tell(keep)), told), "groups")


def _paired(runs: DataFrame, nodes: int):  # noqa: ANN202
    """Runs by the node that they were sent to; a round has as many receivers as nodes."""
    wide = nodes // 4
    if wide > shuffle_width(runs.sparkSession):
        runs = runs.repartition(wide, "node", "part")
    return runs.groupBy("node", "part")


def exact_dedup(docs: DataFrame, keep: str = "largest", run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document, dropped ones too."""
    rows, groups = exact_groups(docs, keep, run_rows)
    both = attach(rows, groups, _KEY, "group_size")
    return both.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, keep: str = "largest", run_rows: int = RUN_ROWS) -> DataFrame:
    """`docs` with one row of each text, that with the largest (or smallest) doc_id; all columns as they came."""
    rows, groups = exact_groups(docs, keep, run_rows)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    names = {c: fresh(docs, f"__{c}") for c in (*_KEY, "rank")}
    keys = [names[c] for c in _KEY]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_digests(docs), keys, strict=True)])

    # Only groups of two or more can drop anything.
    many = groups.where("group_size > 1").select(*[F.col(c).alias(names[c]) for c in _KEY], F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    hot, rest = hot_keys(many, "__size", total)
    left = keyed
    for part in (F.broadcast(hot), rest.hint("merge")):
        same = [left[k] == part[k] for k in keys]
        left = left.join(part, [*same, ~left["doc_id"].eqNullSafe(part["__keep"])], "left_anti")

    # Of rows that repeat the kept one as a whole, its identifier included, one stays.
    tied = groups.where("ties > 1").select(*[F.col(c).alias(names[c]) for c in _KEY], F.col("ties").alias("__ties"))
    if tied.limit(1).count():
        order = Window.partitionBy(*keys).orderBy("doc_id")
        first = keep_matching(left, tied, keys, "__ties", total).withColumn(names["rank"], F.row_number().over(order)).where(F.col(names["rank"]) == 1)
        left = drop_matching(left, tied, keys, "__ties", total).unionByName(first.drop(names["rank"]))
    discard(rows)
    return left.drop(*keys)
