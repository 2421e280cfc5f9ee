"""Near-duplicate components by fast similarity sketching, banding and exact verification.

A document's set of word shingles fills BINS coordinates in rounds: in each of the first BINS rounds
every shingle is thrown into a bin by a fresh hash, and a bin that was empty before keeps its smallest
value; in the next BINS rounds round i fills bin i alone. So every coordinate is filled for certain, a
set of a few hundred shingles is done after two or three rounds, and two sets agree on a share of
coordinates that is concentrated around their similarity. BANDS bands of ROWS coordinates make
candidates: at a similarity of 0.8 a pair is missed with probability 5e-8, at 0.85 with 6e-11.

Documents with equal sets are one node. Nodes that share a band form candidate components, found from one
edge a node and band, so a bucket of n costs n rows. Each candidate component goes to one task as whole texts, where
a search from node to node compares the full sets and leaves no link between different components out.
A candidate component beyond BLOCK_NODES or BLOCK_SHINGLES is cut into blocks, each with the component's
hub; nodes that found no way to the hub are then compared with every other block, chunk by chunk.

Cases: null, empty and blank texts have no shingles and link to nothing; with fewer words than a shingle
the whole sequence is one; a null doc_id links to nothing and is kept; rows that share a doc_id are one
node; texts of any length are read in full; no rows give no rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import attach, batch_of, components, settled, ship, staged

BINS, BANDS, ROWS = 128, 32, 4
BLOCK_NODES, BLOCK_SHINGLES = 4000, 4_000_000
#: Shingles sketched at a time.
CHUNK = 1_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_ODD = _mix(np.arange(1, 65, dtype=_U)) | _U(1)
_SEEDS = _mix(np.arange(1 << 20, (1 << 20) + 2 * BINS, dtype=_U))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = min(size, len(h))
    x = sum(h[i : len(h) - n + 1 + i] * _ODD[i] for i in range(n))
    return np.unique(_mix(x + _U(n if n < size else 0)))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x BINS coordinates; no set may be empty."""
    out = np.full(len(sets) * BINS, np.iinfo(_U).max, _U)
    x = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * BINS, [len(s) for s in sets])
    done = np.zeros(len(out), bool)
    for i in range(2 * BINS):
        v = _mix(x ^ _SEEDS[i])
        slot = base + (v & _U(BINS - 1)).astype(np.int64) if i < BINS else base + (i - BINS)
        free = ~done[slot]
        np.minimum.at(out, slot[free], v[free])
        done[slot[free]] = True
        open_sets = ~done.reshape(-1, BINS).all(1)
        if not open_sets.any():
            break
        still = open_sets[base // BINS]
        x, base = x[still], base[still]
    return out.reshape(-1, BINS)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """len x BANDS keys; the band's number is in the key."""
    c = coordinates.reshape(len(coordinates), BANDS, ROWS)
    key = _mix(np.arange(1, BANDS + 1, dtype=_U))[None, :]
    for r in range(ROWS):
        key = _mix(key ^ c[:, :, r] * _ODD[r])
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands (null without shingles)."""
    ship(docs.sparkSession)

    def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = band_keys(sketch([sets[i] for i in full])) if full else np.empty((0, BANDS), np.int64)
        bands: list = [None] * len(sets)
        for row, i in enumerate(full):
            bands[i] = keys[row]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
        columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(i)
                sets.append(shingles(text.as_py(), size))
                held += len(sets[-1])
                if held >= CHUNK or len(ids) >= 5000:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(settled(run), "doc_id long, n_shingles long, digest string, bands array<long>")


class _Sets:
    """Sets of one group over local numbers of shingles; rows can be compared with one row at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets])
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        self.local = local.astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.mark = np.zeros(int(self.local.max()) + 1, np.int32)

    def pack(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cat = np.concatenate([self.local[self.start[r] : self.start[r + 1]] for r in rows])
        return rows, cat, np.concatenate([[0], np.cumsum(self.n[rows])[:-1]])

    def linked(self, row: int, packed: tuple, percent: int) -> np.ndarray:
        """Which of the packed rows have a similarity of percent / 100 or more with row."""
        rows, cat, starts = packed
        own = self.local[self.start[row] : self.start[row + 1]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[cat], starts)
        self.mark[own] = 0
        return 100 * both >= percent * (self.n[row] + self.n[rows] - both)


def group_components(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first index of its component; every pair of components has been compared in full."""
    label = [-1] * len(sets)
    if len(sets) == 1:
        return [0]
    s = _Sets(sets)
    left = np.arange(len(sets))
    while len(left):
        seed, left = int(left[0]), left[1:]
        label[seed], queue = seed, [seed]
        packed = s.pack(left) if len(left) else None
        alive = np.ones(len(left), bool)
        while queue and alive.any():
            hit = s.linked(queue.pop(), packed, percent) & alive
            for r in left[hit].tolist():
                label[r] = seed
                queue.append(r)
            alive &= ~hit
            if 0 < 2 * alive.sum() < len(left):
                left = left[alive]
                packed, alive = s.pack(left), np.ones(len(left), bool)
        left = left[alive]
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal leading `keys` columns, from sorted batches."""
    at, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def near_components(docs: DataFrame, size: int, percent: int, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links are similarities of percent / 100 or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = staged(sketches(docs, size), "sketches")
    linkable = known.where("digest is not null and doc_id is not null")
    node = [F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")]
    sets = staged(linkable.groupBy("digest").agg(*node), "sets")

    # One edge for a node and a band, to the band's smallest node; a full bucket's centre is broadcast, so its rows stay spread.
    keys = sets.select("node", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    met = attach(keys, centres, "key", "n", BANDS * sets.count()).where("node <> centre")
    near = components(met.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())

    sized = staged(near.join(sets.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles")), "node"), "sized")
    of_nodes, of_shingles = F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n_shingles") / block_shingles)
    blocks = sized.groupBy("root").agg(F.greatest(of_nodes, of_shingles).cast("int").alias("blocks"), F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    members = staged(attach(sized, blocks, "root", "n").select("node", "root", "blocks", block), "members")

    # Always a merge join: a broadcast of small member tables would not stand for what happens at scale.
    texts = docs.join(members.hint("merge"), docs["doc_id"] == members["node"]).select("root", "block", "blocks", "node", "text")
    large = members.where("blocks > 1").limit(1).count() > 0
    # The hub of a large component, its root, stands in every block.
    hub = (F.col("blocks") > 1) & (F.col("node") == F.col("root"))
    everywhere = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = texts.withColumn("block", F.explode(everywhere)) if large else texts

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (root, block), rows in _groups(batches, 2):
            rows.sort(key=lambda r: r[1])
            labels = group_components([shingles(r[2], size) for r in rows], percent)
            out += [(root, block, r[0], r[1], rows[label][1]) for r, label in zip(rows, labels, strict=True)]
            if len(out) > 20_000:
                yield batch_of(out, solved_schema)
                out = []
        if out:
            yield batch_of(out, solved_schema)

    solved_schema = pa.schema([(c, pa.int64()) for c in ("root", "block", "blocks", "node", "label")])
    by_block = dealt.repartition("root", "block").sortWithinPartitions("root", "block")
    solved = staged(by_block.mapInArrow(settled(solve), "root long, block long, blocks long, node long, label long"), "solved")
    labels = solved.where("blocks = 1").groupBy("node").agg(F.min("label").alias("label"))
    if large:
        labels = labels.unionByName(_across(solved.where("blocks > 1"), texts, size, percent, block_nodes))

    labelled = sets.select("digest", "node", "copies").join(labels, "node", "left")
    merged = staged(labelled.select("digest", F.coalesce("label", "node").alias("component_id"), "copies"), "merged")
    linked = attach(linkable.select("doc_id", "n_shingles", "digest"), merged, "digest", "copies").select("doc_id", "n_shingles", "component_id")
    alone = known.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.expr("doc_id <=> component_id"))


def _across(solved: DataFrame, texts: DataFrame, size: int, percent: int, block_nodes: int) -> DataFrame:
    """(node, label) in components of several blocks: nodes without a way to the hub meet all other blocks, chunk by chunk."""
    hub = solved.where("node = root").select("root", "block", F.col("label").alias("hub_label"))
    astray = solved.join(hub, ["root", "block"]).where("label <> hub_label and node <> root").select("root", "blocks", "block", "node")
    sized = solved.groupBy("root").agg(F.count("*").alias("n"))
    chunks = astray.groupBy("root").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("chunks")).join(sized, "root")
    chunks = staged(chunks, "chunks")
    # A component may hold a third of all texts: its row of `chunks` is broadcast then, and its texts stay spread.
    total = solved.count()
    astray = attach(astray, chunks, "root", "n", total).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    astray = staged(astray.drop("n"), "astray")
    body = texts.where("blocks > 1").select("root", "block", "node", "text")
    with_text = astray.join(body.select("node", "text"), "node")
    to = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("to")
    asked = with_text.select("root", to, "chunk", F.col("block").alias("own"), F.lit(True).alias("asks"), "node", "text").where("to <> own").drop("own")
    there = attach(body, chunks, "root", "n", total).select(
        "root", F.col("block").alias("to"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"), "node", "text"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            own = [i for i, r in enumerate(rows) if r[0]]
            others = np.array([i for i, r in enumerate(rows) if not r[0]], dtype=np.int64)
            if not own or not len(others):
                continue
            s = _Sets([shingles(r[2], size) for r in rows])
            packed = s.pack(others)
            a, b = [], []
            for i in own:
                for j in others[s.linked(i, packed, percent)]:
                    a.append(rows[i][1])
                    b.append(rows[int(j)][1])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    order = ["root", "to", "chunk"]
    both = asked.select(*order, "asks", "node", "text").unionByName(there.select(*order, "asks", "node", "text"))
    cross = both.repartition(*order).sortWithinPartitions(*order).mapInArrow(settled(meet), "a long, b long")
    joined = components(cross.unionByName(solved.select(F.col("node").alias("a"), F.col("label").alias("b")))).select("node", F.col("root").alias("label"))
    return solved.select("node").distinct().join(joined, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_dedup(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    return near_components(docs, size, percent)


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, the smallest doc_id; all columns as they came."""
    gone = near_components(docs, size, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["__gone"], "left_anti")
