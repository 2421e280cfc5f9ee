"""Quality classification by random Fourier features, ridge regression and isotonic calibration.

Every whole text becomes a fixed vector of statistics (shares of character classes, word and line
lengths, repetition). N_FOURIER random cosines of the standardised vector approximate a Gaussian
kernel; each partition sums its part of the normal equations, the parts meet in a tree of FAN_IN, and the
driver solves one N_FOURIER-square system, whose size has nothing to do with the data's. The ridge's
outputs are counted in N_BINS bins and made monotone in the label's share by pooling adjacent violators.
A fit uses MAX_FIT labelled rows at most, those of the smallest hashes of their doc_id; scores are for all rows.

Cases: null and empty texts have a vector of zeros and get a score like any other; rows without a label
or with a null one are only scored; a doc_id labelled more than once counts with its lowest label; with
no labels at all every score is 0.5; rows that share a doc_id are scored one by one; texts of any length
are read in full; no rows give no rows; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import settled, ship, staged

N_FOURIER, WIDTH, RIDGE, SEED = 320, 5.0, 1e-3, 20240
N_BINS, FAN_IN, CUT = 1024, 16, 0.3
#: Labelled rows that a fit learns from; their doc_ids are broadcast, at some 50 bytes each.
MAX_FIT = 500_000

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b";:", b"'\"", b"|", b"#", b"*", b"&", b"%", b"$", b"@", b"/\\", b"<>", b"()[]{}", b"-_=+~^`"]
_OF = np.zeros((256, len(_CLASSES) + 3), "f4")
for _n, _c in enumerate(_CLASSES):
    _OF[list(_c), _n] = 1
_OF[list(range(0, 9)) + list(range(14, 32)) + [127], -3] = 1
_OF[128:192, -2] = 1
_OF[192:, -1] = 1
N_STATS = _OF.shape[1] + 19


def statistics(text: str | None) -> np.ndarray:
    """The vector of one whole text."""
    out = np.zeros(N_STATS, "f8")
    data = (text or "").encode()
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / len(data)
    k = _OF.shape[1]
    out[:k] = np.sqrt(share @ _OF)
    present = share[share > 0]
    words, lines = data.lower().split(), data.split(b"\n")
    n = len(words)
    v = out[k:]
    v[0], v[1], v[2] = math.log1p(len(data)), math.log1p(n), math.log1p(len(lines))
    v[3] = -(present * np.log2(present)).sum()
    lens = np.fromiter(map(len, lines), "f8", len(lines))
    v[4], v[5] = math.log1p(lens.mean()), math.log1p(lens.std())
    v[6] = len(set(lines)) / len(lines)
    v[7] = (lens == 0).mean()
    v[8] = sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    if n:
        size = np.fromiter(map(len, words), "f8", n)
        v[9], v[10], v[11] = size.mean() / 5, size.std() / 5, math.log1p(size.max())
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        freq = np.sort(np.fromiter(seen.values(), "f8", len(seen)))[::-1] / n
        v[12], v[13], v[14] = len(seen) / math.sqrt(n), freq[0], freq[:5].sum()
        v[15] = -(freq * np.log2(freq)).sum() / max(1.0, math.log2(n + 1))
        v[16] = sum(map(bytes.__eq__, words, words[1:])) / n
        v[17] = len(set(zip(words, words[1:], strict=False))) / n
        v[18] = sum(map(bytes.isalpha, words)) / n
    return out


def _waves(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((N_STATS, N_FOURIER)) / WIDTH, rng.uniform(0, 2 * np.pi, N_FOURIER)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Random features of standardised vectors, and a constant."""
    waves, shift = _waves(seed)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.cos(z @ waves + shift) * math.sqrt(2 / N_FOURIER), np.ones((len(z), 1))])


def isotonic(at: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, y) of a non-decreasing curve: pooled neighbours, each at its mean place."""
    blocks: list[list[float]] = []
    for x, p, c in zip(at, positives, counts, strict=True):
        blocks.append([p, c, x * c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the vectors as binary, in doubles."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t.as_py()).astype("f4").tobytes() for t in b.column("text")], pa.binary())], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(settled(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "f4").reshape(-1, N_STATS).astype("f8")


def _tree_sum(parts: DataFrame, n: int) -> np.ndarray | None:
    """The sum of the vectors in (node, v), met FAN_IN at a time."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": [key[0]], "v": [sum(np.frombuffer(x, "f8") for x in rows["v"]).tobytes()]})

    while True:
        parts = parts.groupBy(F.floor(F.col("node") / FAN_IN).cast("int").alias("node")).applyInPandas(add, "node int, v binary")
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    row = parts.first()
    return None if row is None else np.frombuffer(row["v"], "f8")


def learnt_from(labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """(doc_id, label) of at most max_fit labelled documents, one row each."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    known = staged(known, "labels")
    return known if known.count() <= max_fit else staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit), "labels")


def fit(stats: DataFrame, labels: DataFrame) -> dict | None:
    """A model from (doc_id, stats) and learnt_from's (doc_id, label in 0/1); None without labels."""
    known = staged(stats.join(F.broadcast(labels), "doc_id"), "labelled")
    n = max(1, known.rdd.getNumPartitions())

    def summed(part) -> np.ndarray | None:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                if b.num_rows:
                    total = total + part(_matrix(b.column("stats")), b.column("label").to_numpy(zero_copy_only=False))
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["node", "v"])

        return _tree_sum(known.mapInArrow(settled(run), "node int, v binary"), n)

    moments = summed(lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return None
    count, positive = moments[:2]
    mean = moments[2 : 2 + N_STATS] / count
    scale = np.sqrt(np.maximum(moments[2 + N_STATS :] / count - mean**2, 0))
    scale = np.where(scale < 1e-6, 1.0, scale)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, scale)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = summed(normal)
    d = N_FOURIER + 1
    left = sums[: d * d].reshape(d, d) / count + RIDGE * np.diag([1.0] * N_FOURIER + [0.0])
    model = {"mean": mean, "scale": scale, "w": np.linalg.solve(left, sums[d * d :] / count), "x": None, "y": None}
    raw = score(known, model, "label").groupBy(F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "raw")) + 1) / 3 * N_BINS).alias("bin"))
    bins = sorted(raw.agg(F.sum("label").alias("p"), F.count("*").alias("c"), F.sum("raw").alias("s")).collect())
    model["x"], model["y"] = isotonic(np.array([b["s"] / b["c"] for b in bins]), np.array([b["p"] for b in bins]), np.array([b["c"] for b in bins], "f8"))
    return model


def score(stats: DataFrame, model: dict | None, *more: str) -> DataFrame:
    """doc_id, raw (the ridge's output), score (calibrated, 0 to 1) and the columns named in `more`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None or not b.num_rows:
                raw = calibrated = np.full(b.num_rows, 0.5)
            else:
                raw = fourier(_matrix(b.column("stats")), model["mean"], model["scale"]) @ model["w"]
                calibrated = raw if model["x"] is None else np.clip(np.interp(raw, model["x"], model["y"]), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw), pa.array(calibrated), *(b.column(c) for c in more)], ["doc_id", "raw", "score", *more])

    kinds = {f.name: f.dataType.simpleString() for f in stats.schema}
    return stats.mapInArrow(settled(run), f"doc_id {kinds['doc_id']}, raw double, score double" + "".join(f", {c} {kinds[c]}" for c in more))


def held_out(folds: int = 5):
    """True where crc32 of the doc_id's text is a multiple of `folds`; null ids are never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the rows held out are never learnt from."""
    stats = staged(text_statistics(docs), "stats")
    model = fit(stats, learnt_from(labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())))
    return score(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """`docs` without those that the classifier rejects; all columns as they came.

    The labelled texts' statistics are computed for the fit, then all texts are judged where they are, in one pass.
    """
    known = learnt_from(labels.select("doc_id", F.col("quality").alias("label")).where(~held_out()))
    model = fit(text_statistics(docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")), known)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None or not b.num_rows:
                yield b
                continue
            x = np.array([statistics(t.as_py()).astype("f4") for t in b.column("text")], "f8")
            raw = fourier(x, model["mean"], model["scale"]) @ model["w"]
            yield b.filter(pa.array(np.clip(np.interp(raw, model["x"], model["y"]), 0, 1) >= cut))

    return docs.mapInArrow(settled(keep), docs.schema)
