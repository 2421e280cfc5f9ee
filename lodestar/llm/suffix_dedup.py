"""Removal of long repeated byte strings by suffix arrays, sorted in two stages.

Every LENGTH-byte string has an anchor, the GRAM-byte string in it with the smallest hash, which its content alone
decides. So equal strings have equal anchors, and neighbouring strings mostly share theirs: a run of such starts is a
segment. Buckets of texts ask the anchors' owners which anchors occur more than once; only starts of those are looked
at further. Anchors do nothing but deal the work out: which strings are equal is read from sorted suffixes alone.

Every block of a bucket's texts is sorted: suffixes smaller than their successors directly, the others induced from
them, bucket by bucket of the first byte: scanning the sorted suffixes of a byte puts the suffixes one to the left in
their places. Then the common prefix of each suffix with its neighbour is computed; where it is LENGTH bytes or more,
both begin with the same string, of which all but the first in (doc_id, start) are marked. What is first in its block
goes on by its anchor as pieces, and those of all blocks that meet are sorted, compared and marked in the same way.
A string that stands in many blocks is folded as it comes: after each sort only its first place stays. An anchor
with over HOT places is cut into single strings, dealt by their own hash, so no group grows with the texts around a
common string.

Cases: null and empty texts and texts under LENGTH bytes lose nothing; a null doc_id comes before all others; rows
that share a doc_id but not the text are documents in the order of a checksum, rows that share both are one document;
texts of any length are cut in full, a block at a time; no rows give no rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, groups_of, settled, ship, width_for

LENGTH, GRAM = 100, 24
BUCKET_BYTES = 4 << 20
#: Bytes that are sorted together; places in them fit in 20 bits.
CHUNK, _PLACES = 1 << 19, (1 << 20) - 1
#: Bytes of pieces that are sorted together, but for what is left of a single group of up to HOT strings.
BLOCK = 1 << 19
#: Bytes of text for each owner of anchors, and for each partition of the shuffles.
OWNER_BYTES, PART_BYTES = 32 << 20, 32 << 20
HOT = 50_000
_U = np.uint64
_RANDOM = np.random.default_rng(7).integers(1, 1 << 63, 264, dtype=np.uint64) * _U(2) + _U(1)
_BYTE, _ODD = _RANDOM[:256], _RANDOM[256:]
#: Bytes by which suffixes are ordered: more than a string, in whole words of 8.
DEPTH = LENGTH + 4


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings: of 1, 2, 4, 8 and 16 bytes by doubling, then of 16 and 8 together."""
    h, eight, size = _BYTE[data], None, 1
    for odd in _ODD[:4]:
        h = h[:-size] * odd + h[size:]
        h ^= h >> _U(29)
        size *= 2
        if size == 8:
            eight = h
    h = h[: len(data) - GRAM + 1] * _ODD[4] + eight[16 : 16 + len(data) - GRAM + 1]
    h = (h ^ (h >> _U(32))) * _ODD[5]
    return h ^ (h >> _U(29))


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of the runs of string starts with one anchor; `ends` are the ends of the texts that data joins."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none.view(_U), none, none
    h = gram_hashes(data)
    low = (h & ~_U(_PLACES)) | np.arange(len(h), dtype=_U)
    span, size = LENGTH - GRAM + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(h) - span + 1], low[span - size : span - size + len(h) - span + 1])
    at = (low & _U(_PLACES)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    room = np.repeat(ends, ends - begins)[: len(at)] - np.arange(len(at)) >= LENGTH
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (room[1:] != room[:-1])
    new |= np.isin(np.arange(len(at)), begins, assume_unique=True)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    good = room[first]
    return h[at[first[good]]], first[good], last[good]


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions (a mask) in the order of their suffixes, as far as `depth` bytes tell; data ends with depth zeros more."""
    n = len(wanted)
    # The end is a suffix too, smaller than all others, and the first to be sorted.
    text = np.append(data[:n].astype(np.int16), np.int16(-1))
    step = np.sign(text[1:] - text[:-1]).astype(np.int8)
    # Equal neighbours are of the type of the next different pair; the last byte is larger than the end.
    turn = np.where(step != 0, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    rising = np.append(step[turn] > 0, True)
    # Wherever an induced suffix is wanted, all up to the next directly sorted one are needed.
    next_rising = np.where(rising, np.arange(n + 1), n)
    next_rising = np.minimum.accumulate(next_rising[::-1])[::-1]
    mark = np.zeros(n + 2, np.int32)
    starts = np.flatnonzero(wanted)
    mark[starts] = 1
    mark -= np.bincount(next_rising[starts] + 1, minlength=n + 2).astype(np.int32)
    need = np.cumsum(mark[:n]) > 0
    rising = rising[:n]

    # Directly sorted are the suffixes that are smaller than their successors, one first byte after another.
    direct = np.flatnonzero(need & rising)
    direct = direct[np.argsort(data[direct], kind="stable")]
    cut = np.searchsorted(data[direct], np.arange(257))
    window = np.lib.stride_tricks.sliding_window_view(data, depth)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a > 1:
            rows = np.ascontiguousarray(window[direct[a:b]]).view(f"S{depth}").ravel()
            direct[a:b] = direct[a:b][np.argsort(rows, kind="stable")]
    falling = need & ~rising
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and falling[n - 1]:
        coming[data[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        placed = coming[byte]
        last = np.concatenate(placed) if placed else np.empty(0, np.int64)
        while len(last):
            before = last[last > 0] - 1
            last = before[falling[before] & (data[before] == byte)]
            if len(last):
                placed.append(last)
        full = np.concatenate([*placed, direct[cut[byte] : cut[byte + 1]]])
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[falling[before] & (data[before] > byte)]
        if len(before):
            of = data[before]
            order = np.argsort(of, kind="stable")
            before, of = before[order], of[order]
            edges = np.flatnonzero(np.diff(of)) + 1
            for part in np.split(before, edges):
                coming[data[part[0]]].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each suffix but the first with the one before it, at most LENGTH; eight bytes at a time."""
    word = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = np.full(max(0, len(order) - 1), LENGTH, np.int64)
    alive, left, right = np.arange(len(out)), order[:-1], order[1:]
    for at in range(0, DEPTH, 8):
        apart = word[left + at] ^ word[right + at]
        differ = apart != 0
        x = apart[differ]
        # The lowest bit that differs is in the first byte that does.
        out[alive[differ]] = at + np.log2((x & (~x + _U(1))).astype("f8")).astype(np.int64) // 8
        same = ~differ
        alive, left, right = alive[same], left[same], right[same]
        if not len(alive):
            break
    return np.minimum(out, LENGTH)


def later_copies(data: np.ndarray, wanted: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A mask of the wanted starts whose string also stands at a smaller place, by the sorted suffixes and their common prefixes.

    data ends with DEPTH + 8 bytes more than wanted has places; equal places are one.
    """
    later = np.zeros(len(wanted), bool)
    order = two_stage_order(data, wanted, DEPTH)
    if not len(order):
        return later
    run = np.flatnonzero(np.concatenate([[True], common_prefixes(data, order) < LENGTH]))
    at = place[order]
    first = np.repeat(np.minimum.reduceat(at, run), np.diff(np.append(run, len(at))))
    later[order[at != first]] = True
    return later


def _padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(DEPTH + 8), np.uint8)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a mask begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _ranked(places: list[tuple[int, int, int]]) -> np.ndarray:
    """The rank of each (doc, tie, start); equal ones share it."""
    rank = {p: i for i, p in enumerate(sorted(set(places)))}
    return np.array([rank[p] for p in places], np.int64)


class Pieces:
    """Pieces of text, each with n string starts from a place on, that are sorted together."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, bytes]] = []
        self.bytes = 0

    def add(self, bucket: int, doc: int, tie: int, start: int, n: int, piece: bytes) -> None:
        self.rows.append((bucket, doc, tie, start, n, piece))
        self.bytes += len(piece)

    def solve(self, since: int = 0) -> tuple[list[tuple[int, int, int, int, int]], Pieces]:
        """(marks, what is left): the runs (bucket, doc, tie, start, n) of starts whose strings stand earlier; and, of the rows from `since` on, pieces of all the others."""
        left, marks = Pieces(), []
        if not self.rows:
            return marks, left
        sizes = np.array([len(r[5]) for r in self.rows])
        counts = np.array([r[4] for r in self.rows])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = int(sizes.sum())
        mark = np.zeros(n + 1, np.int32)
        mark[begin] = 1
        mark[begin + counts] -= 1
        wanted = np.cumsum(mark[:-1]) > 0
        # Starts of pieces that overlap in one text must compare by their places in it.
        texts = {t: i for i, t in enumerate(sorted({r[1:3] for r in self.rows}))}
        lead = np.array([texts[r[1:3]] for r in self.rows], np.int64) << 40 | np.array([r[3] for r in self.rows], np.int64)
        place = np.repeat(lead - begin, sizes) + np.arange(n)
        later = later_copies(_padded(b"".join(r[5] for r in self.rows)), wanted, place)

        def runs(mask: np.ndarray) -> Iterator[tuple[int, int, int]]:
            """(row, from, to) of the runs, which end where a piece's starts do."""
            x, y = _runs(mask)
            row = np.searchsorted(begin, x, "right") - 1
            yield from zip(row.tolist(), (x - begin[row]).tolist(), (y - begin[row]).tolist(), strict=True)

        for row, x, y in runs(later):
            bucket, doc, tie, start, *_ = self.rows[row]
            marks.append((bucket, doc, tie, start + x, y - x))
        if since < len(self.rows):
            rest = wanted & ~later
            rest[: begin[since]] = False
            for row, x, y in runs(rest):
                bucket, doc, tie, start, _, piece = self.rows[row]
                left.add(bucket, doc, tie, start + x, y - x, piece[x : y + LENGTH - 1])
        return marks, left


def _chunks(texts: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """(data, ends, [(doc, tie, start of the part in its text)]) of at most about CHUNK bytes; long texts are cut with LENGTH - 1 bytes in common."""
    held: list[bytes] = []
    about: list[tuple[int, int, int]] = []
    size = 0
    for doc, tie, text in texts:
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and size + len(part) > CHUNK + LENGTH - 1:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]), about
                held, about, size = [], [], 0
            held.append(part)
            about.append((doc, tie, at))
            size += len(part)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]), about


def _texts(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    unpress = zstandard.ZstdDecompressor()
    for doc, tie, data in zip(table.column("doc").to_pylist(), table.column("tie").to_pylist(), table.column("data"), strict=True):
        yield doc, tie, unpress.decompress(data.as_py())


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, schema)]) if rows else schema.empty_table()


def repeated_spans(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(packed texts, marks): marks are (bucket, doc, tie, start, n), runs of starts of strings that also start earlier."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners, buckets = max(1, -(-size // OWNER_BYTES)), max(1, -(-size // bucket_bytes))
    width = width_for(spark, size, PART_BYTES)
    parts = [width] if width_for(spark, 0, 1) < width else []
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for b in batches:
            ties, data = [], []
            for t in b.column("text"):
                raw = t.as_py().encode()
                ties.append(zlib.crc32(raw))
                data.append(press.compress(raw))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(ties, pa.int64()), pa.array(data, pa.binary())], ["doc", "tie", "data"])

    packed = rows.mapInArrow(settled(pack), "doc long, tie long, data binary")
    packed = packed.select(F.pmod(F.xxhash64("doc", "tie"), F.lit(buckets)).cast("int").alias("bucket"), "doc", "tie", "data").repartition(*parts, "bucket")

    ask_schema = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("counts", pa.binary())])

    def ask(texts: pa.Table) -> pa.Table:
        """A bucket's distinct anchors and how often they occur, by owner."""
        found = [segments(data, ends)[0] for data, ends, _ in _chunks(_texts(texts))]
        anchors, n = np.unique(np.concatenate([*found, np.empty(0, _U)]), return_counts=True)
        of = ((anchors >> _U(32)) * _U(owners) >> _U(32)).astype(np.int64)
        cut = np.searchsorted(of, np.arange(owners + 1))
        bucket = texts.column("bucket")[0].as_py()
        return _rows([(o, bucket, anchors[cut[o] : cut[o + 1]].tobytes(), write_counts(n[cut[o] : cut[o + 1]])) for o in range(owners) if cut[o] < cut[o + 1]], ask_schema)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors that occur more than once, with 1 or, if they are hot, 2."""
        for _, slices in groups_of(batches, "owner"):
            asked = [(bucket, np.frombuffer(a.as_py(), _U), c.as_py()) for b in slices for bucket, a, c in zip(b.column("bucket").to_pylist(), b.column("anchors"), b.column("counts"), strict=True)]
            every = np.concatenate([a for _, a, _ in asked])
            order = np.argsort(every, kind="stable")
            every, counts = every[order], np.concatenate([read_counts(c, len(a)) for _, a, c in asked])[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            total = np.add.reduceat(counts, starts, dtype=np.int64)
            unique = every[starts]
            flag = (total > 1).astype(np.uint8) + (total > hot)
            for bucket, a, _ in asked:
                f = flag[np.searchsorted(unique, a)]
                if f.any():
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([a[f > 0].tobytes()], pa.binary()), pa.array([f[f > 0].tobytes()], pa.binary())], ["bucket", "anchors", "flags"])

    # Every step that needs the texts groups them alike, so that they are dealt out once and the exchange is used again.
    asked = packed.groupBy("bucket").applyInArrow(settled(ask), "owner int, bucket int, anchors binary, counts binary")
    replies = asked.repartition(*parts, "owner").sortWithinPartitions("owner").mapInArrow(settled(reply), "bucket int, anchors binary, flags binary").repartition(*parts, "bucket")

    cut_schema = pa.schema([("key", pa.int64()), ("bucket", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("piece", pa.binary())])

    def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
        """What a bucket's sorted blocks tell: runs of later copies, as marks without a piece, and pieces of first ones by key."""
        if not told.num_rows:
            return cut_schema.empty_table()
        bucket = texts.column("bucket")[0].as_py()
        anchors = np.concatenate([np.frombuffer(a.as_py(), _U) for a in told.column("anchors")])
        order = np.argsort(anchors)
        anchors, flags = anchors[order], np.concatenate([np.frombuffer(f.as_py(), np.uint8) for f in told.column("flags")])[order]
        out: list[pa.RecordBatch] = []
        for data, ends, about in _chunks(_texts(texts)):
            a, lo, hi = segments(data, ends)
            at = np.minimum(np.searchsorted(anchors, a), len(anchors) - 1)
            pick = np.flatnonzero(anchors[at] == a)
            a, lo, hi, flag = a[pick], lo[pick], hi[pick], flags[at[pick]]
            mark = np.zeros(len(data) + 1, np.int32)
            mark[lo] = 1
            mark[hi + 1] -= 1
            begins = np.concatenate([[0], ends[:-1]])
            place = np.repeat(_ranked(about), ends - begins) << 20 | np.arange(len(data)) - np.repeat(begins, ends - begins)
            raw = data.tobytes()
            wanted = np.cumsum(mark[:-1]) > 0
            later = later_copies(_padded(raw), wanted, place)
            doc, tie, off = (np.array(c, np.int64) for c in zip(*about, strict=True))

            def told(key: np.ndarray, x: np.ndarray, n: np.ndarray, pieces: list, own: tuple = (doc, tie, off - begins, ends)) -> None:
                """Rows for the runs of n starts from x on."""
                part = np.searchsorted(own[3], x, "right")
                columns = [key, np.full(len(x), bucket), own[0][part], own[1][part], own[2][part] + x, n, pieces]
                out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, cut_schema, strict=True)], schema=cut_schema))

            x, y = _runs(later)
            told(np.zeros(len(x), np.int64), x, y - x, [None] * len(x))
            # Runs of first copies, cut where the anchor changes.
            first = wanted & ~later
            new = np.zeros(len(data) + 1, bool)
            new[lo] = True
            x = np.flatnonzero(first & (new[:-1] | ~np.concatenate([[False], first[:-1]])))
            y = np.flatnonzero(first & (new[1:] | ~np.concatenate([first[1:], [False]]))) + 1
            of = np.searchsorted(lo, x, "right") - 1
            hot_ones = flag[of] == 2
            cool = ~hot_ones
            told(a[of[cool]].view(np.int64), x[cool], y[cool] - x[cool], [raw[i : j + LENGTH - 1] for i, j in zip(x[cool].tolist(), y[cool].tolist(), strict=True)])
            # A hot anchor's strings one by one, by their own hash.
            x, y = x[hot_ones], y[hot_ones]
            x = np.repeat(x, y - x) + np.arange((y - x).sum()) - np.repeat(np.cumsum(y - x) - (y - x), y - x)
            strings = [raw[i : i + LENGTH] for i in x.tolist()]
            told(np.array([xxhash.xxh3_64_intdigest(s) for s in strings], _U).view(np.int64), x, np.ones(len(x), np.int64), strings)
        return pa.Table.from_batches(out, cut_schema)

    cuts = packed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(settled(cut), "key long, bucket int, doc long, tie long, start long, n int, piece binary")
    # Marks pass the sorting tasks by, dealt evenly; pieces meet by key.
    dealt = cuts.withColumn("key", F.when(F.col("piece").isNull(), F.xxhash64("doc", "start")).otherwise(F.col("key")))

    mark_schema = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, marks, key, limit, since = Pieces(), [], None, BLOCK, 0
        names = ("key", "bucket", "doc", "tie", "start", "n", "piece")
        for b in batches:
            bare = b.column("piece").is_null()
            known = b.filter(bare)
            if known.num_rows:
                yield known.select([f.name for f in mark_schema]).cast(mark_schema)
            rest = b.filter(pc.invert(bare))
            for row_key, bucket, doc, tie, start, n, piece in zip(*(rest.column(c).to_pylist() for c in names), strict=True):
                if pieces.bytes > limit:
                    # Whole groups are done with; of a group that goes on, the strings' first places stay.
                    told, pieces = pieces.solve(since if row_key == key else len(pieces.rows))
                    marks += told
                    limit, since = max(BLOCK, 2 * pieces.bytes), 0
                if row_key != key:
                    key, since = row_key, len(pieces.rows)
                pieces.add(bucket, doc, tie, start, n, piece)
            if len(marks) > 50_000:
                yield batch_of(marks, mark_schema)
                marks = []
        marks += pieces.solve(len(pieces.rows))[0]
        if marks:
            yield batch_of(marks, mark_schema)

    marks = dealt.repartition(*parts, "key").sortWithinPartitions("key").mapInArrow(settled(sort), "bucket int, doc long, tie long, start long, n int")
    return packed, marks.repartition(*parts, "bucket")


def write_counts(n: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more are 255 there and stand in 32 bits after all bytes."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u4").tobytes()


def read_counts(data: bytes, k: int) -> np.ndarray:
    """The `k` counts that write_counts wrote."""
    n = np.frombuffer(data[:k], np.uint8).astype(np.uint32)
    n[n == 255] = np.frombuffer(data[k:], "<u4")
    return n


def suffix_dedup(docs: DataFrame, texts: bool = False, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with `texts` the bytes left, too, as kept."""
    packed, marks = repeated_spans(docs, bucket_bytes, hot)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * texts)

    def remove(held: pa.Table, marked: pa.Table) -> pa.Table:
        """A bucket's texts without what its marks cover."""
        column = lambda c: marked.column(c).to_numpy()
        order = np.lexsort((column("tie"), column("doc")))
        doc, tie, start, n = (column(c)[order] for c in ("doc", "tie", "start", "n"))
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])) if len(doc) else np.empty(0, np.int64)
        spans = {(d, t): (a, b) for d, t, a, b in zip(doc[new].tolist(), tie[new].tolist(), new.tolist(), [*new[1:].tolist(), len(doc)], strict=False)}
        out = []
        for d, t, text in _texts(held):
            gone = np.zeros(len(text) + 1, np.int32)
            if (d, t) in spans:
                a, b = spans[d, t]
                gone += np.bincount(start[a:b], minlength=len(gone)).astype(np.int32)
                gone -= np.bincount(start[a:b] + n[a:b] + (LENGTH - 1), minlength=len(gone)).astype(np.int32)
            lost = np.cumsum(gone[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~lost].tobytes()
            runs = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if len(lost) else 0
            out.append((d if d != np.iinfo(np.int64).min else None, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), *[kept] * texts))
        return _rows(out, schema)

    return packed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(settled(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
