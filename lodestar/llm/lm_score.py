"""Language-model scores by prediction by partial matching over bytes.

A text is read as a space, its words with a space after each, and an end. A byte's context is what stands before it,
up to ORDER bytes, across words. A trie of all contexts of the training texts, every occurrence counted, gives a
byte's probability: the longest context is tried first; where it has not seen the byte, its escape (method D) leads to
the next shorter one, and all symbols seen in longer contexts are excluded from it. Contexts nest, so the excluded set
of a context is what its one-byte-longer context has seen. After the empty context the symbols never seen share what
is left. The score is the pretrained code length: the sum of the log10 probabilities of all bytes and of the end; over
all texts the model's probabilities sum to one.

No table that grows with the corpus is broadcast or collected. Texts are dealt into buckets; each bucket asks for its
distinct grams (context and byte) and words from the tasks that own them, which sum up the buckets' counts. The trie's
branches, dealt by the last two bytes of the context, turn the owners' counts into log-probabilities; owners answer
the buckets, and buckets add grams to texts. The number of owners follows the size of the texts. Only the counts of
single bytes and of byte pairs, at most 65,792 numbers, go everywhere. A branch holds the distinct grams of its two
bytes, a number bounded by ORDER and the bytes in use, not by the corpus.

Cases: null, empty and blank texts are one end token; a null doc_id is not held out; no training text leaves the
uniform model, log10(256) a byte; rows that repeat are counted and scored one by one; texts and words of any length
are scored in full, a chunk at a time; no rows give no rows; other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, groups_of, settled, ship, staged, width_for

ORDER = 5
#: A key is length of context << LENGTH_AT | context << 8 | byte.
LENGTH_AT = 8 * (ORDER + 1)
BUCKET_BYTES = 32 << 20
#: Bytes of text for each owner, and for each partition of the shuffles.
OWNER_BYTES, PART_BYTES = 32 << 20, 64 << 20
#: Bytes whose grams are taken at a time.
CHUNK = 1 << 19
#: The end of a text as a token: no word has this byte.
END = b"\n"
FOLDS = 10


def tokens(data: bytes) -> list[bytes]:
    """Words of a text in lower case (A-Z alone), and its end."""
    return [*data.lower().split(), END]


def stream(words: list[bytes]) -> bytes:
    """What is coded of a text's tokens: all but its first byte, a space."""
    return b" " + b" ".join(words)


def grams(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key of each byte to predict, number of its stream, where each stream's keys begin), about CHUNK bytes at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for number, s in enumerate(streams):
        for at in range(1, len(s), CHUNK):
            begin = max(0, at - ORDER)
            held.append((number, at - begin, s[begin : at + CHUNK]))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield _keys(held)
                held, size = [], 0
    if held:
        yield _keys(held)


def _keys(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for *_, p in parts), np.uint8).astype(np.int64)
    size, lead = np.array([len(p) for *_, p in parts]), np.array([n for _, n, _ in parts])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(data)) - np.repeat(first, size)
    keep = np.flatnonzero(place >= np.repeat(lead, size))
    key = np.zeros(len(data), np.int64)
    for back in range(ORDER, -1, -1):
        key <<= 8
        key[back:] |= data[: len(data) - back]
    # Near a stream's start the context is shorter than what stands before.
    length = np.minimum(place, ORDER)
    early = np.flatnonzero(length < ORDER)
    key[early] &= (np.int64(1) << 8 * (length[early] + 1)) - 1
    key |= length << LENGTH_AT
    return key[keep], np.array([n for n, *_ in parts]), np.concatenate([[0], np.cumsum(size - lead)[:-1]])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique))


class _Sum:
    """Counts of keys, added up now and then, so that it holds no more than some millions beyond the distinct ones."""

    def __init__(self) -> None:
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._new = self._base = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._keys.append(keys)
        self._counts.append(counts)
        self._new += len(keys)
        if self._new > max(2_000_000, self._base):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct keys, counts)."""
        keys, counts = np.concatenate([*self._keys, np.empty(0, np.int64)]), np.concatenate([*self._counts, np.empty(0, np.int64)])
        unique, n = _summed(keys, counts)
        self._keys, self._counts = [unique], [n.astype(np.int64)]
        self._new, self._base = 0, len(unique)
        return unique, self._counts[0]


class Table:
    """Values by key in a table with open addressing, filled and asked by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (2 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.empty(1 << bits)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[left[free]]
            # Of several keys that found a slot free, one has it.
            has = self._keys[at] == keys[left]
            self._values[at[has]] = values[left[has]]
            left = left[~has]
            slot[left] = slot[left] + 1 & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The values of keys that are all in the table."""
        slot = self._slots(wanted)
        out = self._values[slot]
        left = np.flatnonzero(self._keys[slot] != wanted)
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self._mask
            found = self._keys[slot] == wanted[left]
            out[left[found]] = self._values[slot[found]]
            left, slot = left[~found], slot[~found]
        return out


def _look(unique: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(unique):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(unique, keys), len(unique) - 1)
    return np.where(unique[at] == keys, values[at], 0)


def ppm(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """log10 probability of each key, given the training counts of all keys that share the last two bytes of the context.

    pairs[b, s] and singles[s] are the counts of byte s after byte b and at all.
    """
    length, context, symbol = keys >> LENGTH_AT, keys >> 8 & (1 << 8 * ORDER) - 1, keys & 255
    seen_keys: dict[int, tuple] = {}
    for m in range(ORDER, 1, -1):
        use = (length >= m) & (counts > 0)
        k, c = _summed((context[use] & (1 << 8 * m) - 1) << 8 | symbol[use], counts[use])
        own, total = _summed(k >> 8, c)
        seen_keys[m] = (k, c, own, total, np.bincount(np.searchsorted(own, k >> 8), minlength=len(own)) if len(k) else total)

    def count(m: int, ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
        if m > 1:
            k, c, *_ = seen_keys[m]
            return _look(k, c, (ctx & (1 << 8 * m) - 1) << 8 | sym)
        return pairs[ctx & 255, sym] if m else singles[sym]

    def totals(m: int, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if m > 1:
            _, _, own, total, distinct = seen_keys[m]
            at = ctx & (1 << 8 * m) - 1
            return _look(own, total, at), _look(own, distinct, at)
        if m:
            return pairs.sum(1)[ctx & 255], (pairs > 0).sum(1)[ctx & 255]
        return np.full(len(ctx), singles.sum()), np.full(len(ctx), (singles > 0).sum())

    def excluded(m: int, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, in the context of m bytes, of the symbols that the context of m + 1 bytes has seen; and their number."""
        if m + 1 > 1:
            k, _, own, _, distinct = seen_keys[m + 1]
            if not len(k):
                return np.zeros(len(ctx)), np.zeros(len(ctx))
            lost = np.bincount(np.searchsorted(own, k >> 8), count(m, k >> 8, k & 255), len(own))
            at = ctx & (1 << 8 * (m + 1)) - 1
            return _look(own, lost, at), _look(own, distinct, at)
        has = pairs > 0
        return (has @ singles)[ctx & 255], has.sum(1)[ctx & 255]

    out, still = np.zeros(len(keys)), np.ones(len(keys), bool)
    for m in range(ORDER, -1, -1):
        at = np.flatnonzero(still & (length >= m))
        if not len(at):
            continue
        ctx, sym = context[at], symbol[at]
        total, distinct = totals(m, ctx)
        longer = length[at] > m
        if longer.any() and m < ORDER:
            lost, fewer = excluded(m, ctx)
            total, distinct = total - np.where(longer, lost, 0), distinct - np.where(longer, fewer, 0)
        c = count(m, ctx, sym)
        open_ = distinct > 0
        hit = open_ & (c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at] += np.where(hit, np.log10((2 * c - 1) / (2 * total)), np.where(open_, np.log10(distinct / (2 * total)), 0))
        still[at[hit]] = False
    unseen = 256 - int((singles > 0).sum())
    out[still] -= np.log10(max(unseen, 1))
    return out


def lm_scores(docs: DataFrame, held, bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:  # noqa: ANN001
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; `held` is the column that keeps a row out of training."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners, buckets = max(1, -(-size // owner_bytes)), max(1, -(-size // bucket_bytes))
    width = width_for(spark, size, PART_BYTES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket")
    rows = docs.select("doc_id", held.alias("held_out"), bucket, F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for b in batches:
            data = pa.array([press.compress(t.as_py().encode().lower()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("bucket"), data], ["doc_id", "held_out", "bucket", "data"])

    packed = rows.mapInArrow(settled(pack), f"doc_id {kind}, held_out boolean, bucket int, data binary")

    def dealt(df: DataFrame, key: str, *then: str) -> DataFrame:
        """Rows by key; more partitions than the session's where the texts are many."""
        parts = [width] if width_for(spark, 0, 1) < width else []
        return df.repartition(*parts, key).sortWithinPartitions(key, *then)

    ask_schema = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("times", pa.binary())])
    ask_ddl = "owner int, bucket int, words binary, counts binary, grams binary, times binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each bucket's distinct words and grams, with their training counts, by owner."""
        unpress = zstandard.ZstdDecompressor()
        for bucket, slices in groups_of(batches, "bucket"):
            known: Counter = Counter()
            other: set[bytes] = set()
            seen = _Sum()
            for b in slices:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    streams: dict[bool, list[bytes]] = {True: [], False: []}
                    for out, data in zip(part.column("held_out").to_pylist(), part.column("data"), strict=True):
                        words = tokens(unpress.decompress(data.as_py()))
                        (other if out else known).update(words)
                        streams[out].append(stream(words))
                    for out, listed in streams.items():
                        for keys, *_ in grams(listed):
                            unique, n = np.unique(keys, return_counts=True)
                            seen.add(unique, n * (not out))
            words = list(known) + [w for w in other if w not in known]
            of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % owners
            count = np.zeros(len(words), np.int64)
            count[: len(known)] = np.fromiter(known.values(), np.int64, len(known))
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(owners + 1))
            keys, times = seen.total()
            gram_of = owner_of(keys, owners)
            gram_order = np.argsort(gram_of, kind="stable")
            gram_cut = np.searchsorted(gram_of[gram_order], np.arange(owners + 1))
            for o in range(owners):
                own, mine = order[cut[o] : cut[o + 1]], gram_order[gram_cut[o] : gram_cut[o + 1]]
                if len(own) or len(mine):
                    yield batch_of([(o, bucket, b" ".join([words[i] for i in own]), count[own].tobytes(), keys[mine].tobytes(), times[mine].tobytes())], ask_schema)

    asked = staged(dealt(packed, "bucket").mapInArrow(settled(ask), ask_ddl), "asked")

    own_schema = pa.schema([("owner", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64()), ("grams", pa.binary()), ("times", pa.binary())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of what all buckets count."""
        for owner, slices in groups_of(batches, "owner"):
            total: dict[bytes, int] = {}
            seen = _Sum()
            for b in slices:
                for words, counts, keys, times in zip(*(b.column(c) for c in ("words", "counts", "grams", "times")), strict=True):
                    for w, c in zip(_words(words.as_py()), np.frombuffer(counts.as_py(), np.int64).tolist(), strict=True):
                        total[w] = total.get(w, 0) + c
                    seen.add(np.frombuffer(keys.as_py(), np.int64), np.frombuffer(times.as_py(), np.int64))
            c = np.fromiter(total.values(), np.int64, len(total))
            keys, times = seen.total()
            yield batch_of([(owner, b" ".join(total), c.tobytes(), int(c.sum()), int((c > 0).sum()), keys.tobytes(), times.tobytes())], own_schema)

    owned = staged(dealt(asked, "owner").mapInArrow(settled(own), "owner int, words binary, counts binary, n long, distinct long, grams binary, times binary"), "owned")
    totals = owned.agg(F.sum("n"), F.sum("distinct")).first()
    n_train, n_distinct = totals[0] or 0, totals[1] or 0

    gram_schema = pa.schema([("owner", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owner, keys, times in zip(b.column("owner").to_pylist(), b.column("grams"), b.column("times"), strict=True):
                k, n = np.frombuffer(keys.as_py(), np.int64), np.frombuffer(times.as_py(), np.int64)
                for at in range(0, len(k), 100_000):
                    part = k[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), owner, np.int32)), pa.array(part), pa.array(n[at : at + 100_000])], schema=gram_schema)

    counted = owned.select("owner", "grams", "times").mapInArrow(settled(to_rows), "owner int, gram long, n long")
    # Two dense tables of fixed size: 256 by 256 pairs of bytes, and 256 bytes.
    pairs = np.zeros((256, 256))
    for r in counted.groupBy(F.expr("shiftright(gram, 8) & 255").alias("b"), F.expr("gram & 255").alias("s")).agg(F.sum("n").alias("n")).where("n > 0").collect():
        pairs[r["b"], r["s"]] = r["n"]
    singles = pairs.sum(0)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in groups_of(batches, "branch"):
            parts = list(slices)
            owner, keys, n = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("owner", "gram", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(keys), pa.array(ppm(keys, n.astype(float), pairs, singles))], ["owner", "gram", "logp"])

    by_branch = counted.withColumn("branch", F.expr(f"if(shiftright(gram, {LENGTH_AT}) = 1, -1L, shiftright(gram, 8) & 65535)"))
    trie = staged(dealt(by_branch, "branch").mapInArrow(settled(branch), "owner int, gram long, logp double"), "trie")

    reply_schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("logps", pa.binary())])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per owner: its grams with their values (kind 0), its words (kind 1), then the buckets' questions (kind 2)."""
        for _, slices in groups_of(batches, "owner"):
            index: dict[bytes, int] = {}
            count = np.empty(0, np.int64)
            told: list[tuple[np.ndarray, np.ndarray]] = []
            keys = values = None
            for b in slices:
                kinds = b.column("kind").to_numpy()
                cut = int(np.searchsorted(kinds, 1))
                if cut:
                    told.append((b.column("gram").to_numpy(zero_copy_only=False)[:cut].astype(np.int64), b.column("logp").to_numpy(zero_copy_only=False)[:cut]))
                rest = b.slice(cut)
                for kind_, bucket, words, counts, asks in zip(rest.column("kind").to_pylist(), rest.column("bucket").to_pylist(), *(rest.column(c) for c in ("words", "counts", "grams")), strict=True):
                    listed = _words(words.as_py())
                    if kind_ == 1:
                        index, count = {w: i for i, w in enumerate(listed)}, np.frombuffer(counts.as_py(), np.int64)
                        continue
                    if keys is None:
                        keys, values = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.empty(0, np.int64), np.empty(0))
                        order = np.argsort(keys)
                        keys, values = keys[order], values[order]
                    at = np.fromiter(map(index.__getitem__, listed), np.int64, len(listed))
                    wanted = np.frombuffer(asks.as_py(), np.int64)
                    yield batch_of([(bucket, words.as_py(), count[at].tobytes(), asks.as_py(), values[np.searchsorted(keys, wanted)].tobytes())], reply_schema)

    none = lambda c, t: F.lit(None).cast(t).alias(c)
    lit = lambda n: F.lit(n).alias("kind")
    told = trie.select("owner", lit(0), none("bucket", "int"), none("words", "binary"), none("counts", "binary"), none("grams", "binary"), "gram", "logp")
    told = told.unionByName(owned.select("owner", lit(1), none("bucket", "int"), "words", "counts", none("grams", "binary"), none("gram", "long"), none("logp", "double")))
    told = told.unionByName(asked.select("owner", lit(2), "bucket", "words", none("counts", "binary"), "grams", none("gram", "long"), none("logp", "double")))
    replies = dealt(told, "owner", "kind").mapInArrow(settled(reply), "bucket int, words binary, counts binary, grams binary, logps binary")

    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bucket: the owners' replies (kind 0), then the texts (kind 1)."""
        unpress = zstandard.ZstdDecompressor()
        floor = np.log10(n_train + 0.1 * (n_distinct + 1))
        for _, slices in groups_of(batches, "bucket"):
            index: dict[bytes, int] = {}
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            keys = None
            for b in slices:
                cut = int(np.searchsorted(b.column("kind").to_numpy(), 1))
                for words, c, k, p in zip(*(b.slice(0, cut).column(x) for x in ("words", "counts", "grams", "logps")), strict=True):
                    for w in _words(words.as_py()):
                        index[w] = len(index)
                    got.append((np.frombuffer(c.as_py(), np.int64), np.frombuffer(k.as_py(), np.int64), np.frombuffer(p.as_py(), np.float64)))
                if cut == b.num_rows:
                    continue
                if keys is None:
                    count, keys, logp = (np.concatenate(x) for x in zip(*got, strict=True))
                    values, got = Table(keys, logp), []
                    known, base = count > 0, np.log10(count + 0.1) - floor
                for at in range(cut, b.num_rows, 500):
                    texts = b.slice(at, 500)
                    sums, streams = [], []
                    for data in texts.column("data"):
                        words = tokens(unpress.decompress(data.as_py()))
                        place = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                        sums.append((len(words), int(known[place].sum()), n_train, float(base[place].sum())))
                        streams.append(stream(words))
                    score = np.zeros(len(streams))
                    for wanted, number, begin in grams(streams):
                        np.add.at(score, number, np.add.reduceat(values(wanted), begin))
                    cols = list(zip(*sums, strict=True))
                    yield pa.RecordBatch.from_arrays([texts.column("doc_id"), texts.column("held_out"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64()), pa.array(score)], out_names)

    two = replies.select("bucket", lit(0), "words", "counts", "grams", "logps", none("doc_id", kind), none("held_out", "boolean"), none("data", "binary")).unionByName(
        packed.select("bucket", lit(1), none("words", "binary"), none("counts", "binary"), none("grams", "binary"), none("logps", "binary"), "doc_id", "held_out", "data")
    )
    return dealt(two, "bucket", "kind").mapInArrow(settled(add), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners of grams, even whatever the grams."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)


def _words(joined: bytes) -> list[bytes]:
    return joined.split(b" ") if joined else []
