"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when each token encodes to itself and each
neighbouring pair encodes to itself. That makes a nondeterministic transducer: its states are (last
token, place in the vocabulary's trie); on reaching the end of a token that may stand after the last
one, it writes the token and goes back to the trie's root. Every prefix of a piece has one encoding, so
at most one thread stands at the root, and a piece ends there. The transducer is determinised while it
runs: a deterministic state is the set of threads, each with the output that not all threads share.
What all share is written at once, which bounds the lookahead by the longest token. Transitions are kept
by (state, byte); beyond MAX_STATES they are forgotten and found anew, so memory is bounded.

Decoding runs an incremental UTF-8 state machine over the tokens; what it writes is what is told of the decoded text.

Cases: null and empty texts have no tokens; no cap on a text's or a piece's length; no rows give no rows; other
columns may have any name; rows are encoded one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.common import settled, ship

MAX_STATES = 140_000
MAX_PIECES = 300_000
MAX_PAIRS = 350_000
FEW = 1
#: Tokens decoded at a time.
CHUNK = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.of = {rank: token for token, rank in ranks.items()}
        self._child: dict[int, int] = {}
        self._token = [-1]
        self._inner = [False]
        halves: dict[bytes, tuple[bytes, bytes]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._join(token, 2)
                if len(parts) > 2:
                    continue  # no text ever encodes to it
                halves[token] = (parts[0], parts[1])
            node = 0
            for b in token:
                key = node << 8 | b
                self._inner[node] = True
                if key not in self._child:
                    self._child[key] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(False)
                node = self._child[key]
            self._token[node] = rank
        #: Whether merges happen in the order of their ranks, as in every trained vocabulary.
        self._ordered = all(max(ranks[a], ranks[b]) < ranks[t] for t, (a, b) in halves.items() if len(t) > 2)
        #: The tokens under a node, where they are few: a thread none of whose tokens may follow the last one is dropped at once.
        self._under: dict[int, list[int]] = {}
        for token in halves:
            node = 0
            for b in token[:-1]:
                node = self._child[node << 8 | b]
                self._under.setdefault(node, []).append(ranks[token])
        self._under = {node: tokens for node, tokens in self._under.items() if len(tokens) <= FEW}
        #: Of two neighbouring tokens the one that they make together, by the first and the second.
        self._joins: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self._joins.setdefault(a, {})[b] = rank
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._halves = halves
        self._packed = {rank: struct.pack("<I", rank) for rank in ranks.values()}
        self._pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((-1, 0, ()),)
        self._ids = {start: 0}
        self._states = [start]
        self._step: dict[int, tuple[int, bytes]] = {}

    def _join(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The definition: join the neighbours of the lowest rank, the leftmost first, until none can be joined or `until` are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(joined)
            if low == 1 << 60:
                break
            at = joined.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, side: int, kept: dict[int, list]) -> list[tuple[int, int, int]]:
        """The parts that stand at one end of a token while it is built: (part, rank at which it is made, rank at which it is joined)."""
        if token not in kept:
            part, joined, out = self.of[token], 1 << 60, []
            while True:
                made = self.ranks[part] if len(part) > 1 else -1
                out.append((self.ranks[part], made, joined))
                if len(part) == 1:
                    break
                joined, part = self.ranks[part], self._halves[part][side]
            kept[token] = out
        return kept[token]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether last and token together encode to themselves: no part at the end of one joins a part at the start of the other."""
        key = last << 32 | token
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            if self._ordered:
                known, starts = True, self._left.get(token) or self._spine(token, 0, self._left)
                for a, made, until in self._right.get(last) or self._spine(last, 1, self._right):
                    joins = self._joins.get(a)
                    if not joins:
                        continue
                    for b, made_b, until_b in starts:
                        rank = joins.get(b)
                        # On a tie the leftmost is joined first: the joint before the one inside token, after the one inside last.
                        if rank is not None and max(rank, made, made_b) < until and max(rank, made, made_b) <= until_b:
                            known = False
                            break
                    if not known:
                        break
            else:
                known = self._join(self.of[last] + self.of[token]) == [self.of[last], self.of[token]]
            self._pairs[key] = known
        return known

    def _advance(self, state: int, byte: int) -> tuple[int, bytes]:
        threads, child, tokens, inner, under = [], self._child, self._token, self._inner, self._under
        shared: tuple | None = None
        for last, node, out in self._states[state]:
            node = child.get(node << 8 | byte, 0)
            if not node:
                continue
            token = tokens[node]
            if token >= 0 and (last < 0 or self._may_follow(last, token)):
                ended = (*out, token)
                threads.append((token, 0, ended))
                shared = ended if shared is None else shared and self._prefix(shared, ended)
            if inner[node]:
                if last >= 0 and node in under:
                    for t in under[node]:
                        if self._may_follow(last, t):
                            break
                    else:
                        continue
                threads.append((last, node, out))
                shared = out if shared is None else shared and self._prefix(shared, out)
        written = b""
        if shared:
            n = len(shared)
            written = b"".join([self._packed[t] for t in shared])
            threads = [(last, node, out[n:]) for last, node, out in threads]
        key = tuple(threads)
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
        found = self._step[state << 8 | byte] = (to, written)
        return found

    @staticmethod
    def _prefix(a: tuple, b: tuple) -> tuple:
        """What both begin with."""
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        return a[:n]

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        if len(self._states) > MAX_STATES:
            self._forget()
        state, step, out = 0, self._step, []
        for b in piece:
            found = step.get(state << 8 | b) or self._advance(state, b)
            state, written = found
            if written:
                out.append(written)
        for _, node, rest in self._states[state]:
            if not node:
                out += [self._packed[t] for t in rest]
                break
        return b"".join(out)


class _Pieces(dict):
    """Encoded pieces by text, in two generations: when the young one is full it becomes the old one, and what is used again comes back."""

    def __init__(self, encode) -> None:  # noqa: ANN001
        super().__init__()
        self._encode, self._old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        out = self._old.get(piece)
        if out is None:
            out = self._encode(piece.encode())
            if len(piece) >= 64:
                return out
        if len(self) >= MAX_PIECES:
            self._old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Utf8Stream:
    """Incremental UTF-8 decoding by a state machine over bytes, in steps of whole tokens.

    The state is the start of an unfinished character, at most three bytes; ill-formed bytes become U+FFFD, one for
    each longest start of a character. What a token's bytes write in a state is found once and kept.
    """

    def __init__(self, tokens: list[bytes] | None = None) -> None:
        self._tokens = tokens or []
        #: The text of each token that is whole characters; None for the others.
        self._whole = [self._run(b"", t) for t in self._tokens]
        self._plain = [text if not rest else None for text, rest in self._whole]
        self._steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self._open = b""

    @staticmethod
    def _follows(start: bytes, byte: int) -> bool:
        """Whether `byte` may come after the start of a character."""
        if len(start) == 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(start[0], (0x80, 0xBF))
            return low <= byte <= high
        return 0x80 <= byte <= 0xBF

    @classmethod
    def _run(cls, held: bytes, data: bytes) -> tuple[str, bytes]:
        """(text written, start of a character that is left) of `data` after the start `held`."""
        out = []
        for byte in data:
            if held and cls._follows(held, byte):
                held += bytes([byte])
                lead = held[0]
                if len(held) == (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    bits = lead & (0x3F >> len(held) - 1)
                    for b in held[1:]:
                        bits = bits << 6 | b & 0x3F
                    out.append(chr(bits))
                    held = b""
                continue
            if held:
                out.append("\ufffd")
                held = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                held = bytes([byte])
            else:
                out.append("\ufffd")
        return "".join(out), held

    def feed(self, chunk: bytes) -> str:
        text, self._open = self._run(self._open, chunk)
        return text

    def feed_tokens(self, ids: list[int]) -> str:
        """The text that the next tokens complete."""
        plain = [self._plain[i] for i in ids]
        if not self._open and None not in plain:
            return "".join(plain)
        out, held = [], self._open
        for i, text in zip(ids, plain, strict=True):
            if held or text is None:
                step = self._steps.get((held, i))
                if step is None:
                    step = self._steps[held, i] = self._run(held, self._tokens[i])
                text, held = step
            out.append(text)
        self._open = held
        return "".join(out)

    def close(self) -> str:
        rest, self._open = self._open, b""
        return "\ufffd" if rest else ""


class Codec:
    """Encodes whole texts and decodes ids, for one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.transducer = Transducer(ranks)
        self._split = regex.compile(pattern).findall
        self._pieces = _Pieces(self.transducer.encode)
        self._stream = Utf8Stream([self.transducer.of.get(i, b"") for i in range(max(ranks.values()) + 1)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._split(text)))

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text of the ids, a chunk at a time."""
        for at in range(0, len(ids), 4 * CHUNK):
            yield self._stream.feed_tokens(np.frombuffer(ids[at : at + 4 * CHUNK], "<u4").tolist())
        yield self._stream.close()

    def text(self, ids: bytes) -> str:
        return "".join(self.decode(ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python process."""
    common.KEPT["byte_bpe"] = _CODECS.clear
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars (code points decoded) of every row; with `ids`, token_ids too.

    `path` is a vocabulary of ranks that is installed on every machine.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"] + ["token_ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                packed = own.encode(text.as_py() or "")
                digest, chars = hashlib.sha256(), 0
                for chunk in own.decode(packed):
                    digest.update(chunk.encode())
                    chars += len(chunk)
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), digest.hexdigest(), chars, packed if ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())]
            if ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype("i4") for p in cols[4]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(settled(run, "byte_bpe"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long" + ", token_ids array<int>" * ids)
