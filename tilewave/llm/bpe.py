"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by the tokenizer's pattern; each piece is encoded on its own. A piece's tokens are
reduced over a binary tree of its bytes: both halves are encoded, then joined. The join encodes a
window around the border afresh and widens it until the token pairs at the window's two edges are
stable, that is, encode(a + b) == [a, b]. A sequence is the BPE encoding of its bytes exactly if
each adjacent pair is stable, and the pairs outside the window were so before, so the tokens outside
need no second look. Joining is associative, with the empty sequence as its neutral element.
Decoding concatenates the tokens' bytes up the same tree.

Edge cases: a null or empty text has no tokens, and decodes to the empty text. Repeated rows give
repeated results. An empty table gives an empty table. Very long texts are held whole, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file above this many bytes isn't broadcast: no public vocabulary is near it.
MAX_VOCABULARY_BYTES = 32 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class BpeMonoid:
    """leaf_bytes: pieces up to this size are merged at once; longer ones are halved."""

    #: Entries of the caches, which are emptied when full: memory is bounded whatever the texts.
    CACHE = 150_000

    def __init__(self, ranks: dict[bytes, int], leaf_bytes: int = 48):
        self.ranks, self.leaf_bytes = ranks, leaf_bytes
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merges of the lowest rank first, the leftmost of equals, over a short piece."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        get, none = ranks.get, len(self.tokens) + 256
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) >= self.CACHE:
                self._stable.clear()
            known = self._stable[key] = self.leaf_pair(a, b) == [a, b]
        return known

    def leaf_pair(self, a: int, b: int) -> list[int]:
        return self.leaf(self.tokens[a] + self.tokens[b])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        i, j = min(2, len(left)), min(2, len(right))
        while True:
            data = b"".join(self.tokens[t] for t in left[len(left) - i :] + right[:j])
            middle = self.merge_all(data)
            left_ok = i == len(left) or self.stable(left[-i - 1], middle[0])
            right_ok = j == len(right) or self.stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + middle + right[j:]
            i = i if left_ok else min(2 * i, len(left))
            j = j if right_ok else min(2 * j, len(right))

    def merge_all(self, data: bytes) -> list[int]:
        """The merges over a window, with a heap as a window can be long."""
        if len(data) <= self.leaf_bytes:
            return self.leaf(data)
        import heapq

        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self.leaf(piece) if piece else []
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 64:
            return b"".join(self.tokens[i] for i in ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: One coder for all tasks of a worker, by a digest of its vocabulary and pattern.
_CODERS: dict[bytes, Callable[[str], tuple[int, str, bytes]]] = {}


def shared_coder(data: bytes, pattern: str) -> Callable[[str], tuple[int, str, bytes]]:
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = text_coder(read_ranks(data), pattern)
    return _CODERS[key]


def text_coder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], tuple[int, str, bytes]]:
    """text -> number of ids, ids joined by spaces, decoded bytes."""
    import regex

    monoid, find = BpeMonoid(ranks), regex.compile(pattern).findall
    known: dict[str, tuple[int, str, bytes]] = {}

    def piece_of(piece: str) -> tuple[int, str, bytes]:
        ids = monoid.encode(piece.encode())
        out = (len(ids), " ".join(map(str, ids)), monoid.decode(ids))
        if len(piece) <= 40:
            if len(known) >= monoid.CACHE:
                known.clear()
            known[piece] = out
        return out

    def coded(text: str) -> tuple[int, str, bytes]:
        get = known.get
        parts = [get(p) or piece_of(p) for p in find(text)]
        if not parts:
            return 0, "", b""
        counts, ids, data = zip(*parts)
        return sum(counts), " ".join(ids), b"".join(data)

    return coded


def _broadcast_ranks(docs: DataFrame, vocabulary_path: str):
    with open(vocabulary_path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_path} has over {MAX_VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(data)


def bpe_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, token_ids (array of int), decoded (string). Null texts have no tokens."""
    return _coded(docs, vocabulary_path, pattern, id_col, text_col, "doc_id long, token_ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256, all of the whole text."""
    return _coded(docs, vocabulary_path, pattern, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _coded(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str, text_col: str, schema: str) -> DataFrame:
    shipped = _broadcast_ranks(docs, vocabulary_path)
    digests = "n_tokens" in schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = shared_coder(shipped.value, pattern)
        for batch in batches:
            texts = batch.column(1)
            rows = [coded(texts[i].as_py()) for i in range(len(texts))] if not digests else None
            if digests:
                out = []
                for i in range(len(texts)):
                    n, ids, data = coded(texts[i].as_py())
                    out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
                n, a, b = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = [[int(x) for x in r[1].split()] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([r[2].decode() for r in rows], pa.string())], ["doc_id", "token_ids", "decoded"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, schema)
