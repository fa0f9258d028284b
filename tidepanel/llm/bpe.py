"""Byte-level BPE with a rank queue on a hierarchical bitmap: encoding and decoding of whole texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_memory, latest_per_worker


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_BIT = [1 << k for k in range(256)]


class RankQueue:
    """Positions by rank, lowest rank first and leftmost position first within it.

    A bitmap of two levels has one bit for each bucket that isn't empty, 256 to a word, and one for each such word; a find-first-set
    on either level gives the next rank. Words are made when first used, so that a queue for a short piece costs little.
    """

    __slots__ = ("buckets", "low", "top")

    def __init__(self):
        self.buckets: dict[int, int | list[int]] = {}
        self.low: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = at
            word = rank >> 8
            self.low[word] = self.low.get(word, 0) | _BIT[rank & 255]
            self.top |= 1 << word
        elif type(bucket) is int:
            self.buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is not int:
            at = heappop(bucket)
            if bucket:
                return rank, at
        else:
            at = bucket
        del self.buckets[rank]
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            self.top = top & (top - 1)
        return rank, at


class ByteBPE:
    """Encodes as tiktoken's encode_ordinary would with the same ranks and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 300_000):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token = {v: k for k, v in ranks.items()}
        self.kept: dict[str, bytes] = {}  # ids of recent pieces, and of those before
        self.older: dict[str, bytes] = {}
        self.keep = keep

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. Parts form a linked list; entries of the queue that no longer hold are skipped."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        get, queue = ranks.get, RankQueue()
        push, pop = queue.push, queue.pop
        after = list(range(1, n + 1))  # end of the part that starts here, the next part's start
        before = list(range(-1, n - 1))
        pair = [-1] * n  # the rank that the part at this start has with the next one
        live = 0  # how many of them there are; what else the queue holds is stale
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                live += 1
                push(r, i)
        while live:
            rank, i = pop()
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[j]
            if pair[j] >= 0:
                live -= 1
                pair[j] = -1
            after[i] = end
            if end < n:
                before[end] = i
                r = get(piece[i : after[end]])
                if r is None:
                    live -= 1
                    pair[i] = -1
                else:
                    pair[i] = r
                    push(r, i)
            else:
                live -= 1
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = get(piece[h:end])
                old = pair[h]
                if r is None:
                    live -= old >= 0
                    pair[h] = -1
                elif r != old:
                    live += old < 0
                    pair[h] = r
                    push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        kept, out = self.kept, []
        add = out.append
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = b"".join([i.to_bytes(4, "little") for i in self.merge(piece.encode())])
                if len(piece) <= 64:
                    if len(kept) >= self.keep:
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[piece] = ids
            add(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_packed(text)).cast("I"))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I")))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed), ids_sha256, decoded_sha256 of every row of docs, in one pass without a shuffle.

    A null text is the empty text: no tokens. Repeated rows give repeated results; a null doc_id stays null; an empty table
    gives no rows; other columns are ignored. A worker keeps one batch, the ranks and a bounded table of recent pieces.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))  # a vocabulary, whatever the data's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = latest_per_worker(("bpe", ranks_path, pattern), lambda: ByteBPE(ranks.value, pattern))
        for batch in batches:
            ids = [bpe.encode_packed(t or "") for t in batch.column("text").to_pylist()]
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        free_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
