"""Exact search for windows that repeat across a corpus, of words or bytes, without a row for each window.

Every window has a minimiser: the smallest scrambled hash among its short grams. Consecutive windows with one minimiser travel
as one packed string to the minimiser's bucket; equal windows have equal minimisers, so all copies of a window meet there.
A batch first drops segments that it has seen whole (an earlier copy answers for them), packs the others by bucket and
compresses each pack, so that the shuffle has a few rows for each batch. What is found in a bucket goes back as covered
ranges to the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import eights, mix64, raw_bytes, sliding_min

LAST = (1 << 63) - 1
_A = np.uint64(0x9E3779B97F4A7C15)
#: Text whose segments a worker gathers before it packs them.
GATHERED = 24 << 20
#: Text whose grams are computed at once; their arrays stay in a core's cache.
READ = 1 << 16
#: Ids of several rows that are told to the executors; if there are more, every row is known by its text too.
REPEATED = 1000


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs."""
    return mix64(a * _A ^ mix64(b + _A))


@dataclass
class Units:
    """Words or bytes of a run of documents: where each begins and ends in data, and the hashes of its grams."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    grams: np.ndarray  # one for each start of a gram
    doc: np.ndarray  # document of each unit
    first: np.ndarray  # number of the first unit of each document


#: Makes units of the texts of documents, in order.
Reader = Callable[[list[bytes]], Units]


def runs(units: Units, window: int, per_window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run, its routing key, and where its minimiser stands after its first unit.

    The minimiser is the leftmost of a window's smallest grams; a run is of windows that share it in place.
    """
    n = len(units.starts) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    # 32 bits of order and 32 of place, however many units there are, so that equal windows of any two runs choose alike
    low = np.uint64((1 << 32) - 1)
    at = np.arange(len(units.grams), dtype=np.uint64)
    place = lambda g: (sliding_min(g & ~low | at, per_window)[:n] & low).astype(np.int64)
    pos = place(units.grams)
    ok = units.doc[:n] == units.doc[window - 1 :]
    split = (pos[1:] != pos[:-1]) | (units.doc[1:n] != units.doc[: n - 1]) | (ok[1:] != ok[:-1])
    key = units.grams[pos]
    if len(hot):
        spot = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        if (is_hot := hot[spot] == key).any():
            # windows of a frequent minimiser are dealt out by a second one, of another order
            second = mix64(units.grams ^ _A)
            other = place(second)
            key = np.where(is_hot, joined(key, second[other]), key)
            split |= key[1:] != key[:-1]
    change = np.flatnonzero(split) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [n - 1]])
    keep = ok[first]
    first = first[keep]
    return first, last[keep], key[first], pos[first] - first


def spans_bytes(start: np.ndarray, end: np.ndarray) -> bytes:
    """Union of [start, end) ranges, given in order of start, as pairs of 32-bit integers."""
    if not len(start):
        return b""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    stop = np.concatenate([reach[at[1:] - 1], reach[-1:]])
    return np.stack([start[at], stop], 1).astype(np.int32).tobytes()


def covered(blobs, n: int) -> np.ndarray:
    """Which of n units some range covers."""
    step = np.zeros(n + 1, np.int32)
    for b in blobs:
        pairs = np.frombuffer(b, np.int32).reshape(-1, 2)
        np.add.at(step, pairs[:, 0], 1)
        np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def leads(names: np.ndarray, ids: np.ndarray, start: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each byte string [begin, end) the number of its first copy, that of the smallest id and start; its own if there is none.

    Only those of one name are compared, each with its first; one that merely shares its name leads itself.
    """
    lead = np.arange(len(names))
    at = repeated(names)
    if not len(at):
        return lead
    at = at[np.lexsort((start[at], ids[at], names[at]))]
    head = np.concatenate([[True], names[at[1:]] != names[at[:-1]]])
    first = at[np.flatnonzero(head)[np.cumsum(head) - 1]]
    spots = zip(begin[at].tolist(), end[at].tolist(), begin[first].tolist(), end[first].tolist())
    same = np.fromiter((data[a:b] == data[c:d] for a, b, c, d in spots), np.bool_, len(at))
    lead[at[same]] = first[same]
    return lead


def repeated(names: np.ndarray) -> np.ndarray:
    """Where names stand that stand elsewhere too, by name."""
    order = np.argsort(names)
    own = names[order]
    same = own[1:] == own[:-1]
    keep = np.zeros(len(own), np.bool_)
    keep[1:] = same
    keep[:-1] |= same
    return order[keep]


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Documents in portions of about `limit` bytes, by id within each: order ids, row keys, texts."""
    ids, keys, texts, size = [], [], [], 0

    def portion():
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        return np.array(ids, np.int64)[order], np.array(keys, np.int64)[order], [texts[k] for k in order]

    for batch in batches:
        for did, key, text in zip(batch.column("did").to_pylist(), batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
            ids.append(did)
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield portion()
                ids, keys, texts, size = [], [], [], 0
    if texts:
        yield portion()


def planes(x: np.ndarray, kind: str = "<i4") -> bytes:
    """Integers, lowest bytes first, then the next and so on; small numbers leave planes of zeros."""
    x = x.astype(kind)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(body: bytes, n: int, at: int, kind: str = "<i4") -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, wide * n, at).reshape(wide, n).T).view(kind).ravel().astype(np.int64)


def pack(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, place: np.ndarray, slices: list[bytes]) -> bytes:
    """Segments of one bucket, by document and start."""
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    text = b"".join(slices)
    lengths = np.fromiter(map(len, slices), np.int64, len(slices))
    head = np.array([new.sum(), len(slices), len(text)], np.int64)
    body = b"".join([head.tobytes(), planes(np.diff(ids[new], prepend=0), "<i8"), keys[new].tobytes(), planes(new), planes(np.diff(start, prepend=0)), planes(lengths), place.astype(np.uint8).tobytes(), text])
    return np.int64(len(body)).tobytes() + pa.Codec("zstd", compression_level=5).compress(body, asbytes=True)


def unpack(blob: bytes):
    body = pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), asbytes=True)
    docs, n, size = (int(x) for x in np.frombuffer(body, np.int64, 3))
    at = 24
    ids, keys = np.cumsum(from_planes(body, docs, at, "<i8")), np.frombuffer(body, np.int64, docs, at + 8 * docs)
    at += 16 * docs
    new, start, lengths = (from_planes(body, n, at + 4 * n * k) for k in range(3))
    owner = np.cumsum(new) - 1
    return ids[owner], keys[owner], np.cumsum(start), lengths, np.frombuffer(body, np.uint8, n, at + 12 * n), body[at + 13 * n : at + 13 * n + size]


def order_id():
    """Column doc_id, with null as larger than all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


@dataclass
class Search:
    """What to look for: windows of `window` units with `per_window` grams each."""

    read: Reader
    window: int
    per_window: int
    judge: Callable  # of a bucket's segments: ids, keys, starts and ends of ranges that are to go
    same_document: bool  # whether an earlier window of the same document counts
    chunk: int
    bucket_bytes: int
    growth: float  # bytes of segments for each byte of text

    def repeated_ids(self, docs: DataFrame) -> list[int] | None:
        """Ids of more than one row, null as LAST; None if they are more than REPEATED."""
        found = docs.select(order_id().alias("did")).groupBy("did").count().where("count > 1").select("did").limit(REPEATED + 1).collect()
        return [r["did"] for r in found] if len(found) <= REPEATED else None

    def documents(self, docs: DataFrame, twice: list[int] | None) -> DataFrame:
        """Rows are known by id and, where several have one id, by text. Other keys are 0, as hashes would make up a sixth of the packs."""
        text = F.coalesce(F.col("text"), F.lit(""))
        key = F.xxhash64(text) if twice is None else F.when(order_id().isin(twice), F.xxhash64(text)).otherwise(F.lit(0)) if twice else F.lit(0)
        return docs.select("doc_id", order_id().alias("did"), key.cast("long").alias("key"), text.cast("binary").alias("data"))

    def cut_up(self, texts: list[bytes], hot: np.ndarray) -> tuple:
        """Text, and of the segments in it, by document and start: first byte, end, number of document, first unit, windows, routing key,
        place of the minimiser."""
        parts, data, base, k = [], [], 0, 0
        while k < len(texts):
            until, size = k, 0
            while until < len(texts) and (size < READ or until == k):
                size += len(texts[until])
                until += 1
            units = self.read(texts[k:until])
            first, last, key, place = runs(units, self.window, self.per_window, hot)
            owner = units.doc[first]
            parts.append((base + units.starts[first], base + units.ends[last + self.window - 1], k + owner, first - units.first[owner], last - first + 1, key, place))
            data.append(units.data)
            base += len(units.data)
            k = until
        return b"".join(data), *(np.concatenate(x) for x in zip(*parts))

    def hot(self, docs: DataFrame, raw: int, buckets: int, sample_bytes: int = 16 << 20) -> np.ndarray:
        """Minimisers of more than an eighth of a bucket's share of a bounded sample of documents. They only decide where windows are
        compared, as sampled bounds of ranges do; they change no result."""
        parts = max(1, raw // sample_bytes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, texts in chunks(batches, self.chunk):
                _, _, _, _, _, windows, key, _ = self.cut_up(texts, np.zeros(0, np.uint64))
                names, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, windows, len(names)).astype(np.int64)
                total = int(n.sum())
                keep = n * 16 * buckets > total
                yield pa.RecordBatch.from_arrays([pa.array(np.append(names[keep].view(np.int64), 0)), pa.array(np.append(n[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), total))], ["minimiser", "n", "total"])

        drawn = self.documents(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0) if parts > 1 else docs, [])
        counts = drawn.select("did", "key", "data").mapInArrow(run, "minimiser long, n long, total long").groupBy("minimiser").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        total = counts.agg(F.sum("total")).first()[0] or 0
        found = counts.where(F.col("n") * 8 * buckets > total).select("minimiser").collect()  # at most 8 * buckets
        return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))

    def ranges(self, docs: DataFrame, twice: list[int] | None) -> DataFrame:
        """did, key, spans: for documents with windows to go, ranges that cover them, in one or more rows."""
        raw = raw_bytes(docs)
        buckets = max(8, int(raw * self.growth / self.bucket_bytes) + 1)
        hot = docs.sparkSession.sparkContext.broadcast(self.hot(docs, raw, buckets))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, keys, texts in chunks(batches, GATHERED):
                data, begin, end, owner, start, windows, key, place = self.cut_up(texts, hot.value)
                del texts
                if not len(begin):
                    continue
                word, third = eights(np.frombuffer(data, np.uint8)), (end - begin) // 3
                names = key
                for spot in (begin, begin + third, end - 8 - third, end - 8):
                    names = mix64(names * _A ^ word[np.maximum(spot, begin)])
                # an earlier copy answers for a segment; repeats within a document may stay with their first one
                lead = leads(names, ids[owner], start, data, begin, end)
                again = ids[owner[lead]] < ids[owner]
                if self.same_document:
                    again |= (ids[owner[lead]] == ids[owner]) & (start[lead] < start)
                del word, third, names, lead
                if again.any():
                    who, a = owner[again], start[again]
                    b = a + windows[again] + self.window - 1
                    cut = np.flatnonzero(np.diff(who)) + 1
                    heads = np.concatenate([[0], cut])
                    blobs = [spans_bytes(x, y) for x, y in zip(np.split(a, cut), np.split(b, cut))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(heads)) % buckets, pa.int32()), pa.array(ids[who[heads]]), pa.array(keys[who[heads]]), pa.array(blobs, pa.binary())], ["bucket", "did", "key", "blob"])
                go = np.flatnonzero(~again)
                # by bucket, and in it by document and start, as they stand
                order = np.sort((mix64(key[go]) % np.uint64(buckets)) << np.uint64(32) | go.astype(np.uint64))
                bucket, order = (order >> np.uint64(32)).astype(np.int64), (order & np.uint64((1 << 32) - 1)).astype(np.int64)
                begin, end, owner, start, place = (x[order] for x in (begin, end, owner, start, place))
                at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(order)]])
                for k in range(0, len(at) - 1, 64):
                    ends = at[k : k + 65].tolist()
                    blobs = [pack(ids[owner[a:b]], keys[owner[a:b]], start[a:b], place[a:b], [data[x:y] for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())]) for a, b in zip(ends[:-1], ends[1:])]
                    none = pa.nulls(len(blobs), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]], pa.int32()), none, none, pa.array(blobs, pa.binary())], ["bucket", "did", "key", "blob"])

        def settle(group: pa.Table) -> pa.Table:
            local = group.filter(group["did"].is_valid())
            parts = [unpack(b) for b in group.filter(group["did"].is_null())["blob"].to_pylist()]
            out = [local.select(["did", "key", "blob"]).combine_chunks()]
            if parts:
                ids, keys, start, lengths, place = (np.concatenate([p[k] for p in parts]) for k in range(5))
                text = b"".join(p[5] for p in parts)
                del parts
                did, key, a, b = self.judge(ids, keys, start, lengths, place, text)
                if len(did):
                    order = np.lexsort((a, key, did))
                    did, key, a, b = did[order], key[order], a[order], b[order]
                    other = np.concatenate([[True], (did[1:] != did[:-1]) | (key[1:] != key[:-1])])
                    base = np.cumsum(other) << 32  # documents side by side
                    reach = np.maximum.accumulate(b + base)
                    apart = other.copy()
                    apart[1:] |= (a + base)[1:] > reach[:-1]
                    at = np.flatnonzero(apart)
                    last = np.append(at[1:], len(a)) - 1
                    pairs = np.stack([a[at], reach[last] - base[last]], 1).astype(np.int32)
                    first = np.flatnonzero(other)
                    ends = np.append(np.cumsum(apart)[first] - 1, len(at)).astype(np.int32) * 8
                    blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs.tobytes())])
                    out.append(pa.table({"did": did[first], "key": key[first], "blob": blobs}))
            return pa.concat_tables(out)

        routed = self.documents(docs, twice).select("did", "key", "data").mapInArrow(route, "bucket int, did long, key long, blob binary")
        return routed.groupBy("bucket").applyInArrow(settle, "did long, key long, blob binary")

    def apply(self, docs: DataFrame, finish: Callable, schema: str, names: list[str]) -> DataFrame:
        """finish(text bytes, blobs of ranges) -> values of `names` for each row of docs."""
        twice = self.repeated_ids(docs)
        ranges = self.ranges(docs, twice).groupBy("did", "key").agg(F.collect_list("blob").alias("blobs"))  # within one document
        kind = docs.schema["doc_id"].dataType.simpleString()

        def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = pa.Codec("zstd", compression_level=4)
            for batch in batches:
                data = [np.int64(len(d)).tobytes() + codec.compress(d, asbytes=True) for d in batch.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["doc_id", "did", "key", "data"])

        texts = self.documents(docs, twice).mapInArrow(shrink, f"doc_id {kind}, did long, key long, data binary")  # texts cross the shuffle compressed
        rows = texts.join(ranges, ["did", "key"], "left").select("doc_id", "data", "blobs")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds, codec = None, pa.Codec("zstd")
            for batch in batches:
                got = [finish(codec.decompress(d[8:], int(np.frombuffer(d[:8], np.int64)[0]), asbytes=True), b or []) for d, b in zip(batch.column("data").to_pylist(), batch.column("blobs").to_pylist(), strict=True)]
                kinds = kinds or [pa.string() if isinstance(v, str) else pa.binary() if isinstance(v, bytes) else pa.int64() for v in finish(b"", [])]
                columns = list(zip(*got, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", *names])

        return rows.mapInArrow(run, f"doc_id {kind}, {schema}")
