"""Substring deduplication on bytes: suffixes sorted to a fixed depth by bucket-pointer refinement, in parts of the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import eights, mix64, word_hashes
from .segments import LAST, Search, Units, covered, joined, leads, repeated

#: Bytes of a gram, 8 to 16.
GRAM = 8
#: Bytes of segments whose suffixes are sorted at once; those of one minimiser stay together.
SORTED = 1 << 20


def gram_names(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Scrambled names of grams by their first and last 8 bytes."""
    return mix64(low * np.uint64(0x9E3779B97F4A7C15) ^ (high << np.uint64(31) | high >> np.uint64(33)))


def read_bytes(texts: list[bytes]) -> Units:
    data = b"".join(texts)
    array = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.arange(len(array))
    eight = eights(array)[:-1].copy()
    grams = gram_names(eight[: len(array) - GRAM + 1], eight[GRAM - 8 : len(array) - 7]) if len(array) >= GRAM else eight[:0]
    return Units(data, at, at + 1, grams, np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes)


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, first byte highest, zeros behind the end."""
    return eights(data)[:-1].view(">u8").astype(np.uint64)


def split(key: np.ndarray, live: np.ndarray, start: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts `live` by key and sets each position's pointer to the last place of its bucket in the order of all suffixes; `start` is the
    place of each in ascending order. Positions that share their bucket, and their places."""
    order = np.argsort(key)
    live, key = live[order], key[order]
    last = np.append(key[1:] != key[:-1], True)
    ends = np.flatnonzero(last)
    sizes = np.diff(ends, prepend=-1)
    pointer[live] = np.repeat(start[ends], sizes)
    shared = np.repeat(sizes > 1, sizes)
    return live[shared], start[shared]


def bucket_pointers(data: np.ndarray, depth: int) -> np.ndarray:
    """For each position a number, equal for those whose next `depth` bytes are equal (zeros behind the end), ascending with the bytes.

    Bucket-pointer refinement: suffixes go to buckets by their first 8 bytes, and each points to the last place of its bucket. A pass
    sorts every bucket with several members by the buckets that these point to as far on as the buckets are deep, and sets the new
    pointers; so depth doubles, up to `depth`. Suffixes alone in their bucket are settled and leave.
    """
    n = len(data)
    pointer = np.zeros(n + depth, np.int64)
    pointer[n:] = -1
    live, place = split(words(data), np.arange(n), np.arange(n), pointer)
    reach = 8
    while reach < depth and len(live):
        step = min(reach, depth - reach)
        live, place = split(pointer[live] << 32 | pointer[live + step] + 1, live, place, pointer)
        reach += step
    return pointer[:n]


def judge_bytes(window: int):
    def judge(ids, keys, start, lengths, place, text):
        """Ranges of windows of a bucket that also start in a document of smaller id.

        A segment that a document of smaller id has whole goes whole, and what it holds is left to the other one; of those that repeat
        in one document, the first is judged. A window holds its minimiser, and on one side of it at least half of its other bytes. Segments of which no other document has the minimiser with
        that many bytes on either side can't match and are left out too. The suffixes of all others are sorted.
        """
        array = np.frombuffer(text, np.uint8)
        stops = np.cumsum(lengths)
        begin = stops - lengths
        lead = leads(word_hashes(array, begin, stops), ids, start, text, begin, stops)
        alone = lead == np.arange(len(lead))
        whole = np.flatnonzero(ids[lead] < ids)
        rest, again = np.flatnonzero(alone), np.flatnonzero(~alone & (ids[lead] == ids))
        middle = begin + place
        side = (window - GRAM + 1) // 2
        shared = np.zeros(len(ids), np.bool_)
        word = eights(array)
        for low, high in ((middle - side, middle + GRAM), (middle, middle + GRAM + side)):
            inside = rest[(low[rest] >= begin[rest]) & (high[rest] <= stops[rest])]
            a, b = low[inside], high[inside]
            name = word[a]
            for k in range(8, GRAM + side, 8):
                name = joined(name, word[np.minimum(a + k, b - 8)])
            twice = repeated(name)
            if not len(twice):
                continue
            name, inside = name[twice], inside[twice]
            new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            several = np.minimum.reduceat(ids[inside], new) != np.maximum.reduceat(ids[inside], new)
            shared[inside] |= np.repeat(several, np.diff(np.append(new, len(name))))
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        pick = np.flatnonzero(shared)
        gram = word[middle[pick]]
        order = np.argsort(gram, kind="stable")
        pick, gram = pick[order], gram[order]
        size = np.cumsum(lengths[pick])
        at = 0
        while at < len(pick):
            until = max(at + 1, int(np.searchsorted(size, size[at] - lengths[pick[at]] + SORTED, "right")))
            until = int(np.searchsorted(gram, gram[until - 1], "right"))
            some, at = pick[at:until], until
            seg, a, b = in_smaller(ids[some], lengths[some], [text[a:b] for a, b in zip(begin[some].tolist(), stops[some].tolist())])
            found.append((some[seg], a, b))
        seg, a, b = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(seg, kind="stable")
        seg, a, b = seg[order], a[order], b[order]
        low = np.searchsorted(seg, lead[again])
        n = np.searchsorted(seg, lead[again], "right") - low
        like = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        seg = np.concatenate([whole, seg, np.repeat(again, n)])
        a, b = np.concatenate([np.zeros(len(whole), np.int64), a, a[like]]), np.concatenate([lengths[whole], b, b[like]])
        return ids[seg], keys[seg], start[seg] + a, start[seg] + b

    def in_smaller(ids, lengths, slices):
        """Ranges of the windows of these segments that also stand in one of a document of smaller id: segments, starts and ends in them."""
        data = np.frombuffer(b"".join(slices), np.uint8)
        windows = lengths - window + 1
        seg = np.repeat(np.arange(len(ids)), windows)
        at = np.arange(len(seg)) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(windows) + windows, windows)
        bucket = bucket_pointers(data, window)[at]
        low = np.full(len(data), LAST)
        np.minimum.at(low, bucket, ids[seg])
        gone = ids[seg] > low[bucket]
        seg, at = seg[gone], at[gone]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1])])[: len(at)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        seg = seg[first]
        base = (np.cumsum(lengths) - lengths)[seg]
        return seg, at[first] - base, at[last] - base + window

    return judge


def dedup_bytes(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: each text's UTF-8 bytes without those that a string of `window` bytes
    covers which also starts in a document of smaller id.

    The corpus's suffixes are dealt out by the minimiser of their first `window` bytes, in packed segments, and sorted to that depth
    within each part. A null text has no bytes; texts shorter than a window keep all. A null doc_id is larger than all others.
    Rows that repeat an id are of one document and take nothing from each other; an empty table gives no rows; other columns
    are ignored.
    """
    search = Search(read_bytes, window, window - GRAM + 1, judge_bytes(window), False, 2 << 20, 10 << 20, 3.3)

    def finish(data: bytes, blobs: list[bytes]):
        if not blobs:
            return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data
        gone = covered(blobs, len(data))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        return len(data), len(data) - len(kept), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])), hashlib.sha256(kept).hexdigest(), kept

    return search.apply(docs, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
