"""Substring deduplication on word windows with super-k-mer partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import spaced, word_bounds, word_hashes
from .segments import Search, Units, covered, joined

GRAM = 3


def read_words(texts: list[bytes]) -> Units:
    data = spaced(b" ".join(texts))
    array = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(array)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    h = word_hashes(array, starts, ends)
    grams = joined(joined(h[:-2], h[1:-1]), h[2:]) if len(h) > 2 else h[:0]
    return Units(data, starts, ends, grams, np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(starts, offsets))


def window_names(h: np.ndarray, window: int) -> np.ndarray:
    """Names of windows by doubling; len(h) - window + 1 of them."""
    out, span = h, 1
    while 2 * span <= window:
        out = joined(out[:-span], out[span:])
        span *= 2
    if span < window:
        rest = window - span
        out = joined(out[:-rest], out[rest:])
    return out


def judge_words(window: int):
    def judge(ids, keys, start, lengths, place, text):
        """Windows of a bucket that also start earlier. Window names are sorted; equal names are held against the words themselves."""
        stops = np.cumsum(lengths)
        begin = stops - lengths
        array = np.frombuffer(text, np.uint8)
        # segments stand side by side: a word ends where its segment does
        word = np.zeros(len(array) + 1, np.bool_)
        word[:-1] = array != 0x20
        edge = np.zeros(len(array) + 1, np.bool_)
        edge[begin] = True
        before = np.concatenate([[False], word[:-2]]) if len(array) else word[:0]
        starts = np.flatnonzero(word[:-1] & (~before | edge[:-1]))
        ends = np.flatnonzero(word[:-1] & (~word[1:] | np.concatenate([edge[1:-1], [True]]))) + 1
        h = word_hashes(array, starts, ends)
        seg = np.searchsorted(stops, starts, "right")
        first = np.searchsorted(starts, begin)
        n = len(h) - window + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 4
        at = np.flatnonzero(seg[:n] == seg[window - 1 :])
        name = window_names(h, window)[at]
        ordered = np.sort(name)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return (np.zeros(0, np.int64),) * 4
        spot = np.minimum(np.searchsorted(twice, name), len(twice) - 1)
        live = twice[spot] == name
        at, name = at[live], name[live]
        did, pos = ids[seg[at]], start[seg[at]] + at - first[seg[at]]
        order = np.lexsort((pos, did, name))
        at, name, did, pos = at[order], name[order], did[order], pos[order]
        head = np.concatenate([[True], name[1:] != name[:-1]])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        same = np.ones(len(at), np.bool_)
        for k in range(window):
            same &= h[at + k] == h[at[lead] + k]
        if not same.all():
            raise ValueError("two windows have one name; change the scramble")
        later = (did > did[lead]) | (pos > pos[lead])
        return did[later], keys[seg[at]][later], pos[later], pos[later] + window

    return judge


def dedup_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: each text without the words that a window of `window` words covers which also
    starts earlier in the corpus, in a document of smaller id or before in the same one; kept words are joined by a space.

    Words are runs of other bytes than ASCII white space. Windows of 3-word minimisers travel as packed super-k-mers. A null text
    has no words; texts with fewer words than a window keep all. A null doc_id is larger than all others. Of rows that repeat an id
    no window is earlier than one at the same place of another; an empty table gives no rows; other columns are ignored.
    Words are compared by their 64-bit hashes.
    """
    search = Search(read_words, window, window - GRAM + 1, judge_words(window), True, 4 << 20, 12 << 20, 3.0)

    def finish(data: bytes, blobs: list[bytes]):
        words = spaced(data).split()
        kept = words
        if blobs:
            gone = covered(blobs, len(words))
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        text = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text

    return search.apply(docs, finish, "n_words long, n_removed long, kept_sha256 string, kept binary", ["n_words", "n_removed", "kept_sha256", "kept"])
