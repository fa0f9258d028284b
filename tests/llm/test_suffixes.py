"""op4's buckets: suffixes sorted by bucket pointers, whole copies left out before, names that clash."""

import random

import numpy as np
import pytest

from tidepanel.llm import segments, suffix_dedup


def bucket(seed=1, n=120):
    """Segments with one minimiser at different places, of documents that repeat; some are whole copies, some nearly."""
    r = random.Random(seed)
    left, right = ("".join(r.choices("ab", k=60)) for _ in range(2))
    rows = []
    for k in range(n):
        place = r.randint(0, 42)
        s = left[len(left) - place :] + "minimise" + right[: r.randint(42 - place, 42)]  # every window holds it
        if k % 5 == 0:
            at = r.randrange(len(s))
            s = s[:at] + "\0" + s[at + 1 :]
        rows.append((r.randrange(40), k, r.randrange(1000), len(s), place, s.encode()))
    columns = [np.array(c, np.int64) for c in list(zip(*rows))[:5]]
    return *columns, b"".join(x[5] for x in rows)


def by_hand(ids, keys, start, lengths, place, text):
    begin = np.cumsum(lengths) - lengths
    where = [(i, k, a + j, text[b + j : b + j + 50]) for i, k, a, b, n in zip(ids, keys, start, begin, lengths) for j in range(n - 49)]
    low = {}
    for i, _, _, w in where:
        low[w] = min(low.get(w, i), i)
    return {(i, k, at + j) for i, k, at, w in where if low[w] < i for j in range(50)}


def units(found):
    return {(i, k, at) for i, k, a, b in zip(*found) for at in range(a, b)}


def test_judge_finds_all_windows():
    for seed in range(20):
        got = bucket(seed)
        want = by_hand(*got)
        assert want and units(suffix_dedup.judge_bytes(50)(*got)) == want


def test_names_that_clash_change_nothing(monkeypatch):
    got = bucket(3)
    monkeypatch.setattr(suffix_dedup, "joined", lambda a, b: a * np.uint64(0))
    monkeypatch.setattr(suffix_dedup, "word_hashes", lambda data, a, b: np.zeros(len(a), np.uint64), raising=False)
    assert units(suffix_dedup.judge_bytes(50)(*got)) == by_hand(*got)


def test_whole_copies_are_not_sorted(monkeypatch):
    sizes, real = [], suffix_dedup.bucket_pointers
    monkeypatch.setattr(suffix_dedup, "bucket_pointers", lambda data, depth: sizes.append(len(data)) or real(data, depth))
    one = bytes(range(100, 160))
    n = 500
    number = np.arange(n)
    found = suffix_dedup.judge_bytes(50)(number, number, number, np.full(n, 60), np.full(n, 30, np.uint8), one * n)
    assert units(found) == {(k, k, k + j) for k in range(1, n) for j in range(60)}
    assert sum(sizes) == 0


def test_repeats_in_a_document_are_sorted_once(monkeypatch):
    """A long run of one byte makes as many equal segments; the first stands for all that its document has."""
    sizes, real = [], suffix_dedup.bucket_pointers
    monkeypatch.setattr(suffix_dedup, "bucket_pointers", lambda data, depth: sizes.append(len(data)) or real(data, depth))
    n = 3000
    ids = np.append(np.zeros(1, np.int64), np.ones(n - 1, np.int64))
    lengths = np.append([51], np.full(n - 1, 50))
    text = b"b" + b"a" * 50 + b"a" * 50 * (n - 1)
    place = np.append([1], np.zeros(n - 1, np.int64))
    got = ids, ids, np.append([0], np.arange(n - 1)), lengths, place, text
    assert units(suffix_dedup.judge_bytes(50)(*got)) == by_hand(*got) == {(1, 1, k) for k in range(n + 48)}
    assert 0 < sum(sizes) < 200


@pytest.mark.parametrize("depth", [8, 16, 50])
def test_bucket_pointers_follow_the_bytes(depth):
    data = np.random.default_rng(depth).integers(0, 2, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    padded = data.tobytes() + bytes(depth)
    suffixes = [padded[k : k + depth] for k in range(len(data))]
    last = {s: k for k, s in enumerate(sorted(suffixes))}
    assert suffix_dedup.bucket_pointers(data, depth).tolist() == [last[s] for s in suffixes]


def test_equal_windows_choose_alike_wherever_they_stand():
    """Grams that differ in low bits alone tie, however many others stand beside them."""
    grams = (np.array([9, 5, 5, 9, 9], np.uint64) << np.uint64(32)) | np.array([0, 1 << 16, 0, 0, 0], np.uint64)

    def place(padding):
        g = np.concatenate([grams, np.full(padding, 9 << 32, np.uint64)])
        n = len(g) + 2
        u = segments.Units(b"", np.arange(n), np.arange(1, n + 1), g, np.zeros(n, np.int64), np.zeros(1, np.int64))
        _, _, key, at = segments.runs(u, 7, 5, np.zeros(0, np.uint64))
        return key[0], at[0]

    assert place(0) == place(1 << 20)


@pytest.mark.parametrize("most", [0, 1000])
def test_rows_that_repeat_an_id(spark, monkeypatch, most):
    """Rows of one id, null among them, are of one document, whether all rows are known by their texts or only these."""
    monkeypatch.setattr(segments, "REPEATED", most)
    r = random.Random(5)
    part = ["".join(r.choices("abcde ", k=90)) for _ in range(6)]
    rows = [(7, part[0]), (7, part[1]), (3, part[1] + part[2]), (None, part[0] + "x"), (None, part[3]), (9, part[3]), (9, None), (4, part[4]), (5, part[5] + part[4]), (7, part[0] + part[4])]
    first = {}
    for i, t in rows:
        for k in range(len(t or "") - 49):
            w = t[k : k + 50]
            first[w] = min(first.get(w, segments.LAST), segments.LAST if i is None else i)
    want = []
    for i, t in rows:
        t = t or ""
        gone = {k + j for k in range(len(t) - 49) if first[t[k : k + 50]] < (segments.LAST if i is None else i) for j in range(50)}
        want.append((i, len(t), len(gone)))
    got = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = lambda x: (x[0] is None, x)
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in got), key=by) == sorted(want, key=by)


def test_packs_carry_no_hash_of_a_text(spark):
    docs = spark.range(50).selectExpr("id doc_id", "concat('text ', id) text")
    search = segments.Search(suffix_dedup.read_bytes, 50, 43, suffix_dedup.judge_bytes(50), False, 2 << 20, 10 << 20, 3.3)
    assert search.repeated_ids(docs) == []
    assert search.documents(docs, []).agg({"key": "max"}).first()[0] == 0


def test_packs_come_back():
    r = np.random.default_rng(2)
    ids = np.sort(np.concatenate([r.integers(-(1 << 63), segments.LAST, 40), [segments.LAST, -(1 << 63), 0, 0]])).repeat(3)
    n = len(ids)
    keys, start, place = r.integers(0, 2, n), r.integers(0, 1 << 31, n), r.integers(0, 43, n)
    slices = [bytes(r.integers(0, 256, r.integers(50, 92), dtype=np.uint8)) for _ in range(n)]
    got = segments.unpack(segments.pack(ids, keys, start, place, slices))
    for x, y in zip(got, (ids, keys, start, [len(s) for s in slices], place)):
        assert np.array_equal(x, y)
    assert got[5] == b"".join(slices)
