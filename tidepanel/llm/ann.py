"""Approximate nearest neighbours with balanced posting lists whose boundary vectors stand in several of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

POSTED = "shard int, is_query boolean, part int, vec_id long, floor double, parts binary, embedding binary"
#: Bytes of vectors that one task of the search holds.
SHARD = 160 << 20
#: Scores that are computed at once, and rows whose graph search goes in step: as much as caches hold.
TILE, STEP = 1 << 19, 500
#: Width of the beam that looks for the list of a vector; a narrower one puts too many vectors into lists that aren't their nearest.
BEAM = 16


@dataclass
class Index:
    """Centroids of equal lists, a graph on them, and the ratio of distances to which lists are searched.

    Inner products become distances by one more component, sqrt(top^2 - norm^2), that queries have as 0.
    """

    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    top: float
    ratio: float = 1.0
    copies: int = 4
    spread: float = 1.15
    held: np.ndarray | None = None  # ids of the sample by their nearest list
    least: int = 0
    width: int = 32  # of the beam with which a search starts

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        rest = np.sqrt(np.maximum(0, self.top**2 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def ask(self, q: np.ndarray) -> np.ndarray:
        """Queries point the same way at the length of the longest vector."""
        q = q.astype(np.float32)
        q = q * (self.top / np.linalg.norm(q, axis=1, keepdims=True))
        return np.concatenate([q, np.zeros((len(q), 1), np.float32)], axis=1)

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids of each row and their distances: best-first search of the graph, all rows in step.

        A beam of a quarter of the centroids or more would come past all of them: then all distances are computed at once."""
        n, k = len(x), len(self.centroids)
        width = min(width, k)
        square = np.einsum("ij,ij->i", self.centroids, self.centroids)
        own = np.einsum("ij,ij->i", x, x)[:, None]
        if 4 * width >= k:
            dist = np.sqrt(np.maximum(0, own + square - 2 * (x @ self.centroids.T)))
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            return order, np.take_along_axis(dist, order, 1)
        if n > STEP:
            found = [self.nearest(x[at : at + STEP], width) for at in range(0, n, STEP)]
            return np.concatenate([ids for ids, _ in found]), np.concatenate([dist for _, dist in found])
        far = lambda x, own, ids: np.sqrt(np.maximum(0, own + square[ids] - 2 * np.einsum("ij,ikj->ik", x, self.centroids[ids])))
        out_ids, out_dist, left = np.zeros((n, width), np.int64), np.zeros((n, width), np.float32), np.arange(n)
        seen = np.zeros((n, k), np.bool_)
        ids = np.broadcast_to(self.entry, (n, len(self.entry))).copy()
        seen[left[:, None], ids] = True
        dist = np.sqrt(np.maximum(0, own + square[self.entry] - 2 * (x @ self.centroids[self.entry].T)))
        done = np.zeros(ids.shape, np.bool_)
        while len(left):
            rows = np.arange(len(left))
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
            waiting = np.where(done, np.inf, dist)
            best = np.argmin(waiting, axis=1)
            live = np.isfinite(waiting[rows, best])
            if 4 * live.sum() <= 3 * len(left):  # rows whose search has ended go
                over = ~live
                out_ids[left[over]], out_dist[left[over]] = ids[over], dist[over]
                left, x, own, seen, ids, dist, done, best, live = (a[live] for a in (left, x, own, seen, ids, dist, done, best, live))
                rows = np.arange(len(left))
            done[rows, best] = True
            near = self.graph[ids[rows, best]]
            fresh = ~seen[rows[:, None], near] & live[:, None]
            seen[rows[:, None], near] |= live[:, None]
            ids = np.concatenate([ids, near], axis=1)
            dist = np.concatenate([dist, np.where(fresh, far(x, own, near), np.inf)], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
        return out_ids, out_dist

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list, and up to copies - 1 others nearly as near unless a chosen list's centroid is much nearer to theirs."""
        ids, dist = self.nearest(self.lift(x), max(BEAM, 4 * self.copies))
        keep = np.zeros(ids.shape, np.bool_)
        keep[:, 0] = True
        for j in range(1, ids.shape[1] if self.copies > 1 else 1):
            ok = (dist[:, j] <= self.spread * dist[:, 0]) & (keep.sum(1) < self.copies)
            for i in range(j):
                between = np.linalg.norm(self.centroids[ids[:, i]] - self.centroids[ids[:, j]], axis=1)
                ok &= ~(keep[:, i] & (between < 0.4 * dist[:, j]))
            keep[:, j] = ok
        row, at = np.nonzero(keep)
        return row, ids[row, at]

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists at most `ratio` times as far as the nearest one, and more until they hold `least` ids.

        The graph is searched with a beam, which widens for the queries whose beam ends before these lists do."""
        asked, waiting, width = self.ask(q), np.arange(len(q)), self.width
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(waiting):
            width = len(self.centroids) if 4 * width >= len(self.centroids) else width
            ids, dist = self.nearest(asked[waiting], width)
            held = np.zeros(ids.shape, np.int64) if self.held is None else np.cumsum(self.held[ids], axis=1)
            wanted = dist <= self.ratio * np.maximum(dist[:, :1], 1e-12)
            if self.held is not None:
                wanted |= held - self.held[ids] < self.least
            ended = ~wanted[:, -1] | (width == len(self.centroids))
            row, at = np.nonzero(wanted & ended[:, None])
            rows.append(waiting[row])
            lists.append(ids[row, at])
            waiting, width = waiting[~ended], 2 * width
        return np.concatenate(rows), np.concatenate(lists)

    def fit(self, sample: np.ndarray, asked: np.ndarray, near: np.ndarray, found: np.ndarray, wanted: float) -> None:
        """Takes the smallest ratio of distances with which searches of `asked` find `wanted` of their true neighbours `near` (of each
        row of `found`, where it is true), and of 1, 2 or `copies` lists to a vector the number that then searches the fewest vectors."""
        k, fits = len(self.centroids), []
        ids, dist = self.nearest(self.ask(asked), k)
        ratios = np.empty((len(asked), k))
        np.put_along_axis(ratios, ids, dist / np.maximum(dist[:, :1], 1e-12), 1)
        who, what = np.nonzero(found)
        for self.copies in sorted({1, 2, self.copies}):
            row, at = self.lists_of(near[who, what])
            need = np.full(len(who), np.inf)
            np.minimum.at(need, row, ratios[who[row], at])
            need.sort()
            ratio = float(need[min(len(need) - 1, int(wanted * len(need)))]) + 1e-6 if len(need) else 1.0
            sizes = np.bincount(self.lists_of(sample[:2000])[1], minlength=k)
            fits.append(((ratios <= ratio) @ sizes).mean())
            if fits[-1] == min(fits):
                best = self.copies, ratio, int(np.percentile((ratios <= ratio).sum(1), 75))
        self.copies, self.ratio, lists = best
        self.width = 32
        while self.width < min(lists + 1, k):
            self.width *= 2


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Splits rows in two equal parts along the line between two means."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = x @ (a - b)
        left = np.zeros(len(x), np.bool_)
        left[np.argsort(-side, kind="stable")[: len(x) // 2]] = True
        a, b = x[left].mean(0), x[~left].mean(0)
    return left


def build(sample: np.ndarray, top: float, lists: int, seed: int = 7) -> Index:
    """Fits centroids by balanced halving of a sample and joins each to its nearest in a graph."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    index = Index(np.zeros((1, sample.shape[1] + 1), np.float32), np.zeros((1, 1), np.int64), np.zeros(1, np.int64), top)
    lifted = index.lift(sample)
    parts = [np.arange(len(sample))]
    while len(parts) < lists and len(parts[0]) >= 16:
        split = []
        for p in parts:
            left = _halves(lifted[p], rng)
            split += [p[left], p[~left]]
        parts = sorted(split, key=len, reverse=True)
    index.centroids = np.stack([lifted[p].mean(0) for p in parts]).astype(np.float32)
    k = len(parts)
    if k > 1:
        c = index.centroids.astype(np.float64)
        square = np.einsum("ij,ij->i", c, c)
        apart = square[:, None] + square - 2 * (c @ c.T)
        np.fill_diagonal(apart, -np.inf)
        near = np.argsort(apart, axis=1, kind="stable")[:, 1 : 1 + min(k - 1, 24)]
        # a link from each centroid to the next one keeps the graph in one piece
        index.graph = np.concatenate([near, ((np.arange(k) + 1) % k)[:, None]], axis=1)
        index.entry = np.unique(np.linspace(0, k - 1, min(k, max(8, k // 8))).astype(np.int64))
    return index


#: Sum of squares: null where a component is, NaN or infinite where one isn't finite, as squares of floats don't overflow a double.
SQUARE = "aggregate(embedding, 0D, (a, v) -> a + cast(v AS double) * v)"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of vectors that take part: not null, of finite components, not all zero, with an id."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return found.where(F.col("vec_id").isNotNull() & (F.expr(SQUARE) > 0) & (F.expr(SQUARE) < float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end where `ends` says in the bytes of `data`."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _content(column: pa.Array) -> np.ndarray:
    """All bytes of a column of binary values without nulls."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def closest(asked_ids: np.ndarray, asked: np.ndarray, blocks: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest inner products of each asked vector in all blocks of (ids, vectors), -inf where there are fewer, and their vectors."""
    score, near, wide = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k, asked.shape[1]), np.float32), asked.astype(np.float64)
    for ids, x in blocks:
        s = wide @ x.T.astype(np.float64)
        s[asked_ids[:, None] == ids] = -np.inf
        rows = np.flatnonzero(s.max(1) > score.min(1))
        both = np.concatenate([score[rows], s[rows]], axis=1)
        pick = np.argpartition(-both, k - 1, axis=1)[:, :k]
        score[rows] = np.take_along_axis(both, pick, 1)
        near[rows] = np.where((pick < k)[..., None], near[rows[:, None], np.minimum(pick, k - 1)], x[np.maximum(pick - k, 0)])
    return score, near


def true_neighbours(vectors: DataFrame, asked_ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What `closest` gives over the whole table, by comparing the asked vectors with all others."""
    shared = vectors.sparkSession.sparkContext.broadcast((asked_ids, asked))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids, asked = shared.value
        score, near = closest(asked_ids, asked, ((b.column("vec_id").to_numpy(zero_copy_only=False), _matrix(b.column("embedding"))) for b in batches if b.num_rows), k)
        who, what = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(score[who, what]), _binary(near[who, what], np.arange(1, len(who) + 1) * 4 * asked.shape[1])], ["asked", "score", "near"])

    def first(group: pa.Table) -> pa.Table:
        return group.sort_by([("score", "descending")]).slice(0, k)

    schema = "asked long, score double, near binary"
    score, near_by = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k, asked.shape[1]), np.float32)
    at = np.zeros(len(asked), np.int64)
    for q in vectors.mapInArrow(near, schema).groupBy("asked").applyInArrow(first, schema).collect():
        score[q["asked"], at[q["asked"]]] = q["score"]
        near_by[q["asked"], at[q["asked"]]] = np.frombuffer(bytes(q["near"]), np.float32)
        at[q["asked"]] += 1
    return score, near_by


class Part:
    """Candidates of a list, or of a block of one: each vector once, with the k + 1 smallest of its ids, more of which no result can hold."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        row = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4)))[:, 0]
        _, first, same = np.unique(row, return_index=True, return_inverse=True)
        self.x = x[first]
        order = np.lexsort((ids, same))
        same, ids = same[order], ids[order]
        fresh = np.concatenate([[True], (same[1:] != same[:-1]) | (ids[1:] != ids[:-1])])
        same, ids = same[fresh], ids[fresh]
        start = np.searchsorted(same, np.arange(len(first)))
        few = np.arange(len(same)) - start[same] <= k
        same, self.ids = same[few], ids[few]
        self.count = np.bincount(same, minlength=len(first))
        self.start = np.cumsum(self.count) - self.count
        self.top = float(np.sqrt(np.einsum("ij,ij->i", self.x, self.x, dtype=np.float64).max()))
        self.own = int(np.unique(self.ids, return_counts=True)[1].max())  # vectors that may be of one id


class Hits:
    """The k best of each query of a batch over the parts searched so far: (row, id, score) in double precision."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.q, self.k = ids, q.astype(np.float64), k
        self.norm = np.linalg.norm(self.q, axis=1)
        self.unit = (self.q / self.norm[:, None]).astype(np.float32)
        self.floor = floor.copy()  # k hits of the row are known to be at least so large, for a query of length 1
        self.kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.fresh, self.many = [], 0
        # a tile of scores is written to the same memory again, small enough for a cache
        self.tile, self.below = np.zeros(0, np.float32), np.zeros(0, np.bool_)

    def search(self, rows: np.ndarray, part: Part) -> None:
        """Single precision finds what may be among the k best, with room for its error; these are scored in double precision."""
        slack = (self.q.shape[1] + 8) * 1.2e-7 * part.top
        n, step = len(part.x), max(16, TILE // len(part.x))
        if len(self.tile) < n * step:
            self.tile, self.below = np.zeros(n * step, np.float32), np.zeros(n * step + 7, np.bool_)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            scores = np.matmul(self.unit[own], part.x.T, out=self.tile[: n * len(own)].reshape(len(own), n))
            new = np.flatnonzero(np.isneginf(self.floor[own]))
            if len(new) and n >= self.k + part.own:
                place = n - self.k - part.own
                self.floor[own[new]] = np.partition(scores[new], place, axis=1)[:, place] - slack
            hit = _few(scores, np.nextafter((self.floor[own] - slack).astype(np.float32), np.float32(-np.inf))[:, None], self.below)
            for some in range(0, len(hit), 1 << 15):
                r, c = np.divmod(hit[some : some + (1 << 15)], n)
                r = own[r]
                exact = np.einsum("ij,ij->i", self.q[r], part.x[c].astype(np.float64))
                count = part.count[c]
                r, exact = np.repeat(r, count), np.repeat(exact, count)
                ids = part.ids[np.arange(len(r)) + np.repeat(part.start[c] - np.cumsum(count) + count, count)]
                other = ids != self.ids[r]
                self.fresh.append((r[other], ids[other], exact[other]))
                self.many += len(r)
                if self.many > max(1 << 16, 2 * self.k * len(self.ids)):
                    self.prune()

    def prune(self) -> None:
        row, ids, score = (np.concatenate(a) for a in zip(self.kept, *self.fresh, strict=True))
        self.kept, self.fresh, self.many = best_of(row, ids, score, self.k), [], 0
        row, _, score = self.kept
        full = np.flatnonzero(np.bincount(row, minlength=len(self.ids)) == self.k)
        last = np.searchsorted(row, full, "right") - 1
        slack = (self.q.shape[1] + 8) * 1.2e-7 * np.abs(score[last]) / self.norm[full]
        self.floor[full] = np.maximum(self.floor[full], score[last] / self.norm[full] - slack)


def _few(scores: np.ndarray, floor: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places in the flat scores that aren't below the floor; a product that has overflowed is one of them."""
    whole = -(-scores.size // 8) * 8
    fine = room[: scores.size].reshape(scores.shape)
    np.less(scores, floor, out=fine)
    np.logical_not(fine, out=fine)
    room[scores.size : whole] = False
    eight = np.flatnonzero(room[:whole].view(np.uint64))
    return (8 * eight[:, None] + np.arange(8))[room[:whole].reshape(-1, 8)[eight]]


def best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to smaller ids, each id and score once; sorted."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    if len(row):
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])])
        row, ids, score = row[fresh], ids[fresh], score[fresh]
        ok = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, ids, score = row[ok], ids[ok], score[ok]
    return row, ids, score


def known_floor(ids: np.ndarray, q: np.ndarray, probed: np.ndarray, known_ids: np.ndarray, known: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
    """What the k-th best hit of each query, at length 1, comes to at least: vectors of the sample in the lists it searches are sure to be
    found. Four more than k have to be as good, in case that rounding put one into another list."""
    if len(known_ids) <= k + 4:
        return np.full(len(ids), -np.inf)
    q = q.astype(np.float64)
    scores = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32) @ known.T
    scores[~probed[:, lists] | (ids[:, None] == known_ids) | np.isnan(scores)] = -np.inf
    place = len(known_ids) - k - 4
    slack = (q.shape[1] + 8) * 1.2e-7 * float(np.sqrt(np.einsum("ij,ij->i", known, known, dtype=np.float64).max()))
    return np.partition(scores, place, axis=1)[:, place].astype(np.float64) - slack


def search(vectors: DataFrame, every: int = 20, k: int = 20, lists: int | None = None, sample: int = 20_000, block: int = 4096, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id `every` divides, the k others with the largest inner product.

    The index is fitted on at most `sample` vectors, those whose id hashes lowest, and holds every vector. Unless given, the number of
    lists grows with the vectors, one for 256 of them, up to one for 8 of the sample. How far searches go is fitted on 200 vectors of the
    sample that are kept out of the centroids, against their true neighbours in the whole table. Lists longer than `block` are cut into blocks that each see the list's queries,
    so no list meets in one task. Neighbouring lists and blocks make shards, which a query is sent to once with the names of those it
    searches there; a shard grows to 160 MB of vectors before there are more than 16. Scores are inner products of the
    original vectors in double precision; ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do those of another length than most. Rows that repeat an id with the same vector
    count once; with different vectors, each is a candidate of its own, and as queries they share one list of k, of the largest
    products of any of them. Fewer than k candidates are all returned;
    an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 2000)
    vectors = usable(vectors)
    out = "query_id long, rank int, vec_id long, score double"
    facts = vectors.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"), F.max(F.expr(SQUARE)).alias("top")).orderBy(F.desc("n"), "length").first()
    if facts is None:
        return spark.createDataFrame([], out)
    total, length = facts["n"], facts["length"]
    vectors = vectors.where(F.size("embedding") == length)
    # thinned by hash first, so that partitions don't each send a whole sample; a quarter more than wanted on average
    thin = vectors if total <= sample else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, 1.25 * sample / total)))
    drawn = thin.orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)), "vec_id").limit(sample).toPandas()
    points, names = np.stack([np.asarray(v, np.float32) for v in drawn["embedding"]]), drawn["vec_id"].to_numpy()
    # the vectors on which the ratio is fitted, queries first, have no part in the centroids: they would be nearer to them than others are
    asked, others = np.split(np.argsort(names % every != 0, kind="stable"), [min(200, -(-len(names) // 10))])
    index = build(points[np.sort(others)] if len(others) else points, float(facts["top"]) ** 0.5, lists or max(16, min(total // 256, sample // 8)))
    score, near = true_neighbours(vectors, names[asked], points[asked], k) if total > len(points) else closest(names[asked], points[asked], [(names, points)], k)
    index.fit(points, points[asked], near, np.isfinite(score), recall)
    row, at = index.lists_of(points)
    nearest = at[np.unique(row, return_index=True)[1]]
    once = np.unique(names, return_index=True)[1]
    known = names[once], points[once], nearest[once]
    index.held, index.least = np.bincount(known[2], minlength=len(index.centroids)), k + 1
    # the blocks of a list are as many as its share of the sample asks for; copies of one vector can make it longer, which hashing spreads as well
    rows = np.bincount(at, minlength=len(index.centroids)) / len(points) * total
    blocks = np.maximum(1, np.ceil(rows / block)).astype(np.int64)
    first = np.cumsum(blocks) - blocks  # part of a list's first block
    size = np.repeat(rows / blocks, blocks)
    shards = max(int(np.ceil(rows.sum() * length * 4 / SHARD)), min(16, len(size)))
    shard_of = np.minimum((np.cumsum(size) - size / 2) / size.sum() * shards, shards - 1).astype(np.int64)
    local = np.arange(len(size)) - np.searchsorted(shard_of, shard_of)
    octets = -(-np.bincount(shard_of, minlength=shards) // 8)
    shared = spark.sparkContext.broadcast((asdict(index), blocks, first, shard_of, local, octets, known))  # plain data, so that workers need no import

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, blocks, first, shard_of, local, octets, known = shared.value
        index = Index(**kept)

        def rows(part, is_query, at, ids, x, floor, bits):
            n = len(ids)
            columns = [pa.array(shard_of[part] if at is None else at, pa.int32()), pa.array(np.full(n, is_query)), pa.array(np.full(n, -1) if part is None else local[part], pa.int32()), pa.array(ids, pa.int64()), pa.array(floor, pa.float64()), bits, _binary(x, np.arange(1, n + 1) * 4 * length)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "is_query", "part", "vec_id", "floor", "parts", "embedding"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("embedding"))
            row, at = index.lists_of(x)
            part = first[at] + (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[at]
            yield rows(part, False, None, ids[row], x[row], np.zeros(len(row)), pa.nulls(len(row), pa.binary()))
            asks = np.flatnonzero(ids % every == 0)
            if not len(asks):
                continue
            row, at = index.probes(x[asks])
            probed = np.zeros((len(asks), len(blocks)), np.bool_)
            probed[row, at] = True
            floor = np.concatenate([known_floor(ids[some], x[some], probed[a : a + 256], *known, k) for a in range(0, len(asks), 256) for some in [asks[a : a + 256]]])
            times = blocks[at]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first[at], times)
            to, which = np.unique(np.repeat(row, times) * len(octets) + shard_of[part], return_inverse=True)
            which_ask, shard = np.divmod(to, len(octets))
            who = asks[which_ask]
            ends = np.cumsum(octets[shard])
            bits = np.zeros(8 * ends[-1], np.bool_)
            bits[8 * (ends - octets[shard])[which] + local[part]] = True
            yield rows(None, True, shard, ids[who], x[who], floor[which_ask], _binary(np.packbits(bits), ends))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one shard, by part, then its queries by id: its candidates are held, its queries pass."""
        parts, pieces, part = {}, [], -1
        last, seen = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), _content(batch.column("embedding")).view(np.float32).reshape(batch.num_rows, -1)
            here = batch.column("part").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(here[1:] != here[:-1]) + 1).tolist(), len(here)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if here[a] != part and pieces:
                    parts[part] = Part(*(np.concatenate(p) for p in zip(*pieces, strict=True)), k)
                    pieces = []
                part = int(here[a])
                if part >= 0:
                    pieces.append((ids[a:b].copy(), x[a:b].copy()))
            if part < 0:
                asks = np.flatnonzero(here < 0)
                bits = np.unpackbits(_content(batch.column("parts").take(pa.array(asks))).reshape(len(asks), -1), axis=1)
                fine = np.ones(len(asks), np.bool_)
                same = ids[asks] == np.concatenate([[last if last is not None else ids[asks[0]] - 1], ids[asks][:-1]])
                for i in np.flatnonzero(same | np.concatenate([same[1:], [True]])):  # the same vector of the same id asks once
                    if ids[asks[i]] != last:
                        last, seen = ids[asks[i]], set()
                    key = x[asks[i]].tobytes()
                    fine[i] = key not in seen
                    seen.add(key)
                asks, bits = asks[fine], bits[fine]
                hits = Hits(ids[asks], x[asks], k, batch.column("floor").to_numpy(zero_copy_only=False)[asks])
                for p, held in parts.items():
                    rows = np.flatnonzero(bits[:, p])
                    if len(rows):
                        hits.search(rows, held)
                hits.prune() if hits.fresh else None
                row, found, score = hits.kept
                who, count = np.unique(row, return_counts=True)
                if len(who):
                    pairs = np.stack([score.view(np.int64), found], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(hits.ids[who], pa.int64()), _binary(pairs, np.cumsum(count) * 16)], ["query_id", "hits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by query; the last query of a batch waits for the next batch."""
        def result(q, ids, score):
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "rank", "vec_id", "score"])

        rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            hits = batch.column("hits")
            pairs = _content(hits).view(np.int64).reshape(-1, 2)
            q = np.repeat(batch.column("query_id").to_numpy(zero_copy_only=False), np.diff(np.frombuffer(hits.buffers()[1], np.int32)[hits.offset : hits.offset + len(hits) + 1]) // 16)
            q, ids, score = best_of(*(np.concatenate(a) for a in zip(rest, (q, pairs[:, 1], np.ascontiguousarray(pairs[:, 0]).view(np.float64)), strict=True)), k)
            ended = q != q[-1]
            rest = q[~ended], ids[~ended], score[~ended]
            yield result(q[ended], ids[ended], score[ended])
        yield result(*rest)

    posted = vectors.mapInArrow(post, POSTED).repartitionById(shards, "shard").sortWithinPartitions("is_query", "part", "vec_id")
    found = posted.mapInArrow(scan, "query_id long, hits binary")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, out)
