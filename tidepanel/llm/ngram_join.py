"""Similarity join on sets of word n-grams: T-occurrence search with DivideSkip inside groups of possible partners.

Sets that are equal are one node. In one order of all grams, the first 0.4 n grams of a set hold at least 0.16 n of those it shares
with any partner, so nodes that share fewer of them with others have no link. The rest form groups that no link leaves; inside a
group inverted lists are searched exactly. A group that is too large for a task is dealt out in blocks, each searched by itself;
what its largest class leaves over is searched for in all blocks.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_memory, join_one, maybe_among, raw_bytes, spaced, word_bounds, word_hashes
from .segments import LAST, joined

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Grams in a task's block.
BLOCK = 1_500_000
#: Ids up to which short lists are merged on a heap, one by one.
MERGED = 1024
#: Grams that a worker gathers before it sends them on.
GATHERED = 1_000_000
#: Bytes of text in which frequent grams are looked for, and the nodes there that make a gram frequent.
SAMPLE, FREQUENT = 16 << 20, 8


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit names of each text's n-grams of words; a text with fewer words has its whole sequence as one."""
    data = spaced(b" ".join(texts)).translate(_LOWER)
    array = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(array)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    first = np.append(np.searchsorted(starts, offsets), len(starts))
    h = word_hashes(array, starts, ends)
    names = h
    for k in range(1, n):
        names = joined(names[: len(h) - k], h[k:]) if len(h) > k else h[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(names[a : b - n + 1]))
        elif b > a:
            short = h[a]
            for k in range(a + 1, b):
                short = joined(np.array([short]), h[k : k + 1])[0]
            out.append(joined(np.array([short]), np.array([b - a], np.uint64)))
        else:
            out.append(h[:0])
    return out


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def divide_skip(lists: Sequence[Sequence[int]], t: int, weights: Sequence[int] | None = None, mu: float = 0.05) -> list[tuple[int, int]]:
    """(id, number of lists) of the ids that stand in at least t of the sorted lists; a list of weight w counts as w equal ones.

    The longest lists, of less weight than t, are set apart. The others are merged on a heap of their heads; where a head stands in too
    few of them, as many more are popped as can't make up an answer either, and all of these skip to the next head by binary search.
    An id that stands in enough of the short lists is looked up in each long one. Where all lists are short none is set apart. Where
    the short lists hold more than MERGED ids, the merge and the searches are of whole arrays, with the same result.
    """
    weights = [1] * len(lists) if weights is None else weights
    if sum(weights) < t:
        return []
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    longest = len(lists[order[-1]])
    most = min(t - 1, int(t / (mu * log(longest) + 1))) if longest > 8 else 0
    probed, apart = [], 0
    while order and apart + weights[order[-1]] <= most:
        apart += weights[order[-1]]
        probed.append(order.pop())
    short = [lists[k] for k in order]
    weight = [weights[k] for k in order]
    if sum(map(len, short)) > MERGED:
        return _merged_arrays([np.asarray(x) for x in short], weight, [(np.asarray(lists[k]), weights[k]) for k in probed[::-1]], t, apart)
    short = [x.tolist() if isinstance(x, np.ndarray) else x for x in short]
    need, left, out, at = t - apart, sum(weight), [], [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short) if len(x)]
    heapify(heap)
    while heap and left >= need:
        value = heap[0][0]
        popped, n = [], 0
        while heap and heap[0][0] == value:
            k = heappop(heap)[1]
            popped.append(k)
            n += weight[k]
        if n >= need:
            for k in probed:
                x = lists[k]
                j = bisect_left(x, value)
                n += weights[k] * bool(j < len(x) and x[j] == value)
            if n >= t:
                out.append((value, n))
            for k in popped:
                at[k] += 1
        else:
            while heap and n + weight[heap[0][1]] < need:
                k = heappop(heap)[1]
                popped.append(k)
                n += weight[k]
            if not heap:
                break
            for k in popped:
                at[k] = bisect_left(short[k], heap[0][0], at[k])
        for k in popped:
            if at[k] < len(short[k]):
                heappush(heap, (short[k][at[k]], k))
            else:
                left -= weight[k]
    return out


def _merged_arrays(short: list[np.ndarray], weight: list[int], probed: list[tuple[np.ndarray, int]], t: int, apart: int) -> list[tuple[int, int]]:
    """The same on arrays: sorted runs are merged by a stable sort, which finds the runs."""
    ids = np.concatenate(short)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    n = np.add.reduceat(np.repeat(np.array(weight, np.int64), [len(x) for x in short])[order], at)
    ids = ids[at]
    keep = n >= t - apart
    ids, n = ids[keep], n[keep]
    for x, w in probed:
        if not len(ids):
            break
        spot = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        n = n + w * (x[spot] == ids)
        apart -= w
        keep = n >= t - apart
        if not keep.all():
            ids, n = ids[keep], n[keep]
    return list(zip(ids.tolist(), n.tolist()))


@dataclass
class Roots:
    parent: list[int] = field(default_factory=list)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


class Inverted:
    """Inverted lists over sets, by gram; with `owner`, without the lists that sets of one owner only are in. Equal lists are kept once."""

    def __init__(self, sets: list[np.ndarray], owner: np.ndarray | None = None):
        grams = np.concatenate([np.zeros(0, np.uint64), *sets])
        by = np.argsort(grams, kind="stable")
        grams, who = grams[by], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[by]
        new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(grams))
        if owner is not None and len(new):
            mixed = np.minimum.reduceat(owner[who], new) != np.maximum.reduceat(owner[who], new)
            new, ends = new[mixed], ends[mixed]
        self.grams, self.lists, known = grams[new], [], {}
        number = []
        for a, b in zip(new.tolist(), ends.tolist()):
            k = known.setdefault(who[a:b].tobytes(), len(self.lists))
            if k == len(self.lists):
                self.lists.append(who[a:b])
            number.append(k)
        self.number = np.array(number, np.int64)

    def search(self, grams: np.ndarray, t: int) -> list[tuple[int, int]]:
        if not len(self.grams):
            return []
        spot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        have = self.number[spot[self.grams[spot] == grams]]
        if len(have) < t:
            return []
        which, times = np.unique(have, return_counts=True)
        return divide_skip([self.lists[k] for k in which.tolist()], t, times.tolist())


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n grams with any partner."""
    return -(-percent * n // 100)


def fits(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def linked(sets: list[np.ndarray], percent: int = 80) -> list[int]:
    """For each set the smallest number of a set that links reach. Every link between different components so far is looked for.

    First each set, by size, searches the leaders: sets that found no leader. Then all sets outside the largest component search
    the inverted lists of all sets, without grams that only one component has.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    roots = Roots(list(range(len(sets))))
    size = [len(s) for s in sets]
    leaders: dict[int, array] = {}
    rank: list[int] = []
    for i in order:
        grams = sets[i].tolist()
        hit = False
        for k, both in divide_skip([x for x in map(leaders.get, grams) if x is not None], needed(size[i], percent)):
            if fits(size[i], size[rank[k]], both, percent):
                roots.join(i, rank[k])
                hit = True
        if not hit:
            for g in grams:
                leaders.setdefault(g, array("q")).append(len(rank))
            rank.append(i)
    del leaders
    own = np.array([roots.find(i) for i in range(len(sets))])
    names, at, counts = np.unique(own, return_inverse=True, return_counts=True)
    if len(names) > 1:
        lists = Inverted(sets, at)
        for i in np.flatnonzero(at != int(np.argmax(counts))).tolist():
            for k, both in lists.search(sets[i], needed(size[i], percent)):
                if k != i and fits(size[i], size[k], both, percent):
                    roots.join(i, k)
    return [roots.find(i) for i in range(len(sets))]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node that edges reach. Labels go to neighbours and on to the labels themselves; each round is cut.
    Labels are one small row a node; where a node has very many edges, adaptive execution splits its side of the join."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("low")).withColumnRenamed("a", "node")
        # the label of a label shortens chains
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(labels.join(near, "node").join(jump, "root").select("node", "root", F.least("low", "next").alias("now")))
        if new.where("now < root").limit(1).count() == 0:
            return labels
        labels = new.select("node", F.col("now").alias("root"))


def prefix_length(n: int, percent: int) -> int:
    """Grams of a set that are compared first."""
    return min(n, n - needed(n, percent) + max(1, n // 5))


def ordered(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Sorted grams in the order that all sets agree on: those not in `hot` first."""
    if not len(hot):
        return grams
    late = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
    return np.concatenate([grams[~late], grams[late]])


def pair_counts(nodes: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (node, center) and how often each stands."""
    order = np.lexsort((centers, nodes))
    nodes, centers = nodes[order], centers[order]
    at = np.flatnonzero(np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (centers[1:] != centers[:-1])])) if len(nodes) else np.zeros(0, np.int64)
    return nodes[at], centers[at], np.diff(np.append(at, len(nodes)))


def shared_counts(grams: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that has the gram) for each gram that several distinct nodes have."""
    order = np.argsort(grams, kind="stable")
    grams, nodes = grams[order], nodes[order]
    alike = grams[1:] == grams[:-1] if len(grams) else np.zeros(0, np.bool_)
    several = np.zeros(len(grams), np.bool_)
    several[1:] = alike
    several[:-1] |= alike
    grams, nodes = grams[several], nodes[several]
    order = np.lexsort((nodes, grams))
    grams, nodes = grams[order], nodes[order]
    once = np.ones(len(grams), np.bool_)
    once[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])
    grams, nodes = grams[once], nodes[once]
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    length = np.diff(np.append(at, len(grams)))
    several = np.repeat(length > 1, length)
    return nodes[several], np.repeat(nodes[at], length)[several]


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """did, key, doc_id, node, n_shingles, component_id, first for each row of docs: documents whose sets of word n-grams have a Jaccard
    similarity of at least percent / 100 are linked, equal sets included; a component is what links reach, named by its smallest id.

    Words are lower-cased in A-Z. A text with fewer than n words has its whole sequence as one gram; a null text or one without words has
    none and is linked with nothing. Rows with a null doc_id take part and count as larger than all; a component of such rows only has a
    null component_id. `first` is (did, key), id and hash of the text, of the component's first row, null without words. Repeated rows
    are equal sets. An empty table gives no rows; other columns are ignored. Grams are compared by 64-bit names, sets by 64-bit digests.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("key"), text.cast("binary").alias("data"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = raw_bytes(docs)
    buckets = max(8, raw // (16 << 20) + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("data").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "did", "key", "node", "n"])
        free_memory()

    facts = cut(rows.mapInArrow(measure, f"doc_id {kind}, did long, key long, node long, n long"))
    shares = cut(_shares(rows, raw, buckets, n, percent))
    nodes = cut(facts.groupBy("node").agg(F.min(F.struct("did", "key")).alias("rep"), F.max("n").alias("n")))
    smallest = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.lit(1), F.least(F.floor(F.col("n") / 5), F.floor(smallest / 5)))
    able = shares.groupBy("node").agg(F.sum("shared").alias("all"), F.count("*").alias("centers")).join(nodes, "node").where(F.col("all") >= least)
    able = cut(able.select("node", "n", "rep.did", "rep.key", (least / F.col("centers")).alias("least")))
    # of the grams two linked nodes share, some smallest node answers for at least the mean
    edges = shares.join(able.select("node", "least"), "node").where(F.col("shared") >= F.col("least")).select(F.col("node").alias("a"), F.col("center").alias("b"))
    member = cut(able.drop("least").join(components(edges), "node"))  # one document stands for its node
    labels = _classes(rows, member, n, percent)
    # each node's class, and each class's first row
    known = cut(nodes.where("n > 0").join(labels, "node", "left").select("node", F.coalesce("class", "node").alias("class"), "rep"))
    first = known.groupBy("class").agg(F.min("rep").alias("first"))
    named = cut(join_one(known.select("node", "class"), first, "class").select("node", "first"))
    low = F.col("first.did")
    return join_one(facts, named, "node").select(
        "did", "key", "doc_id", "node", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(low < LAST, low)).alias("component_id"), "first"
    )


def _shares(rows: DataFrame, raw: int, buckets: int, n: int, percent: int) -> DataFrame:
    """(node, center, shared): how many of a node's first grams others have too, by the node that answers for the gram: the smallest that
    has it, or the smallest of a sample for grams that are frequent there.

    Frequent grams come last in the order of grams and aren't dealt out; their centers are known everywhere. The sample is bounded by
    SAMPLE, and decides, like sampled bounds of ranges, where sets meet and no result.
    """
    data = rows.select("data")
    parts = max(1, raw // SAMPLE)
    drawn = rows.where(F.pmod(F.xxhash64("did", "key"), F.lit(parts)) == 0).select("data") if parts > 1 else data

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sends (gram, node) of what is compared first to buckets, and what frequent grams count for to any of them."""
        names, centers = hot.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def packed():
            if not held:
                return
            grams, nodes = np.concatenate([h[0] for h in held]), np.repeat(np.array([h[1] for h in held], np.int64), [len(h[0]) for h in held])
            local = []
            if len(names):
                spot = np.minimum(np.searchsorted(names, grams), len(names) - 1)
                late = names[spot] == grams
                found = pair_counts(nodes[late], centers[spot[late]])
                local = [b"".join(x[k : k + 20_000].astype(np.int64).tobytes() for x in found) for k in range(0, len(found[0]), 20_000)]
                grams, nodes = grams[~late], nodes[~late]
            bucket = ((grams >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, nodes = bucket[order], nodes[order]
            low = np.ascontiguousarray(grams[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])  # the bucket stands for the rest
            at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            blobs = [low[a:b].tobytes() + nodes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            where = [*bucket[at[:-1]].tolist(), *((k + len(seen)) % buckets for k in range(len(local)))]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([False] * len(blobs) + [True] * len(local)), pa.array(blobs + local, pa.binary())], ["bucket", "counted", "blob"])

        for batch in batches:
            for s in shingle_sets(batch.column("data").to_pylist(), n):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    part = ordered(s, names)[: prefix_length(len(s), percent)]
                    held.append((part, node))
                    size += len(part)
            if size > GATHERED:
                yield from packed()
                held, size = [], 0
            if len(seen) > 200_000:
                seen.clear()
        yield from packed()
        held.clear()
        free_memory()

    def meet(group: pa.Table) -> pa.Table:
        blobs = group.filter(pc.invert(group["counted"]))["blob"].to_pylist()
        sizes = [len(b) // 13 for b in blobs]
        grams = np.zeros((sum(sizes), 8), np.uint8)
        if blobs:
            grams[:, :5] = np.concatenate([np.frombuffer(b, np.uint8, 5 * k).reshape(-1, 5) for b, k in zip(blobs, sizes)])
        nodes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, np.int64, k, 5 * k) for b, k in zip(blobs, sizes))])
        del blobs
        found = [pair_counts(*shared_counts(grams.view("<u8").ravel(), nodes))]
        found += [np.frombuffer(b, np.int64).reshape(3, -1) for b in group.filter(group["counted"])["blob"].to_pylist()]
        out = pa.table(dict(zip(["node", "center", "shared"], (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3)))))
        free_memory()
        return out

    hot = rows.sparkSession.sparkContext.broadcast(_frequent_grams(drawn, n))  # bounded by the sample
    dealt = data.mapInArrow(deal, "bucket int, counted boolean, blob binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "node long, center long, shared long").groupBy("node", "center").agg(F.sum("shared").alias("shared"))


def _frequent_grams(drawn: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams that at least FREQUENT distinct sets of a sample have, and the smallest node of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {node_of(s): s for s in shingle_sets(batch.column("data").to_pylist(), n) if len(s)}
            grams = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.repeat(np.array(list(sets), np.int64), [len(s) for s in sets.values()]))], ["gram", "node"])

    found = drawn.mapInArrow(run, "gram long, node long").distinct().groupBy("gram").agg(F.count("*").alias("nodes"), F.min("node").alias("node")).where(F.col("nodes") >= FREQUENT)
    rows = found.select("gram", "node").toPandas()
    grams, nodes = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["node"].to_numpy(np.int64)
    order = np.argsort(grams)
    return grams[order], nodes[order]


def _classes(rows: DataFrame, member: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, class) of the nodes that links lead to others from. member: node, root of its group, n, did and key of its document."""
    sizes = cut(member.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("grams")).where("members > 1"))
    small, most = sizes.agg(F.sum(F.when(F.col("grams") <= BLOCK, F.col("grams"))), F.max("grams")).first()
    tasks = max(1, int(small or 0) // (BLOCK // 3) + 1)
    blocks = F.when(F.col("grams") > BLOCK, F.ceil(F.col("grams") / BLOCK).cast("int"))
    placed = member.join(sizes.select("root", blocks.alias("blocks")), "root")
    placed = placed.withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    placed = cut(placed.withColumn("task", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "block"))))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=4)
        for batch in batches:
            data = [np.int64(len(d)).tobytes() + codec.compress(d, asbytes=True) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], ["did", "key", "data"])

    def sets_of(data: list[bytes]) -> list[np.ndarray]:
        codec, out = pa.Codec("zstd"), []
        for k in range(0, len(data), 200):
            out += shingle_sets([codec.decompress(d[8:], int(np.frombuffer(d[:8], np.int64)[0]), asbytes=True) for d in data[k : k + 200]], n)
        return out

    # only texts that may be asked for leave their place
    asked = maybe_among(rows.select("did", "key", "data"), F.xxhash64("did", "key"), placed.select(F.xxhash64("did", "key").alias("name")), placed.count())
    texts = asked.where("__among").select("did", "key", "data").mapInArrow(shrink, "did long, key long, data binary")
    held = cut(texts.join(placed, ["did", "key"]).select("node", "root", "n", "blocks", "block", "task", "data"))

    def find(group: pa.Table) -> pa.Table:
        """Links (a, b) of each node to the first of its class, inside each group."""
        group = group.sort_by([("root", "ascending"), ("node", "ascending")])
        roots, names, data = group["root"].to_numpy(), group["node"].to_numpy(), group["data"].to_pylist()
        at = np.concatenate([[0], np.flatnonzero(np.diff(roots)) + 1, [len(roots)]])
        left, right = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            once = [k for k in range(a, b) if k == a or names[k] != names[k - 1]]
            if len(once) > 1:
                for i, r in zip(once, linked(sets_of([data[k] for k in once]), percent)):
                    if once[r] != i:
                        left.append(names[i])
                        right.append(names[once[r]])
        out = pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})
        del data, group
        free_memory()
        return out

    def search(placed: DataFrame) -> DataFrame:
        return cut(placed.select("node", "root", "task", "data").repartition(max(32, min(20_000, tasks // 2)), "task").groupBy("task").applyInArrow(find, "a long, b long"))

    links = search(held)
    alone = links.select(F.col("a").alias("node"), F.col("b").alias("class"))
    if (most or 0) <= BLOCK:  # every class was found whole, in one task
        return alone.unionByName(alone.select(F.col("class").alias("node"), "class").distinct())

    # the classes of a large group's blocks, by one node of each
    wide = placed.where("blocks is not null").select("node", "root", "n", "blocks", "block")
    data = held.where("blocks is not null").select("node", "data").dropDuplicates(["node"])
    local = cut(wide.join(alone, "node", "left").withColumn("class", F.coalesce("class", "node")))
    firsts = local.where("node = class").select("node", "root", "n")
    rounds = firsts.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("chunks"))
    firsts = join_one(firsts, rounds, "root").withColumn("task", F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("chunks"))))
    links = links.unionByName(search(firsts.join(data, "node")))
    labels = components(links).withColumnRenamed("root", "class")
    # nodes outside their group's largest class are searched for in all of its blocks
    local = cut(wide.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node")))
    largest = local.groupBy("root", "class").agg(F.count("*").alias("members")).groupBy("root").agg(F.max(F.struct("members", F.col("class"))).alias("x")).select("root", F.col("x.class").alias("main"))
    rest = cut(join_one(local, largest, "root").where("class <> main").select("node", "root", "n", "blocks"))
    ask = cut(rest.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("chunks")))

    def probe(group: pa.Table) -> pa.Table:
        """Links of the nodes asked for with those of a block."""
        base, query = (group.filter(pc.equal(group["query"], q)) for q in (False, True))
        left, right = [], []
        if len(base) and len(query):
            names, sets = base["node"].to_numpy(), sets_of(base["data"].to_pylist())
            lists = Inverted(sets)
            for node, grams in zip(query["node"].to_pylist(), sets_of(query["data"].to_pylist())):
                for k, both in lists.search(grams, needed(len(grams), percent)):
                    if names[k] != node and fits(len(grams), len(sets[k]), both, percent):
                        left.append(node)
                        right.append(names[k])
        out = pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})
        free_memory()
        return out

    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    queries = join_one(rest, ask, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("block", span("blocks"))
    base = join_one(local, ask, "root").where("chunks is not null").withColumn("chunk", span("chunks"))
    both = queries.select("node", "root", "block", "chunk", F.lit(True).alias("query")).unionByName(base.select("node", "root", "block", "chunk", F.lit(False).alias("query")))
    more = cut(both.join(data, "node").groupBy("root", "block", "chunk").applyInArrow(probe, "a long, b long"))
    if more.limit(1).count() == 0:
        return labels
    return components(links.unionByName(more)).withColumnRenamed("root", "class")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates, with the columns of docs: of each component one row stays, of the smallest id, null last,
    then hash of the text. Rows without words are no duplicates; of those that repeat an id, one stays, and all of a null id.

    Rows that could go, and those that share id and text with others, are joined with what is known of them; the others stay in place.
    """
    found = cut(similar_documents(docs, n, percent))
    blank = F.col("n_shingles") == 0
    same = found.groupBy("did", "key").agg(F.count("*").alias("rows"), F.max(blank).alias("blank"), F.max("first").alias("first"))
    same = same.where(~(F.col("blank") & (F.col("did") == LAST)))
    stays = F.col("blank") | (F.col("first") == F.struct("did", "key"))
    special = cut(same.withColumn("stays", stays).where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("did").alias("__did"), F.col("key").alias("__key"), F.col("stays").alias("__stays")))
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn("__did", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    keyed = maybe_among(keyed, F.xxhash64("__did", "__key"), special.select(F.xxhash64("__did", "__key").alias("name")), special.count())
    # copies that go are found by a join; of the rows that repeat an id and a text the first one stays
    met = keyed.where("__among").join(special, ["__did", "__key"], "left")
    row = Window.partitionBy("__did", "__key").orderBy(*[c for c in names if c != "`text`"])
    once = met.where("__stays").withColumn("__row", F.row_number().over(row)).where("__row = 1")
    return keyed.where("not __among").select(*names).unionByName(met.where("__stays is null").select(*names)).unionByName(once.select(*names))
