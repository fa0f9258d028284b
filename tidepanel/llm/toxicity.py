"""Toxicity by multiple-instance learning: sentences are the instances, noisy-or makes the document's probability."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, latest_per_worker

#: Words, or the ends of sentences.
_TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")
_PREFIXES = (4, 5, 6)
#: Fewer words than these join the next sentence.
_SHORT = 5


def word_features(word: str) -> list[str]:
    """The word, and its first letters (marked by a *) where it is longer."""
    return [word, *(word[:k] + "*" for k in _PREFIXES if len(word) > k)]


def sentences(text: str) -> Iterator[list[str]]:
    words: list[str] = []
    for t in _TOKENS.findall(text.lower()):
        if t in _ENDS:
            if len(words) >= _SHORT:
                yield words
                words = []
        else:
            words.append(t)
    if words:
        yield words


def _softplus(z: float) -> float:
    return z if z > 30 else log1p(exp(z))


@dataclass
class NoisyOr:
    """Sentence: sigmoid(bias + sum of weights). Document: 1 - product over sentences of (1 - sentence)."""

    bias: float
    weights: dict[str, float]
    kept: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        got = self.kept.get(w)
        if got is None:
            get = self.weights.get
            got = sum(get(f, 0.0) for f in word_features(w))
            if len(self.kept) > 100_000:
                self.kept.clear()
            self.kept[w] = got
        return got

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """The document's probability, and number and probability of sentences at 0.5 or more. Long texts are summed sentence by sentence."""
        known, word = self.kept, self.word
        base = _softplus(self.bias)
        loss, worst, z, k, words = 0.0, [], 0.0, 0, 0
        for t in [*_TOKENS.findall((text or "").lower()), ""]:
            if not t or t in _ENDS:
                if words >= _SHORT or not t and words:
                    if z:
                        loss += _softplus(self.bias + z)
                        if self.bias + z >= 0:
                            worst.append((k, 1 / (1 + exp(-self.bias - z))))
                    else:
                        loss += base
                    k, words, z = k + 1, 0, 0.0
            else:
                words += 1
                w = known.get(t)
                z += word(t) if w is None else w
        return 1 - exp(-loss), worst


def fit(rows: list[tuple[str, int]], features: int = 6000, steps: int = 150, ridge: float = 5e-5) -> NoisyOr:
    """Fits the sentence model to labels of documents by gradient steps on their likelihood (Adam, whole sample)."""
    rows = [(t or "", int(y)) for t, y in rows]
    pos = sum(y for _, y in rows)
    if not pos or pos == len(rows):
        p = (pos + 0.5) / (len(rows) + 1)
        return NoisyOr(log(p / (1 - p)), {})
    parsed = [list(sentences(t)) for t, _ in rows]
    counts = (Counter(), Counter())
    for doc, (_, y) in zip(parsed, rows, strict=True):
        counts[y].update({f for s in doc for w in set(s) for f in word_features(w)})
    neg = len(rows) - pos
    gain = {}
    for f in counts[1].keys() | counts[0].keys():
        a, b = counts[1][f], counts[0][f]
        if a + b >= 3:
            pa_, pb = (a + 0.5) / (pos + 1), (b + 0.5) / (neg + 1)
            gain[f] = abs(log(pa_ / pb)) * (abs(a / pos - b / neg)) ** 0.5
    names = sorted(gain, key=lambda f: (-gain[f], f))[:features]
    number = {f: k for k, f in enumerate(names)}
    cells, owner_s, owner_d = [], [], []
    plain = np.zeros(len(rows))
    n_s = 0
    for d, doc in enumerate(parsed):
        for s in doc:
            hit = [number[f] for w in s for f in word_features(w) if f in number]
            if hit:
                cells += hit
                owner_s += [n_s] * len(hit)
                owner_d.append(d)
                n_s += 1
            else:
                plain[d] += 1
    cells, owner_s, owner_d = np.array(cells, np.int64), np.array(owner_s, np.int64), np.array(owner_d, np.int64)
    y = np.array([v for _, v in rows], float)
    w, b = np.zeros(len(names) + 1), log(pos / len(rows)) - log(max(1.0, np.mean([len(p) for p in parsed])))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(owner_s, w[cells], n_s)
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        base = 1 / (1 + exp(-w[-1]))
        total = np.bincount(owner_d, np.logaddexp(0, z), len(rows)) + plain * np.logaddexp(0, w[-1])
        prob = np.clip(-np.expm1(-total), 1e-9, 1)
        pull = np.where(y > 0, -np.exp(-total) / prob, 1.0)
        grad_z = pull[owner_d] * p
        g = np.empty_like(w)
        g[:-1] = np.bincount(cells, grad_z[owner_s], len(names)) / len(rows) + ridge * w[:-1]
        g[-1] = (grad_z.sum() + (pull * plain).sum() * base) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return NoisyOr(float(w[-1]), {f: float(x) for f, x in zip(names, w, strict=False) if abs(x) > 1e-3})


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 100_000) -> NoisyOr:
    """Fits on at most per_class toxic and 2 * per_class other labelled documents outside the held-out quarter, those whose
    id hashes lowest, of at most `longest` bytes each: the sample is bounded by these parameters, in rows and in bytes, whatever the
    tables' size. The model has at most the 6000 words and beginnings of words that tell the labels apart best. Every document, of any
    length, is scored with it."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = F.broadcast(pick(1, per_class).unionByName(pick(0, 2 * per_class)))  # at most 3 * per_class rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, "doc_id").where(F.octet_length("text") <= longest).dropDuplicates(["doc_id", "toxic"]).select("doc_id", "text", "toxic").collect()
    return fit([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500) -> DataFrame:
    """docs with held_out, score, predicted and worst (numbers of sentences that are toxic by themselves, with their probability).

    Scores come from the text alone. A null or empty text has no sentence and scores 0; repeated rows score alike; labels that are
    null, neither 0 nor 1, or of unknown documents don't count; a doc_id with both labels counts with both; of rows that repeat an id one
    is learnt from; without usable labels of both kinds every sentence gets the base rate. A null doc_id isn't held out and has no
    label. An empty table gives no rows. Columns of docs stay; those of these names go.
    """
    spark = docs.sparkSession
    fitted, token = train(docs, labels, per_class), uuid4().hex
    plain = spark.sparkContext.broadcast((fitted.bias, fitted.weights))  # bounded by the number of features; plain data, so that workers need no import
    docs = docs.drop("held_out", "score", "predicted", "worst").withColumn("held_out", held_out())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = latest_per_worker(token, lambda: NoisyOr(*plain.value))
        for batch in batches:
            got = [model.score(t.as_py()) for t in batch.column("text")]
            score = pa.array([g[0] for g in got], pa.float64())
            worst = pa.array([[{"sentence": k, "p": p} for k, p in g[1]] for g in got], pa.list_(pa.struct([("sentence", pa.int32()), ("p", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, score, pa.array([int(g[0] >= threshold) for g in got], pa.int32()), worst], [*names, "score", "predicted", "worst"])
        free_memory()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int, worst array<struct<sentence:int,p:double>>")
