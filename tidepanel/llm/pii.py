"""Personal data: patterns for known forms, and bootstrapped contexts that find what has none of them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_memory, join_one

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits that failed from its start
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_TRIM = "\"'.,;:!?()[]{}<>*#%&$|"
_PIECE = re.compile(r"\+?[0-9][0-9().+-]*")
_GAP = re.compile(r"\)?[\x20\t\xa0]\(?")
_DIGIT_RUN = re.compile(r"[0-9]+")
_LETTER_RUN = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the whole run before it, as the run can't go on past the @."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            low = m.end()
            found.append((start, low))
        at = text.find("@", max(at + 1, low))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Of the four known forms, by kind and then start."""
    spans = [("email", *s) for s in emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def shape(token: str) -> str:
    """The kind that a token of no known form could still be, or other."""
    digits = sum(c in "0123456789" for c in token)
    if "@" in token:
        return "email" if token.strip("@") else "other"
    if not digits or any(c.isalpha() for c in token) and ":" not in token:
        return "other"
    if token.count(".") == 3 or token.count(":") >= 3:
        return "ip"
    return digits_kind(digits)


def form(token: str) -> str:
    """The shape of a token's characters: runs of digits by length, runs of letters as one a, other signs as they are."""
    out = _LETTER_RUN.sub("a", token)
    out = _DIGIT_RUN.sub(lambda m: f"9{{{len(m[0])}}}", out)
    return out if len(out) <= 60 else hashlib.blake2b(out.encode(), digest_size=16).hexdigest()


def word_class(word: str) -> str:
    """- for none, 9 for one with a digit, A for one with a capital first, a for other words, . for signs."""
    if not word:
        return "-"
    if any(c in "0123456789" for c in word):
        return "9"
    first = word.strip(_TRIM)[:1]
    return "." if not first.isalpha() else "A" if first.isupper() else "a"


def contexts(text: str, items: list[tuple[str, int, int]]) -> list[list[str]]:
    """Lexical patterns of each of the spans (kind, start, end), from narrow to wide: the two words before it; the word before it and the
    word after it; either of these; and for what could be an identifier its form, by itself, between the classes of the words beside it,
    and with its place in the line. Case and edge signs of words don't count. A word ends at white space or where another span does."""
    if not items:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends = [t[0] for t in tokens], sorted({e for _, _, e in items})
    begins = sorted({s for _, s, _ in items})
    clean = lambda w: w.strip(_TRIM).lower() or "-"
    out = []
    for kind, start, end in items:
        k = bisect_right(starts, start) - 1
        j = bisect_right(ends, start) - 1
        low = max(tokens[k][0], ends[j] if j >= 0 else 0)
        words = [text[low:start]] if low < start else []
        words += [text[a:b] for a, b in reversed(tokens[max(0, k - 2 + len(words)) : k])]
        one, two = (words + ["", ""])[:2]
        last = bisect_right(starts, end - 1) - 1
        if end < tokens[last][1]:
            j = bisect_left(begins, end)
            after = text[end : min(tokens[last][1], begins[j] if j < len(begins) else len(text))]
        else:
            after = text[slice(*tokens[last + 1])] if last + 1 < len(tokens) else ""
        before, behind = clean(one), clean(after)
        found = [f"{clean(two)} {before} _", f"{before} _ {behind}", f"{before} _", f"_ {behind}"]
        if kind != "other":
            shaped = form(text[start:end])
            line = "^" if not one or "\n" in text[tokens[k - 1][1] if k and low == start else low : start] else "|"
            found += [f"= {shaped}", f"{word_class(one)} = {shaped} {word_class(after)}", f"{line} = {shaped}"]
        out.append(found)
    return out


def digits_kind(n: int) -> str:
    return "card" if 12 <= n <= 19 else "phone" if 7 <= n <= 11 else "other"


def joined(text: str, pieces: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Adjacent tokens as one candidate, with a parenthesis whose other half is in it."""
    start, end = pieces[0][0], pieces[-1][1]
    n = sum(c in "0123456789" for c in text[start:end])
    if start and text[start - 1] == "(" and ")" in text[start:end]:
        start -= 1
    if text[start:end].count("(") > text[start:end].count(")") and text[end : end + 1] == ")":
        end += 1
    return digits_kind(n), start, end


def candidates(text: str, spans: list[tuple[str, int, int]], parts: bool = False) -> list[tuple[str, int, int]]:
    """What has a digit or @ outside the known spans, with the kind it could be: tokens, trimmed, and runs of adjacent tokens of digits
    that could be a card or a phone. Tokens in such a run that are of no kind themselves are left out. With parts, what could be
    one inside a run comes too."""
    taken = sorted((s, e) for _, s, e in spans)
    out, k = [], 0
    run: list[tuple[int, int]] = []

    def end_run() -> None:
        whole = joined(text, run) if len(run) > 1 else ("other", 0, 0)
        for s, e in run:
            kind = shape(text[s:e])
            if kind != "other" or whole[0] == "other":
                out.append((kind, s, e))
        if whole[0] != "other":
            out.append(whole)
        for i in range(len(run) - 1 if parts else 0):
            for j in range(i + 2, min(len(run), i + 19) + 1):  # each has a digit, and 19 are the most
                if j - i < len(run) and (part := joined(text, run[i:j]))[0] != "other":
                    out.append(part)
        run.clear()

    for m in _TOKEN.finditer(text):
        if not _MARK.search(text, *m.span()):
            continue
        token = m[0].strip(_TRIM)
        if not token:
            continue
        start = m.start() + m[0].index(token)
        end = start + len(token)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        piece = _PIECE.fullmatch(token)
        if run and not (piece and start - run[-1][1] <= 3 and _GAP.fullmatch(text, run[-1][1], start)):
            end_run()
        if piece:
            run.append((start, end))
        else:
            out.append((shape(token), start, end))
    end_run()
    return out


def longest(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of spans that overlap, the longest, of these the first."""
    out, group, reach = [], [], 0

    def end_group() -> None:
        chosen: list[tuple[str, int, int]] = []
        for x in sorted(group, key=lambda x: (x[1] - x[2], x[1], x[0])):
            if all(x[2] <= s or e <= x[1] for _, s, e in chosen):
                chosen.append(x)
        out.extend(chosen)
        group.clear()

    for x in sorted(found, key=lambda x: x[1]):
        if x[1] >= reach:
            end_group()
        group.append(x)
        reach = max(reach, x[2])
    end_group()
    return out


def context_graph(docs: DataFrame) -> DataFrame:
    """Edges of the graph of patterns and instances over all documents: pattern, kind, instance, seed, n. Counts are added up in a batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: Counter = Counter()
            for t in batch.column("text"):
                text = t.as_py() or ""
                spans = base_spans(text)
                for seed, found in ((True, spans), (False, candidates(text, spans))):
                    for (kind, start, end), patterns in zip(found, contexts(text, found), strict=True):
                        name = hashlib.blake2b(text[start:end].encode(), digest_size=12).hexdigest()
                        for pattern in patterns:
                            edges[pattern, kind, name, seed] += 1
            columns = list(zip(*[(*k, n) for k, n in edges.items()], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()], strict=True)], ["pattern", "kind", "instance", "seed", "n"])
        free_memory()

    return docs.select("text").mapInArrow(run, "pattern string, kind string, instance string, seed boolean, n long").groupBy("pattern", "kind", "instance", "seed").agg(F.sum("n").alias("n"))


def bootstrap(graph: DataFrame, rounds: int | None = None, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """Scores patterns and instances in turns, until no more patterns are trusted, and returns those: pattern, kind, confidence, support.

    A pattern's confidence for a kind is the share, by trust, of its occurrences that are of that kind; seeds have trust 1 and other
    instances the noisy-or of the trusted patterns they occur in. A trusted pattern has at least `support` trusted instances and
    `confidence`; all of them are kept, also those that no seed stands in and only found instances lead to. Trust never falls from
    round to round, so the rounds end. Frequent patterns are joined with their totals by broadcast.
    """
    graph = cut(graph)
    # only what could be trusted if all of its instances were; this drops no pattern that a later round can reach
    able = graph.groupBy("pattern", "kind").agg(F.sum("n").alias("own"), F.count("*").alias("most"))
    totals = able.groupBy("pattern").agg(F.sum("own").alias("all"))
    able = able.where(F.col("kind").isin(*KINDS) & (F.col("most") >= support)).join(totals, "pattern").where(F.col("own") / F.col("all") >= confidence)
    able = cut(able.select("pattern", "kind", "all", F.xxhash64("pattern", "kind").alias("pair")))
    edges = graph.withColumn("pair", F.xxhash64("pattern", "kind"))
    edges = cut(join_one(edges, able.select("pair", "all"), "pair").where(F.col("all").isNotNull() & F.col("kind").isin(*KINDS)).drop("pair"))
    seeds = cut(graph.where("seed").select("kind", "instance").distinct().withColumn("trust", F.lit(1.0)))
    trust, known = seeds, -1
    while True:
        scored = edges.join(trust, ["kind", "instance"], "left").withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))))
        patterns = cut(
            scored.groupBy("pattern", "kind")
            .agg((F.sum(F.col("trust") * F.col("n")) / F.max("all")).alias("confidence"), F.count_if(F.col("trust") >= confidence).alias("support"))
            .where((F.col("confidence") >= confidence) & (F.col("support") >= support))
        )
        rounds = None if rounds is None else rounds - 1
        before, known = known, patterns.count()
        if known == before or known == 0 or rounds == 0:
            return patterns
        found = edges.where(~F.col("seed")).join(patterns.select("pattern", "kind", "confidence"), ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("trust"))
        trust = cut(seeds.unionByName(found).groupBy("kind", "instance").agg(F.max("trust").alias("trust")))


def asked_for(text: str, base: list[tuple[str, int, int]]) -> list[tuple[tuple[str, int, int], list[str]]]:
    """What could be personal data, with the patterns that could say so. Of what lies inside a run of digits only the words beside it
    count, not its form: any run has parts of many forms."""
    could = [x for x in candidates(text, base, True) if x[0] in KINDS]
    whole = set(candidates(text, base)) if could else ()
    return [(x, c if x in whole else c[:4]) for x, c in zip(could, contexts(text, could), strict=True)]


def named(kind: str, pattern: str) -> bytes:
    """16 bytes that stand for a pattern of a kind."""
    return hashlib.sha256(f"{kind} {pattern}".encode()).digest()[:16]


def find_pii(docs: DataFrame, few: int = 500_000, **settings) -> DataFrame:
    """docs with spans: array of (kind, start, end, found), by kind as in KINDS, then start; offsets in code points, end exclusive.

    Known forms come first; found spans are tokens, or adjacent tokens of digits, of a fitting shape in a trusted context. They never
    overlap known ones or each other: the longest stays.
    A null text has no spans; repeated rows give repeated results (and their contexts count again); an empty table gives no rows;
    a column named spans is replaced, other columns stay. Patterns learn from all documents. Up to `few` trusted patterns are broadcast,
    16 bytes each, and scanning needs no shuffle; more are joined with the candidates, with the same result, and the documents are
    written once and joined with what was found.
    """
    docs = docs.drop("spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.bool_())]))
    return scanned(docs, lambda texts, spans, columns: columns | {"spans": pa.array(spans, kind)}, "spans array<struct<kind:string,start:int,end:int,found:boolean>>", few, **settings)


def scanned(docs: DataFrame, finish: Callable, more: str = "", few: int = 500_000, **settings) -> DataFrame:
    """What finish(texts, spans, columns by name) makes of each batch of docs, in the pass that finds the spans: with one Python worker for a
    task, not one for the search and one for its use. The result has the columns of docs and those that `more` declares."""
    spark = docs.sparkSession
    names = docs.columns
    patterns = cut(bootstrap(context_graph(docs), **settings).select(F.unhex(F.substring(F.sha2(F.concat_ws(" ", "kind", "pattern").cast("binary"), 256), 1, 32)).alias("name")))
    many = patterns.count() > few
    shared = spark.sparkContext.broadcast(None if many else frozenset(bytes(r["name"]) for r in patterns.collect()))  # at most `few` rows

    def spans_of(text: str, good: Collection[bytes]) -> list[dict]:
        base = base_spans(text)
        spans = [(k, s, e, False) for k, s, e in base]
        if good:
            met = [x for x, patterns in asked_for(text, base) if any(named(x[0], c) in good for c in patterns)]
            spans += [(*x, True) for x in longest(met)]
            spans.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
        return [{"kind": k, "start": s, "end": e, "found": f} for k, s, e, f in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if many:
                good = [frozenset(x or ()) for x in batch.column("__good").to_pylist()]
            else:
                good = [shared.value] * batch.num_rows
            texts = batch.column("text").to_pylist()
            spans = [spans_of(t or "", g) for t, g in zip(texts, good, strict=True)]
            out = finish(texts, spans, {n: batch.column(n) for n in names})
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
        free_memory()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wanted = [], []
            for row, t in zip(batch.column("__row").to_pylist(), batch.column("text")):
                text = t.as_py() or ""
                own = {named(x[0], c) for x, patterns in asked_for(text, base_spans(text)) for c in patterns}
                rows += [row] * len(own)
                wanted += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(wanted, pa.binary())], ["__row", "name"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *([more] if more else [])])
    if many:
        docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()))  # written, so that ids stay
        met = docs.select("__row", "text").mapInArrow(asked, "__row long, name binary").join(patterns, "name")
        docs = docs.join(met.groupBy("__row").agg(F.collect_list("name").alias("__good")), "__row", "left")
    return docs.mapInArrow(run, fields)


def redact(docs: DataFrame, **settings) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; n_chars, where there is one, is the new length.

    A null text stays null; repeated rows give repeated rows; an empty table gives no rows; all columns stay, one named spans too."""

    def masked(texts: list, spans: list, columns: dict) -> dict:
        done = []
        for text, found in zip(texts, spans, strict=True):
            out, at = [], 0
            for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
                if x["start"] >= at:
                    out += [text[at : x["start"]], f"[{x['kind']}]"]
                at = max(at, x["end"])
            done.append(text if not out else "".join(out) + text[at:])
        new = {"text": pa.array(done, pa.string())}
        if "n_chars" in columns:
            new["n_chars"] = pa.array([None if t is None else len(t) for t in done], pa.int64()).cast(columns["n_chars"].type)
        return columns | new

    return scanned(docs, masked, **settings)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, numbers of known spans by kind, digest of known spans, all spans as text, of each row of what `find_pii` gives; without
    spans the counts are 0, the digest is that of no bytes and the text is empty."""
    spans = F.col("spans")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: ~s["found"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
