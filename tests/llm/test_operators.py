"""Operators against plain versions and on odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidepanel.llm import ann, bpe, html_extract, mixing, ngram_join, pii, substring_dedup, suffix_dedup, tiff, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(300)]
    out = [" ".join(r.choices(vocabulary, k=r.randint(0, 120))) for _ in range(n)]
    for k in range(0, n - 3, 3):
        words = out[k].split()
        if len(words) > 50:
            words[r.randrange(len(words))] = "changed"
            out[k + 1] = " ".join(words)
            out[k + 2] = out[k + 2] + "\n " + " ".join(words[5:45]) + " " + " ".join(words[5:45])
    return [*out, "", None, "  \n\t", "one", "ONE", "aaaa" * 60, "the same " * 80, out[0]]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(k * 3 % 71, t, "en", ["s1", "s2", None, "é"][k % 4], None if t is None else len(t), k) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < -1")


def rows_of(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def test_word_windows(docs, nothing):
    seen, want = set(), {}
    for d, t in rows_of(docs):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        want[d] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_windows(docs).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert substring_dedup.dedup_windows(nothing).count() == 0


def test_byte_windows(docs, nothing):
    seen, want = {}, {}
    for d, t in rows_of(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert suffix_dedup.dedup_bytes(nothing).count() == 0


@pytest.mark.parametrize("block", [3_000_000, 300])
def test_similar_documents(docs, nothing, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets, root = {}, {}
    for d, t in rows_of(docs):
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[d] = d
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    assert ngram_join.similar_documents(nothing).count() == 0
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {d for d in sets if find(d) == d}


def test_divide_skip_counts_exactly():
    r = np.random.default_rng(3)
    for _ in range(200):
        lists = [np.unique(r.integers(0, 40, r.integers(1, 60))) for _ in range(r.integers(1, 12))]
        t = int(r.integers(1, 6))
        count = np.bincount(np.concatenate(lists), minlength=40)
        assert dict(ngram_join.divide_skip(lists, t)) == {i: int(c) for i, c in enumerate(count) if c >= t}
        weights = r.integers(1, 5, len(lists)).tolist()
        again = [x for x, w in zip(lists, weights) for _ in range(w)]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ngram_join, "MERGED", 0)
            assert dict(ngram_join.divide_skip(lists, t)) == {i: int(c) for i, c in enumerate(count) if c >= t}
            assert dict(ngram_join.divide_skip(lists, 2 * t, weights)) == dict(ngram_join.divide_skip(again, 2 * t))
        assert dict(ngram_join.divide_skip(lists, 2 * t, weights)) == dict(ngram_join.divide_skip(again, 2 * t))
        assert dict(ngram_join.divide_skip([x.tolist() for x in lists], t, mu=0.9)) == {i: int(c) for i, c in enumerate(count) if c >= t}


def test_linked_sets_share_enough_first_grams():
    r = np.random.default_rng(9)
    for n in [*range(1, 40), 100, 333]:
        for _ in range(20):
            names = r.permutation(np.unique(r.integers(0, 1 << 62, 3 * n + 9).astype(np.uint64)))
            size = int(r.integers(n, n * 5 // 4 + 1))
            both = -(-80 * (n + size) // 180)  # the least overlap of a link
            if both > n:
                continue
            hot = np.sort(r.choice(names, n))
            a, b = names[:n], np.concatenate([names[:both], names[n : n + size - both]])
            first = [set(ngram_join.ordered(np.sort(x), hot)[: ngram_join.prefix_length(len(x), 80)].tolist()) for x in (a, b)]
            assert all(len(first[0] & first[1]) >= max(1, min(m // 5, -(-80 * m // 100) // 5)) for m in (n, size) if m == n or m * 80 <= n * 100), (n, size)


def test_bpe_equals_tiktoken(docs, nothing):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, r = bpe.ByteBPE(ranks, P.PATTERN), random.Random(5)
    for t in [*filter(None, texts()), "ab" * 5000, *("".join(r.choices("abz é\n0９中<|endoftext|>", k=50)) for _ in range(300))]:
        assert coder.encode(t) == other.encode_ordinary(t)
        assert coder.decode(coder.encode_packed(t)) == t.encode()
    got = {r["doc_id"]: r["decoded_sha256"] for r in bpe.encode_documents(docs, path, P.PATTERN).collect()}
    assert got == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows_of(docs)}
    assert bpe.encode_documents(nothing, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("how", [1, 5, 8, 32946, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_round_trip(how, predictor, tile):
    r = random.Random(how)
    for data in (r.randbytes(37 * 21 * 3), bytes(r.choices(b"ab", k=37 * 21 * 3))):
        image = np.frombuffer(data, np.uint8).reshape(37, 21, 3)
        pages = list(tiff.read_pages(tiff.write_tiff([(image, how, predictor), (image[:5], how, predictor)], 10, tile)))
        assert [p["pixels"] for p in pages] == [image.tobytes(), image[:5].tobytes()]


def test_tiff_tables(spark, docs, nothing):
    files = [(1, None), (2, b""), (3, b"II*\0\xff\xff\0\0"), (4, tiff.write_tiff([(np.zeros((2, 2, 1), np.uint8), 1, 1)] * 2))]
    got = tiff.tiff_pages(spark.createDataFrame(files, "media_id long, data binary")).collect()
    assert sorted((r["media_id"], r["page"], r["error"] is None) for r in got) == [(1, 0, False), (2, 0, False), (3, 0, False), (4, 0, True), (4, 1, True)]
    for r in tiff.media_digests(tiff.text_media(docs)).collect():
        raw = (dict(rows_of(docs))[r["doc_id"]] or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert tiff.media_digests(tiff.text_media(nothing)).count() == 0


def test_mix_meets_targets(spark, nothing):
    rows = [(k, " ".join(["w"] * (k % 7 + 1)), f"s{k % 5}" if k % 3 else "s0") for k in range(3000)] + [(None, "a b", None), (7, None, "s1"), (7, "a", "s1"), (7, "a", "s1")]
    out = mixing.mix_to_weights(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all()
    total = out["size"].sum()
    assert out["taken"].sum() <= 1.5 * total and out["taken"].sum() > 1.5 * total - 50
    by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 20).all()
    assert mixing.mix_to_weights(nothing).count() == 0


def test_pii_base_spans_equal_plain_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = lambda d: sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0
    fine = {"email": lambda t, d: True, "ip": lambda t, d: all(int(p) <= 255 for p in t.split(".")), "card": lambda t, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda t, d: 8 <= len(d) <= 15}
    r = random.Random(2)
    for _ in range(20000):
        t = "".join(r.choices("a.@1 2+-(40é", k=r.randint(0, 40)))
        want = [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, t) if fine[k](m[0], re.sub("[^0-9]", "", m[0]))]
        assert pii.base_spans(t) == want, t


def test_pii_learns_contexts(spark, nothing):
    rows = [(k, f"please call us at +1 (555) 555-{1000 + k} for more and mail a{k}@b.example.com today") for k in range(30)]
    rows += [(100, "please call us at 5550199 for more"), (101, "a number 5550199 of no kind"), (102, None), (103, "")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["start"], s["end"], s["found"]) for s in got[100]] == [("phone", 18, 25, True)]
    assert got[101] == [] and got[102] == [] and len(got[0]) == 2
    assert pii.find_pii(nothing).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == "please call us at [phone] for more" and out[102] is None


def test_pii_keeps_every_trusted_context(spark):
    graph = spark.range(20_500).selectExpr("explode(sequence(0, 2)) k", "concat('p', id, ' at _') pattern").selectExpr("pattern", "'phone' kind", "concat(pattern, k) instance", "true seed", "1L n")
    assert pii.bootstrap(graph, rounds=1).count() == 20_500


def test_pii_joins_contexts_that_are_many(spark):
    rows = [(k, f"please call us at +1 (555) 555-{1000 + k} for more and mail a{k}@b.example.com today") for k in range(30)]
    rows += [(100, "please call us at 5550199 for more"), (100, "please call us at 5550199 for more"), (None, "or call us at 5550198 for 5550197"), (101, "a number 5550199 of no kind"), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, joined = (sorted(map(repr, pii.find_pii(docs, few=few).collect())) for few in (500_000, 0))
    assert plain == joined and len(joined) == len(rows) and sum("found=True" in x for x in joined) == 3


def test_pii_reaches_contexts_without_seeds(spark):
    rows = [(k, f"please call us at +1 (555) 555-{1000 + k} for more") for k in range(60)]
    rows += [(100 + k, f"please call us at 555019{k} for more. Later the desk answers 555019{k} every day") for k in range(8)]
    rows += [(200, "In May the desk answers 5550777 every day")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == "In May the desk answers [phone] every day"


def test_pii_finds_what_is_written_with_spaces(spark):
    rows = [(k, f"please call us at +1 (555) 555-{1000 + k} for more") for k in range(30)]
    valid = [c for c in (f"4111 1111 1111 {k}" for k in range(1000, 1200)) if pii.luhn(c.replace(" ", ""))]
    rows += [(50 + k, f"we charge my card {c} today") for k, c in enumerate(valid)]
    rows += [(100, "please call us at (555) 555-1234 for more"), (101, "please call us at 555 123 4567 for more"), (102, "we charge my card 4111 1111 1111 1112 today")]
    rows += [(103, "please call us at 555 123 4567 2020 2021 2022 times"), (104, "in 2019 2020 2021 they won 12 (3) 45"), (105, "please call us at 555, 123 or 4567 for more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got[100] == got[101] == "please call us at [phone] for more"
    assert got[102] == "we charge my card [card] today"
    assert got[103] == "please call us at [phone] 2020 2021 2022 times"
    assert [got[k] for k in (104, 105)] == [dict(rows)[k] for k in (104, 105)]
    for spans in (r["spans"] for r in pii.find_pii(docs, few=0).collect()):
        ends = sorted((s["start"], s["end"]) for s in spans)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_pii_runs_take_time_in_proportion():
    text = "12 34 " * 50_000
    assert len(pii.candidates(text, [], True)) < 20 * 100_000


def test_toxicity_learns_from_documents(spark, nothing):
    r = random.Random(4)
    calm = lambda n: " ".join(r.choices(["alpha", "beta", "gamma", "delta", "omega", "sigma"], k=n)) + ". "
    rows = [(k, "".join(calm(8) for _ in range(r.randint(1, 30))) + ("you nasty fool. " if k % 4 == 0 else "") + calm(7)) for k in range(800)]
    rows += [(5000, None), (5001, "")]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)] + [(9999, 1), (3, None)], "doc_id long, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(table, labels).collect()}
    for k in range(800):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
    wrong = [k for k in range(800) if got[k]["held_out"] and got[k]["predicted"] != (k % 4 == 0)]
    assert not wrong
    assert got[0]["worst"] and got[5000]["score"] == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_main_text():
    page = "<html><head><title>x</title></head><body><nav><a href=1>Menu</a></nav><div class='ad'>Buy now, it is very cheap and good.</div><article><h1>Head &amp; tail</h1><p>First <b>bold</b>\n text that goes on for a while.<p>Short.</p><script>var a='</p>';</script></article><div id=comments>I disagree.</div><footer>&copy; me</footer></body>"
    assert html_extract.main_text(page) == "Head & tail\n\nFirst bold text that goes on for a while.\n\nShort."
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == "" and html_extract.main_text("<<<>>") is not None
    assert html_extract.main_text("<div>" * 5000 + "deep text here" + "</div>" * 5000) == "deep text here"


def test_neighbours(spark, nothing):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lists=16).toPandas()
    hits = total = 0
    wide = x.astype(float)
    for q in range(0, 600, 20):
        s = wide @ wide[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(s, 9)))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        np.testing.assert_allclose(mine["score"], wide[mine["vec_id"]] @ wide[q])
        hits += len(set(best) & set(mine["vec_id"]))
        total += 20
    assert hits / total >= 0.9
    assert set(got["query_id"]) == set(range(0, 600, 20))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def plain_linked(rows):
    """Smallest row of each component of (id, text), by sets of five words."""
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """run() against a plain version: the classifier's decisions are taken from its own scores, all else is done anew."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    r = random.Random(8)
    calm = lambda n: " ".join(r.choices([f"word{k}" for k in range(60)], k=n)) + ". "
    rows = [(k, "".join(calm(9) for _ in range(r.randint(1, 8))) + ("you nasty fool ugly brute. " * 2 if k % 4 == 0 else "") + (f" mail a{k}@b.example.com now" if k % 5 == 0 else ""), f"s{k % 3}" if k % 7 else None, k * 7) for k in range(160)]
    rows += [(1000 + k, rows[k][1] + (" one more" if k % 2 else ""), rows[k][2], -k) for k in range(1, 160, 9)] + [(2000, None, "s1", 1), (2001, "", "s1", 2), (2002, "  ", None, 3), (5, rows[5][1], rows[5][2], 35)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    calm_ids = {q["doc_id"] for q in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()}
    left = [q for q in rows if q[0] in calm_ids]
    assert {k for k in range(160) if k % 4 == 0} & calm_ids == set()
    assert len(calm_ids & {k for k in range(160) if k % 4}) > 110
    left.sort(key=lambda q: q[0])
    keep = plain_linked([(q[0], q[1]) for q in left])
    left = [q for i, q in enumerate(left) if keep[i] == i]
    assert sum(q[0] >= 1000 for q in left) <= 9
    mask = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    left = [(q[0], None if q[1] is None else mask.sub("[email]", q[1]), *q[2:]) for q in left]
    mixed = mixing.mix_to_weights(spark.createDataFrame(left, "doc_id long, text string, source string, score int")).collect()
    times = {q["doc_id"]: q["copies"] for q in mixed}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((q[0], len(ids := coder.encode_ordinary(q[1] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for q in left for _ in range(times[q[0]]))
    got = sorted((q["doc_id"], q["n_tokens"], q["ids_sha256"]) for q in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 50


def test_stages_keep_columns_and_values(spark, tmp_path, docs):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    named = docs.selectExpr("doc_id", "text", "source", "n_chars", "doc_id * 3 as score", "'x' as spans", "array(doc_id) as worst", "cast(doc_id as string) as Predicted")
    for empty in (False, True):
        left = named.where("doc_id < -1") if empty else named
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, str(tmp_path))
            assert left.columns == named.columns, name
            for q in left.collect():
                assert (q["score"], q["spans"], q["worst"], q["Predicted"]) == (q["doc_id"] * 3, "x", [q["doc_id"]], str(q["doc_id"])), name
        assert (left.count() == 0) == empty


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Operators that send models to workers, run where these can't import the package."""
    import subprocess
    import sys
    from pathlib import Path

    script = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from tidepanel.llm import ann, toxicity, html_extract, ngram_join
docs = spark.createDataFrame([(k, f"alpha beta gamma delta {k} " + ("nasty fool. " if k % 3 == 0 else "kind. ")) for k in range(60)], "doc_id long, text string")
labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
assert toxicity.score_toxicity(docs, labels).where("predicted = 1").count() >= 20
x = spark.range(80).selectExpr("id vec_id", "array(cast(id % 7 + 1 as float), cast(id % 5 as float)) embedding")
assert ann.search(x).where("rank = 1").count() == 4
assert ngram_join.similar_documents(docs).count() == 60
assert html_extract.extract_main_text(spark.createDataFrame([(1, "u", "<p>Some text.")], "page_id long, url string, html string")).first()["text"] == "Some text."
"""
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", script, repo], cwd=tmp_path, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-2000:]


def test_density_decides_what_is_text():
    long = [f"This line number {k} of the page goes on for quite a while and has no links in it." for k in range(6)]
    body = "".join(f"<p>{t}</p>" for t in long)
    links = "".join(f"<div><a href={k}>More {k}</a> <a href={k}>Next</a></div>" for k in range(12))
    # without an article: lists of links are left out by their ratio alone
    assert html_extract.main_text(f"<body>{links}<div>{body}</div>{links}</body>") == "\n\n".join(long)
    # with several: those that are mostly links go, short lines of the others stay
    page = f"<body><article>{links}</article><article><h1>Head</h1>{body}<p>Yes.</p></article><article><a href=1>Other</a> <a href=2>things</a></article></body>"
    assert html_extract.main_text(page) == "\n\n".join(["Head", *long, "Yes."])


def test_paragraphs_and_names_of_elements():
    assert html_extract.main_text('<article><p class="ad">Buy<p>The first text goes on for a while.<p>And the second.</article>') == "The first text goes on for a while.\n\nAnd the second."
    assert html_extract.main_text('<article><p class="share-price">The price of a share rose again.</p><p class="share-buttons">Tell all</p><p id="siteFooter">x</p></article>') == "The price of a share rose again."


def test_pages_equal_their_articles(spark):
    """Every page of a table against a plain reading of its article by patterns."""
    import html
    import os

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    pages = spark.read.parquet(path)
    got = {q["page_id"]: q for q in html_extract.extract_main_text(pages.withColumn("text", pages["url"])).collect()}
    for q in pages.collect():
        inside = re.sub(r"<br\s*/?>", "\n", re.search(r"<article>(.*?)</article>", q["html"], re.S)[1])
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[q["page_id"]]["text"] == "\n\n".join(x for x in parts if x) and got[q["page_id"]]["n_chars"] == len(got[q["page_id"]]["text"])
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((q["page_id"] or 0, q["text"]) for q in html_extract.extract_main_text(odd).collect()) == [(0, ""), (1, ""), (1, "x")]


def test_pii_learns_forms(spark):
    """A number that no fixed form takes, as another follows it, is found by the form it shares with known ones; numbers of a form that is
    as often none stay."""
    rows = [(k, f"w{k} +1 ({200 + k}) 555-{1000 + k} v{k}") for k in range(30)]
    valid = [f"411111111111{k}" for k in range(1000, 1400) if pii.luhn(f"411111111111{k}")][:20]
    wrong = [f"411111111111{k}" for k in range(1000, 1400) if not pii.luhn(f"411111111111{k}")][:20]
    rows += [(100 + k, f"u{k} {c} t{k}") for k, c in enumerate(valid)] + [(200 + k, f"q{k} {c} p{k}") for k, c in enumerate(wrong)]
    rows += [(300, "Here +1 (843) 555-7672 170.106.47.218 there")]
    got = {q["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in q["spans"] if s["found"]] for q in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(300) == [("phone", 5, 22)]
    assert not any(got.values())


def test_few_vectors_have_all_neighbours(spark):
    for n in (18, 30):
        rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(n).normal(size=(n, 8)))]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=1).toPandas()
        assert (got.groupby("query_id").size() == min(20, n - 1)).all() and got["query_id"].nunique() == n


def test_searches_move_few_rows(spark):
    """A query goes to each shard of lists once, and no vector to more lists than it gains from: moved rows don't grow with the lists searched."""
    x = np.random.default_rng(5).normal(size=(4000, 32)).astype(np.float32)
    sc = spark.sparkContext
    sc.setJobGroup("moved rows", "")
    try:
        got = ann.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), lists=128).toPandas()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("moved rows") for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert stages
    moved = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 4000 <= moved <= 5 * 4000
    wide = x.astype(float)
    hits = 0
    for q, mine in got.groupby("query_id"):
        s = wide @ wide[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(mine["vec_id"]))
        np.testing.assert_allclose(mine["score"], wide[mine["vec_id"]] @ wide[q])
    assert got["query_id"].nunique() == 200 and hits / 4000 >= 0.9


def test_neighbours_among_copies(spark):
    """Of many copies of a vector, those of the smallest ids; repeated rows count and ask once; a shard larger than one batch."""
    r = np.random.default_rng(6)
    base = r.normal(size=(40, 8)).astype(np.float32)
    base[1] = base[0] * np.float32(1 + 1e-6)
    rows = [(k, base[k % 40].tolist()) for k in range(6000)]
    rows += [rows[20]] * 30 + [(20, base[3].tolist()), (60, base[5].tolist()), (60, base[5].tolist()), (-40, base[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=64).toPandas()
    wide, by_id = base.astype(float), {}
    for k, v in rows:
        by_id.setdefault(k, set()).add(tuple(v))
    own = [(k, np.array(v, np.float64)) for k, vs in by_id.items() for v in vs]
    ids, x = np.array([k for k, _ in own]), np.stack([v for _, v in own])
    assert set(got["query_id"]) == {k for k in by_id if k % 20 == 0}
    for q in (-40, 0, 20, 40, 60, 1220, 5980):
        pairs = {(-float(np.einsum("j,j->", v, y)), int(k)) for v in x[ids == q] for k, y in zip(ids, x, strict=True) if k != q}
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        want = sorted((round(s, 9), k) for s, k in pairs)[:20]
        assert list(mine["vec_id"]) == [k for _, k in want], q
        np.testing.assert_allclose(mine["score"], [-s for s, _ in want], rtol=1e-7)


def test_unknown_sections_do_not_end_a_page():
    for odd in ("<![foo[ x>", "<![ x>", "<![>"):
        page = f"<article><p>The first text goes on for a while.</p>{odd}<p>The second text goes on for a while.</p></article>"
        assert html_extract.main_text(page).count("goes on") == 2, odd


def test_one_of_each_keeps_one_row(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (None, long), (None, long + " more"), (5, long.upper() + " a b c d e f"), (9, "x y z"), (9, "x y z"), (None, "p q r s t"), (None, "p q r s t"), (None, ""), (None, ""), (3, None)]
    other = " ".join(f"v{k}" for k in range(60))
    rows += [(7, other), (7, other + " more"), (8, other)]
    kept = [tuple(r) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [r for r in kept if r[1] and r[1].lower().startswith("w0 ")] == [rows[3]]
    assert sum(bool(r[1]) and r[1].startswith("v0 ") for r in kept) == 1 and kept.count((None, "p q r s t")) == kept.count((9, "x y z")) == 1
    assert kept.count((None, "")) == 2 and kept.count((3, None)) == 1 and len(kept) == 7
