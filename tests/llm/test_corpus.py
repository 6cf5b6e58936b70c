"""Operators that compare texts or vectors with each other, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrystone.llm import components, hash_forest, jaccard_join, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus(seed):
    """Unique, copied and edited texts, shared passages, repeats inside a text, and edge cases."""
    rng = random.Random(seed)
    texts = [" ".join(prose(rng, rng.randrange(1, 150))) for _ in range(40)]
    passage = prose(rng, 60)
    for _ in range(6):
        texts.append(" ".join(prose(rng, 20) + passage[rng.randrange(10) :] + prose(rng, 20)))
    base = prose(rng, 200)
    for _ in range(12):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(200)] = "edit%d" % rng.randrange(10**6)
        texts.append(" ".join(t))
    inner = prose(rng, 40)
    texts += [" ".join(inner + ["x"] + inner), texts[0], texts[0], " ".join(["la"] * 100), "one two", "one two", "a b c", "", None, None, " \t\n", " ".join(prose(rng, 20_000))]
    texts += ["\t".join(passage), "é" + " ".join(passage[:36]) + "\x0b" + "ö"]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[1], "en", "s", 1), (3, texts[3], None, None, None), (3, texts[3], None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("key", "size", "starts", "anchors", "at", "_at", "mark", "n", "h1", "packed", "root", "number", "copies")})


# substrings


def without_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("seed", "window", "period"), [(1, 35, 21), (2, 35, 13), (3, 10, 7), (4, 5, 1), (5, 3, 3)])
def test_substrings(spark, seed, window, period):
    rows = corpus(seed)
    got = substring_dedup.remove_repeats(frame(spark, rows), window=window, period=period).collect()
    want = Counter((r[0], *w) for r, w in zip(rows, without_repeats([r[1] for r in rows], window)))
    assert Counter(map(tuple, got)) == want


def test_substrings_in_batches(spark):
    """Copies of one text over many partitions and rows, with another text that shares a passage."""
    rng = random.Random(9)
    a, b = prose(rng, 80), prose(rng, 30)
    rows = [(i, " ".join(a), "", "", 0) for i in range(300)] + [(1000 + i, " ".join(b + a[20:70] + [str(i)]), "", "", 0) for i in range(50)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows).repartition(7)).collect()}
    assert {got[i] for i in range(300)} == {(80, 80)} and {got[1000 + i] for i in range(50)} == {(81, 80)}


def test_substrings_of_nothing(spark):
    assert substring_dedup.remove_repeats(frame(spark, corpus(1)).limit(0)).count() == 0
    for p in range(1, 40):
        d = substring_dedup.difference_cover(p)
        assert {(a - b) % p for a in d for b in d} == set(range(p))


# links


def brute_links(rows, words=5):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, a in enumerate(sets):
        shared = Counter(j for x in a for j in holders[x])
        for x in a:
            holders[x].append(i)
        for j, both in shared.items():
            if both * 5 >= 4 * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    lead = defaultdict(list)
    for i, r in enumerate(rows):
        lead[find(i)].append(r[0])
    known = {k: min((x for x in v if x is not None), default=None) for k, v in lead.items()}
    return Counter((r[0], known[find(i)], links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("seed", "block"), [(1, None), (2, 1500)])
def test_links(spark, monkeypatch, seed, block):
    if block:  # so small that components are compared in several tasks
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(seed)
    got = jaccard_join.jaccard_join(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_links(rows)
    assert jaccard_join.jaccard_join(frame(spark, rows).limit(0)).count() == 0


def test_forest_recall():
    """Pairs just at the threshold, 160 of 200 shared, are found at the shortest prefix, and as often as expected at the longest."""
    floor = jaccard_join.prefix_length()
    assert jaccard_join.found_share(0.8, floor) >= jaccard_join.RECALL > jaccard_join.found_share(0.8, floor + 1)
    rng, forest = np.random.default_rng(3), jaccard_join.Forest(jaccard_join.TREES, jaccard_join.LONGEST, floor)
    found = Counter()
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 160, "u8")
        (k, x), (m, y) = (forest.strings(np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 20, "u8")]))) for _ in range(2))
        shared = np.where(k == m, floor + np.cumprod(x == y, axis=1).sum(axis=1), 0).max()
        found.update(range(floor, shared + 1))
    assert found[floor] >= 297 and abs(found[jaccard_join.LONGEST] / 300 - jaccard_join.found_share(0.8, jaccard_join.LONGEST)) < 0.05


def test_prefixes_shorten_as_the_data_ask():
    shorten = lambda counts: jaccard_join.shortened(counts, 10, 6, 32, 0.9999)
    assert shorten({0.98: 500}) == 10 and shorten({0.8: 5, 0.98: 500}) < 10 and shorten({0.8: 500}) == 6 and shorten({}) == 6
    # Of links at one similarity the estimate is the chance itself.
    assert abs(jaccard_join.estimated_recall({0.8: 7}, 10, 8) - jaccard_join.found_share(0.8, 8)) < 1e-12


@pytest.mark.parametrize(("longest", "floor"), [(7, 4), (6, 4), (4, 4)])
def test_prefix_links(spark, longest, floor):
    """At each length the links connect just the strings under one node of a trie."""
    rng, trees, rows = random.Random(longest), 3, []
    for number in range(200):
        rest = [[rng.choice([7, 2**31 + 3, 2**32 - 1]) for _ in range(longest - floor)] for _ in range(trees)]
        keys = [t * 10 + rng.randrange(3) for t in range(trees)]
        rows.append((number, keys, jaccard_join.packed(np.array(rest, "u4").reshape(trees, -1)).ravel().tolist(), rest))
    df = spark.createDataFrame([r[:3] for r in rows], "number long, keys array<long>, rest array<long>").repartition(3)
    links = jaccard_join.prefix_links(df, trees, longest, floor).collect()
    for depth in range(floor, longest + 1):
        want, got = {}, {}
        for parent, edges in ((got, [(r.a, r.b) for r in links if r.depth >= depth]), (want, [])):
            if parent is want:
                first = {}
                for number, keys, _, rest in rows:
                    for t in range(trees):
                        edges.append((number, first.setdefault((keys[t], *rest[t][: depth - floor]), number)))

            def find(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for a, b in edges:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
            for x in range(200):
                parent[x] = find(x)
        assert got == want


def test_recall_on_documents(spark):
    """All pairs of the driver's documents, by brute force."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = Counter(map(tuple, jaccard_join.jaccard_join(docs).collect()))
    assert sum((got & brute_links(rows)).values()) == len(rows)


def test_one_of_each(spark):
    rows = corpus(3)
    kept = jaccard_join.one_of_each(frame(spark, rows))
    got = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    classes = {(d, c) for d, c, _ in brute_links(rows)}
    want = sorted((False, d) for d, c in classes if d is not None and d == c)
    assert [x for x in got if not x[0]] == want and "key" in kept.columns


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)] + [(1000, 1000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# neighbours


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16)).astype("f4")
    x[100:160] = 5 * x[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] + [1.0] * 15, 0), (2060, [float("inf")] + [1.0] * 15, 0), (2080, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), rows[0], rows[1]]
    rows += [(3000, [1.0, 2.0], 0), (3001, [2.0, 1.0], 0), (3020, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rank": F.lit(1), "score": F.lit(2)})
    got = defaultdict(list)
    for r in hash_forest.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {*range(0, 900, 20), 3000} and [v[1] for v in got[3000]] == [3001]
    near = x.astype("f8") @ x.astype("f8").T
    hits = 0
    for q in range(0, 900, 20):
        assert [v[0] for v in got[q]] == list(range(1, 21))
        assert [v[1:] for v in got[q]] == sorted((v[1:] for v in got[q]), key=lambda v: (-v[1], v[0]))
        assert all(abs(s - near[q, v]) < 1e-9 and v != q for _, v, s in got[q])
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-round(near[q, i], 12), i))[:20]
        hits += len({v[1] for v in got[q]} & set(order))
    assert hits >= 0.9 * 45 * 20
    assert [v[1] for v in got[100]][:20] == list(range(101, 121))
    assert hash_forest.nearest(df.limit(0)).count() == 0 and hash_forest.nearest(df.where("vec_id = 1")).count() == 0


def test_nearest_of_unequal_lengths(spark):
    """The inner product prefers long vectors, which angles alone do not find."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24)) * rng.lognormal(0, 1, 3000)[:, None]
    got = hash_forest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    hits = sum(r.vec_id in set(np.argsort(-near[r.query_id])[:20].tolist()) for r in got)
    assert len(got) == 3000 and hits >= 0.9 * 3000


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK", 200)
    monkeypatch.setattr(hash_forest, "CHUNK", 10)
    x = np.random.default_rng(5).standard_normal((1000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hash_forest.nearest(df).collect()
    near = x @ x.T
    np.fill_diagonal(near, -99)
    hits = sum(r.vec_id in set(np.argsort(-near[r.query_id])[:20].tolist()) for r in got)
    assert len(got) == 1000 and hits >= 900


# pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words = prose(rng, 120)
        if i % 6 == 0:
            for _ in range(5):
                words[rng.randrange(120)] = rng.choice(["idiot", "clown", "scum"])
        rows.append((i, "menu of the site\n" + " ".join(words) + "\n" + ("token=abcdefghijklmnop" if i == 7 else ""), "en", "s", 1))
    rows += [(500 + i, rows[i][1], "en", "s", 1) for i in (1, 2)] + [(700, None, "en", "s", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "secret_scan", "packing"]
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in calm.collect()} == {r[0] for r in rows if r[0] >= 240 or r[0] % 6}
    plain = {r.doc_id: r for r in stages["line_dedup"](spark, calm, str(tmp_path)).collect()}
    assert len(plain) == calm.count() and not any("menu" in (r.text or "") for r in plain.values()) and all(r.n_chars == len(r.text) for r in plain.values() if r.text is not None)
    single = stages["jaccard_join"](spark, calm, str(tmp_path))
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in calm.collect()} - {501, 502}
    safe = {r.doc_id: r.text for r in stages["secret_scan"](spark, single, str(tmp_path)).collect()}
    assert "abcdefghijklmnop" not in safe[7] and "[SECRET]" in safe[7] and safe[8] == rows[8][1] and safe[700] is None
    for f in list(stages.values())[:-1]:
        assert f(spark, docs, str(tmp_path)).columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(safe)
