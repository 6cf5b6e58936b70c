"""Spelling variants, token counts and vector codes against brute force and the library."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.llm import spelling, token_counts, vector_codes
from quarrystone.llm.registry import tokenizer_path

# spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, every=199, least=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            i = h % len(run)
            counts[run[:i] + run[i + 1 :] if h % every == 0 else run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    beside, forms = defaultdict(list), {}
    for a, b in itertools.combinations(known, 2):
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    for w, n in known.items():
        best = min(beside[w], key=lambda b: (-known[b], b), default=None)
        forms[w] = best if best and known[best] >= 5 * n else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, forms[w] or "", root(w), n, len(beside[w]), known.get(forms[w], 0)) for w, n in known.items())


def variants(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, N int")
    got = spelling.spelling_variants(docs.repartition(3) if rows else docs, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got.collect())


def letters(rng, n, of="ab"):
    return "".join(rng.choice(of) for _ in range(n))


@pytest.mark.parametrize(("seed", "most"), [(1, 2000), (2, 2), (3, 7)])
def test_variants(spark, seed, most):
    """Words over two letters: nearly all have neighbours, runs of one letter among them, and every partition is split if ``most`` is small."""
    rng, rows = random.Random(seed), []
    words = [letters(rng, rng.randrange(5, 11), "aab" + "é" * (seed == 3)) for _ in range(150)] + ["a" * k for k in range(5, 12)]
    for i in range(60):
        texts = " ".join(rng.choice([w, w.upper(), w + "1"]) for w in rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=60))
        rows.append((i if i % 9 else None, texts, "x", i))
    rows += [(7, None, None, None), (8, "", "", 0), (9, "÷×" * 3 + " ÷×÷×÷a" * 30, "", 0), rows[5], rows[5]]
    want = brute_variants([r[:2] for r in rows], every=19)
    assert variants(spark, rows, every=19, most=most) == want
    assert len(want) > 50


def test_variants_of_long_words_and_nothing(spark):
    long = letters(random.Random(5), 30_000, "abcdefgh")
    cut = long[:17_000] + long[17_001:]
    rows = [(1, f"{long} " * 25 + f"{cut} " * 5, "", 0)]
    want = brute_variants([r[:2] for r in rows])
    assert {(len(r[0]), r[3], r[4]) for r in want} == {(30_000, 25, 1), (29_999, 5, 1)}
    assert variants(spark, rows) == want
    assert variants(spark, []) == [] and variants(spark, [(1, "12 34", "", 0), (2, None, "", 0)]) == []


def test_forms_of_forms(spark):
    rows = [(i, " ".join(["abcdef"] * 5 + ["abcdxf"] * 30 + ["abzdxf"] * 200 + ["abzdyf"] * 200), "", 0) for i in range(2)]
    got = variants(spark, rows, every=10**9)
    assert got == brute_variants([r[:2] for r in rows], every=10**9)
    assert ("abcdef", "abcdxf", "abzdxf", 10, 1, 60) in got and ("abzdyf", "", "abzdyf", 400, 1, 0) in got


def test_chains(spark):
    links = [("w%02d" % i, "w%02d" % (i + 1) if i < 13 else None) for i in range(14)]
    got = spelling.roots(spark.createDataFrame(links, "word string, form string"), 13).collect()
    assert {tuple(r) for r in got} == {(w, "w13") for w, _ in links}


def test_trie_pairs():
    rng = random.Random(4)
    words = {letters(rng, rng.randrange(0, 5), "abc") for _ in range(90)}
    trie = spelling.Trie()
    for w in words:
        trie.add(w, w)
    got = Counter(trie.pairs())
    assert got == Counter((a, b) for a in words for b in words if near(a, b))


def test_hot_partition_is_split(spark):
    """20,000 words with one beginning and one end in common: no trie is larger than the bound."""
    rng, sizes = random.Random(6), []
    words = {"shared" + letters(rng, 4, "abcdefghijklmnop") + "ending" for _ in range(20_000)}
    table = spark.createDataFrame([(w, 5 + len(w) % 3) for w in words], "word string, n long")
    got = {r.word: r.n_near for r in spelling.near_words(table, most=300).collect()}
    found = Counter()
    for w in words:
        for i in range(6, 10):
            for c in "abcdefghijklmnop":
                found[w] += (v := w[:i] + c + w[i + 1 :]) != w and v in words
    assert got == {w: n for w, n in found.items() if n}


# token counts


@pytest.fixture(scope="module")
def model():
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def counter(model):
    return token_counts.Counter(model)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" ▁aeitnsrhl'\n\t.,0129éß日本語😀\x00אب")) | st.characters(blacklist_categories=["Cs"]), max_size=60), max_size=8))
def test_counts_as_the_library(counter, library, texts):
    assert counter.count_many(texts) == [len(x) for x in library.encode(texts)]


def test_counts_of_dense_texts(counter, library):
    """Runs without spaces over few letters, where pairs wait for one another."""
    rng = random.Random(2)
    texts = [letters(rng, rng.randrange(2000), a) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "et ionis", "  x", "0123456789 .-", " ▁") for _ in range(40)]
    assert counter.count_many(texts) == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 200_001, "ab" * 200_000, "日" * 100_000, "x  y " * 300_000, "</s><s><unk>" * 1000])
def test_counts_of_long_texts(counter, library, text):
    assert counter.count_many([text]) == [len(library.encode(text))]


def test_counts_pair_by_pair(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "SLOW", 0)
    texts = ["what is written here", "antidisestablishmentarianism" * 9, "    four  two ", letters(random.Random(8), 900, "etaoins")]
    assert token_counts.Counter(tokenizer_path("piece_bpe_32k.model")).count_many(texts) == [len(x) for x in library.encode(texts)]


def test_count_rows(spark, model, library):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "word " * 5000, *(letters(rng, rng.randrange(300), "ab é\n<s>") for _ in range(200))]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(docs.repartition(3), model=model)
    want = Counter((i, len((t or "").encode()), k := len(library.encode(t or "")), k > 4096) for i, t, _ in rows)
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(docs.limit(0), model=model).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(bytes([0x12, 2, 24, 1]))  # a unigram trainer
    with pytest.raises(ValueError, match="merge ranks"):
        token_counts.Counter(str(tmp_path / "m"))


# vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), n in zip(kept, near) if n[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    near, digest = assign(), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in n) for n in near]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return [(i, "".join(f"{j:02x}" for _, j in n), e, by_label[label], digest) for (i, _, label), n, e in zip(kept, near, errors)]


@pytest.mark.parametrize(("seed", "n", "entries", "spread"), [(1, 300, 24, 3), (2, 40, 64, 40), (3, 500, 9, 1000), (4, 200, 1, 5)])
def test_codes(spark, seed, n, entries, spread):
    """Few different values make many ties and equal entries; one vector is a third of all rows."""
    rng = random.Random(seed)
    rows = [(rng.randrange(2 * n), [rng.randrange(-spread, spread) / 256 + rng.choice([0, 1 / 1024]) for _ in range(8)], rng.choice([0, 1, None])) for _ in range(n)]
    rows += [(3 * n + i, rows[0][1], 1) for i in range(n // 2)] + [(None, rows[1][1], 0)]
    rows += [(-1, None, 0), (-2, [], 0), (-3, [None] * 8, 0), (-4, [math.nan, *rows[0][1][1:]], 0), (-5, [math.inf, *rows[0][1][1:]], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, x string").repartition(3)
    if seed == 3:  # labels may be texts
        table = table.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    got = vector_codes.vector_codes(table, parts=4, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_codes(rows, 4, entries, 2))


def test_codes_of_nothing_and_of_odd_vectors(spark):
    table = lambda *v: spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(table([1.0] * 16).limit(0)).collect() == [] == vector_codes.vector_codes(table(None, [math.nan] * 16)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(table([1.0] * 15))
    for odd, said in (([1.0] * 32, "must all have"), ([1e30] * 16, "beyond")):
        with pytest.raises(Exception, match=said):
            vector_codes.vector_codes(table([1.0] * 16, odd)).collect()


@pytest.mark.parametrize("count", [1, 2, 7, 64])
def test_half_bytes(count):
    levels = np.random.default_rng(count).integers(0, 16, (5, 3, count)).astype("u1")
    packed = vector_codes._packed(levels)
    assert packed.shape == (5, 3, (count + 1) // 2) and (vector_codes._unpacked(packed, count) == levels).all()


def test_bounds_prune():
    """Bounds of the round before leave out most comparisons and change nothing."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (1, 40, 4))
    x = (centres[0][rng.integers(0, 40, 3000)] + rng.integers(-200, 200, (3000, 4)))[:, None]
    books = vector_codes.Codebooks(centres)
    code, upper, lower = np.zeros((3000, 1), "i8"), np.full((3000, 1), np.inf), np.zeros((3000, 1, 40))
    first = books.assign(x, code, upper, lower)
    plain = ((x[:, :, None] - centres) ** 2).sum(3)
    assert (code == plain.argmin(2)).all() and (first == plain.min(2)).all()
    assert (lower * (1 - 1e-6) <= np.sqrt(plain)).all() and (upper >= np.sqrt(first)).all()
    later = vector_codes.Codebooks(centres + rng.integers(-9, 9, centres.shape), centres, books.unit)
    second = later.assign(x, code, upper, lower)
    plain = ((x[:, :, None] - later.entries) ** 2).sum(3)
    assert (code == plain.argmin(2)).all() and (second == plain.min(2)).all()
    assert later.compared < 0.05 * plain.size
