"""The pipeline's stages against plain Python, and on nothing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quarrystone.llm import secret_scan, toxicity
from quarrystone.llm.registry import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    rng, rows = random.Random(21), []

    def prose(n):
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))

    for i in range(90):
        lines = ["menu of the site" if i % 3 else "another line", *[prose(12) for _ in range(8)], f"token=abcdef{i:012d}" if i % 9 == 0 else "end"]
        if i % 7 == 0:
            lines.insert(2, "idiot clown scum " + prose(5))
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 1))
    rows += [(200 + k, rows[k][1], "en", rows[k][3], 1) for k in (1, 2, 4)]  # exact copies
    rows += [(300 + k, rows[k][1] + " changed", "en", rows[k][3], 1) for k in (1, 5)]  # near copies
    rows += [(400, None, "en", "s0", None), (401, "", None, None, 0), (402, " \n ", "en", "s1", 3), (403, prose(20_000), "en", "s2", 1), (404, "w1" + " " * 2_000_000 + "w2", "en", "s2", 1), (1, rows[1][1], "en", "s1", 1)]
    return rows


def shingles(text, n=5):
    w = (text or "").split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def classes_of(texts):
    """A class for each text: the first of those that links reach."""
    sets, lead = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                lead[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def without_boilerplate(rows):
    texts = sorted({t or "" for _, t, *_ in rows})
    page = dict(zip(texts, classes_of(texts)))
    pages, seen = defaultdict(set), defaultdict(set)
    for _, t, _, host, _ in rows:
        pages[host].add(page[t or ""])
        for line in (t or "").split("\n"):
            seen[host, line.strip(" ")].add(page[t or ""])
    out = []
    for i, t, lang, host, n in rows:
        if t is not None:
            t = "\n".join(x for x in t.split("\n") if not x.strip(" ") or not 1 < len(seen[host, x.strip(" ")]) > 0.05 * len(pages[host]))
        out.append((i, t, lang, host, None if t is None else len(t)))
    return out


def one_of_each(rows):
    texts = [t for _, t, *_ in rows]
    groups, out = defaultdict(list), []
    for r, c in zip(rows, classes_of(texts)):
        if shingles(r[1]):
            groups[c].append(r)
        else:
            out.append(r)
    return out + [min(g, key=lambda r: r[0]) for g in groups.values()]


def redacted(text):
    if not text:
        return text
    spans = sorted((m.start(), m.end()) for r in secret_scan.BASE + secret_scan.ADDED for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_stages_by_brute_force(spark, tmp_path):
    rows = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 7 == 0)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    calm = STAGES["toxicity"](spark, docs, folder).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    kept = [r for r in rows if scorer.judge(r[1] or "")[0] < 0.7]
    assert rows_of(calm) == Counter(kept) and {r[0] for r in kept} == {r[0] for r in rows if r[0] >= 90 or r[0] % 7}

    plain = STAGES["line_dedup"](spark, calm, folder).cache()
    kept = without_boilerplate(kept)
    assert rows_of(plain) == Counter(kept)

    single = STAGES["jaccard_join"](spark, plain, folder).cache()
    kept = one_of_each(kept)
    assert rows_of(single) == Counter(kept)

    safe = STAGES["secret_scan"](spark, single, folder).cache()
    kept = [(i, t := redacted(text), lang, host, None if t is None else len(t)) for i, text, lang, host, _ in kept]
    assert rows_of(safe) == Counter(kept) and any("[SECRET]" in (r[1] or "") for r in kept)

    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), Counter()
    for i, text, *_ in kept:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 1024):
            want[i, at, zlib.crc32(np.array(ids[at : at + 1024], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == want


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_nothing(spark, tmp_path, name):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    nothing = spark.createDataFrame([], DOCS)
    done = STAGES[name](spark, nothing, folder)
    assert done.count() == 0 and (name == "packing" or done.columns == nothing.columns)
