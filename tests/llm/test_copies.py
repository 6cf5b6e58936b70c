"""Large groups of copies in the pipeline."""

import random

import corpus_pipeline
from quarrystone.llm import jaccard_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_full_copy_survives(spark, tmp_path):
    """A third of one source is copies of a page, a third of another near copies of one; each has a menu line too."""
    rng, rows = random.Random(5), []

    def page(n=30):
        return ["menu of the site"] + [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(n)]

    for source, first in (("exact", 0), ("near", 1000)):
        rows += [(first + i, "\n".join(page()), "en", source, 1) for i in range(60)]
        base = page()
        for i in range(30):
            own = list(base)
            if source == "near":
                own[1 + i] = f"edit of this copy {i}"
            rows.append((first + 500 + i, "\n".join(own), "en", source, 1))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    plain = stages["line_dedup"](spark, docs, str(tmp_path)).cache()
    want = {r[0]: r[1].split("\n", 1)[1] for r in rows}
    assert {r.doc_id: r.text for r in plain.collect()} == want  # only the menu goes
    single = {r.doc_id: r.text for r in stages["jaccard_join"](spark, plain, str(tmp_path)).collect()}
    copies = {i for i in want if i % 1000 >= 500}
    assert single == {i: t for i, t in want.items() if i not in copies or i in (500, 1500)}


def test_repeated_ids(spark):
    """Only the copy of an id's two texts goes; repeats go where an id and a text name them, others stay."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(4))
    near = c + " end"
    plain = [(1, a), (2, a), (2, b), (3, c), (3, near), (None, d), (None, d), (8, ""), (8, ""), (9, None), (9, None)]
    for rows in (plain, [*plain, (1, a)]):
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
        got = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect()), key=str)
        third = [x for x in got if x[0] == 3]
        assert len(third) == 1 and third[0][1] in (c, near)
        assert [x for x in got if x[0] != 3] == sorted([(1, a), (2, b), (None, d), (None, d), (8, ""), (8, ""), (9, None), (9, None)], key=str)
